"""Names of acts across languages, refusals, answer languages, labels of conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.text import once

#: Acts by their English names, with what else they are called.
ACT_ALIASES = {
    "Bharatiya Nyaya Sanhita": ("bharatiya nyaya sanhita", "bns", "भारतीय न्याय संहिता"),
    "Bharatiya Nagarik Suraksha Sanhita": ("bharatiya nagarik suraksha sanhita", "bnss", "भारतीय नागरिक सुरक्षा संहिता"),
    "Indian Penal Code": ("indian penal code", "ipc", "भारतीय दंड संहिता", "भारतीय दण्ड संहिता"),
    "Code of Criminal Procedure": ("code of criminal procedure", "crpc", "दंड प्रक्रिया संहिता", "दण्ड प्रक्रिया संहिता"),
}
#: What a refusal says in each language.
REFUSALS = {
    "en": "I don't know based on the available source material.",
    "hi": "उपलब्ध स्रोत सामग्री के आधार पर मुझे यह जानकारी नहीं है।",
    "bn": "উপলব্ধ উৎস উপকরণের ভিত্তিতে আমি এটি জানি না।",
    "mr": "उपलब्ध स्रोत सामग्रीच्या आधारावर मला हे माहीत नाही.",
    "gu": "ઉપલબ્ધ સ્રોત સામગ્રીના આધારે મને આ ખબર નથી.",
    "ta": "கிடைக்கக்கூடிய மூலப் பொருளின் அடிப்படையில் எனக்கு இது தெரியவில்லை.",
    "te": "అందుబాటులో ఉన్న మూల సామగ్రి ఆధారంగా నాకు ఇది తెలియదు.",
    "kn": "ಲಭ್ಯವಿರುವ ಮೂಲ ಸಾಮಗ್ರಿ ಆಧರಿಸಿ ನನಗೆ ಇದು ಗೊತ್ತಿಲ್ಲ.",
    "ml": "ലഭ്യമായ മൂല സാമഗ്രിയുടെ അടിസ്ഥാനത്തിൽ എനിക്കറിയില്ല.",
    "pa": "ਉਪਲਬਧ ਸਰੋਤ ਸਮੱਗਰੀ ਦੇ ਆਧਾਰ 'ਤੇ ਮੈਨੂੰ ਇਹ ਪਤਾ ਨਹੀਂ ਹੈ।",
    "or": "ଉପଲବ୍ଧ ମୂଳ ସାମଗ୍ରୀ ଆଧାରରେ ମୋତେ ଏହା ଜଣା ନାହିଁ।",
    "as": "উপলব্ধ উৎস সামগ্ৰীৰ ভিত্তিতে মই এইটো নাজানো।",
}
#: The least bound of a translation's length, and what it may be of its source's.
TRANSLATION_LEAST, TRANSLATION_TIMES = 2000, 4
TITLE_MOST = 40

_NAMES = {alias: act for act, aliases in ACT_ALIASES.items() for alias in aliases}
_SHORT = [a for a in _NAMES if a.isascii() and " " not in a]
#: Short names count as whole words only, others wherever they stand; the longest first.
_ALIAS = "|".join([*sorted((a for a in _NAMES if a not in _SHORT), key=len, reverse=True), rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(_SHORT, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"])


def mentioned_acts(text: Column) -> Column:
    """Sorted English names of the acts that a text mentions in any script; null: none."""
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_ALIAS), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: names[a])))


def _renamed(aliases: tuple[str, ...]) -> Callable[[Column], Column]:
    """Of (name, text): the text with the name in place of each alias, or as it is where there is no name."""

    def use(p: Column) -> Column:
        out = p["text"]
        for alias in aliases:
            out = F.regexp_replace(out, F.lit(rf"(?iu)\Q{alias}\E"), p["name"])
        return F.when(p["name"].isNull(), p["text"]).otherwise(out)

    return use


def repair_acts(original: Column, translated: Column) -> Column:
    """A translation that names the acts of its original.

    Acts that only the translation names are written as those it lost, in the order of their names; lost acts beyond these
    are added at the end in brackets. Nothing changes where the original names no act or the translation lost none. Any alias of a
    replaced act is rewritten, wherever it stands.
    """

    def rewritten(missing: Column, introduced: Column) -> Column:
        out = translated
        for act in sorted(ACT_ALIASES):
            at = F.array_position(introduced, act).cast("int")
            out = once(F.struct(F.when(at > 0, F.get(missing, at - 1)).alias("name"), out.alias("text")), _renamed(ACT_ALIASES[act]))
        return out

    def ended(missing: Column, out: Column) -> Column:
        whole = lambda lost: F.when(F.size(lost) > 0, F.concat(F.rtrim(out), F.lit(" ("), F.array_join(F.array_sort(lost), ", "), F.lit(")"))).otherwise(out)
        return once(F.array_except(missing, mentioned_acts(out)), whole)

    def repaired(missing: Column, introduced: Column) -> Column:
        return F.when(F.size(missing) > 0, once(rewritten(missing, introduced), lambda out: ended(missing, out))).otherwise(translated)

    names = F.struct(mentioned_acts(original).alias("asked"), mentioned_acts(translated).alias("got"))
    differing = once(names, lambda n: F.struct(F.array_except(n["asked"], n["got"]).alias("missing"), F.array_except(n["got"], n["asked"]).alias("introduced")))
    return once(differing, lambda x: repaired(x["missing"], x["introduced"]))


def plausible_translation(original: Column, translated: Column) -> Column:
    """A translation without blanks around it, repaired; null if it is empty or far longer than its original."""
    text = F.trim(translated)
    most = F.greatest(F.lit(TRANSLATION_LEAST), F.length(original) * TRANSLATION_TIMES)
    return F.when((text != "") & (F.length(text) <= most), repair_acts(original, text))


def answer_language(preference: Column, detected: Column) -> Column:
    """The language asked for if it is one that answers are given in, else the detected one."""
    return F.when(preference.isin(*REFUSALS), preference).otherwise(detected)


def refusal_text(language: Column) -> Column:
    """What a refusal says in a language; a language without one gets English."""
    texts = F.create_map(*[F.lit(x) for kv in REFUSALS.items() for x in kv])
    return F.coalesce(texts[language], F.lit(REFUSALS["en"]))


def is_refusal(answer: Column) -> Column:
    """Whether an answer is the refusal of some language, as a whole."""
    return F.coalesce(F.trim(answer).isin(*REFUSALS.values()), F.lit(False))


def ends_in_refusal(answer: Column) -> Column:
    """Whether an answer is or ends in the refusal of some language."""
    text, out = F.trim(F.coalesce(answer, F.lit(""))), F.lit(False)
    for r in REFUSALS.values():
        out = out | text.endswith(r)
    return out


def conversation_title(message: Column) -> Column:
    """The first ``TITLE_MOST`` characters of a message on one line, with an ellipsis if there are more."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")
    return F.when(F.length(text) > TITLE_MOST, F.concat(F.substring(text, 1, TITLE_MOST), F.lit("…"))).when(text == "", "New conversation").otherwise(text)
