"""Answers against evidence: the sentence stream, citations of statutes and documents as joins, one ladder of rules.

Cases: a null or empty answer has no sentences; evidence may be empty, then every citation is invalid; null texts of evidence
support a section but no words; repeated evidence counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.legal import CITATION, DOCUMENT, ascii_digits, citations, document_citations, normal_brackets
from folioscan.session import stored

#: Names of acts and the code of each.
ACT_NAMES = {
    "indian penal code": "IPC", "ipc": "IPC", "code of criminal procedure": "CRPC", "crpc": "CRPC", "indian evidence act": "IEA", "indian penal sanhita": "IPS",
    "bharatiya nagarik suraksha sanhita": "BNSS", "nagarik suraksha sanhita": "BNSS", "bharatiya nyaya sanhita": "BNS", "nyaya sanhita": "BNS",
}
#: Words of legal consequence, and those that every penalty shares.
CLAIM = (
    r"(?i)\b(punished|punishment|punishable|imprisonment|imprisoned|liable to|offence|offense|fine|sentence|imprisonment for life|death sentence|bailable"
    r"|cognizable|non-bailable|non-compoundable|compoundable)\b|दंड|दंडनीय|सजा|कारावास|आजीवन|दोषी|अपराध|जुर्माना|দণ্ড|সাজা|কারাবাস|தண்டனை|சிறை"
)
GENERIC = "punished punishment punishable imprisonment imprisoned liable offence offense fine sentence death life term bailable cognizable compoundable".split()
#: Words without content of their own.
FUNCTION_WORDS = (
    "a an the is are was were be been being am of to in on for with and or but not no nor it its this that these those as at by from has have had "
    "do does did done shall may might can could will would should must also such other any all each every some there here when where why how what "
    "which who whom whose if then than so very more most much many few both between under above below into upon about against during before after "
    "over again further he she they them him her his hers theirs you your yours we us our ours me my mine myself itself themselves yourself "
    "says said say provides provide states state stated according per section sections act acts"
).split()
#: Labels that look like statute citations, and sections named in prose.
LOOKALIKE = (r"\[\s*([A-Z]{2,6})[\s.:§-]*(?:section|sec\.?|s\.?)?[\s.:§-]*(\d{1,3})[^\]]*\]", r"\(([A-Za-z]{2,6})\s+[sS]\.?\s*(\d{1,3})[^\)]*\)")
PROSE = r"(?i)\bsections?\s+(\d{1,3})(?:\s*\(\s*(\d{1,3})\s*\))?(?:\s+of\s+)?\s*(?:the\s+)?(BNS|BNSS)?"
INDIC_PROSE = r"(?:धारा|ধারা|કલમ|பிரிவு|సెక్షన్|ವಿಧಿ|ಸೆಕ್ಷನ್|വകുപ്പ്|ਧਾਰਾ|ਸੈਕਸ਼ਨ|ଧାରା|दफ़ा|दफा)\s*(\d{1,3})"
#: Words of a speaker about itself, and abbreviations that hold one of them.
SELF = r"(?i)\b(?:i|i'm|im|myself|we|our|assistant|chatbot|robot|bot|ai)\b|(?<![ऀ-ൿ])(?:मैं|आम्ही|हुँ|हुं|હું|আমি|মই|நான்|నేను|ನಾನು|ഞാൻ|ਮੈਂ|ମୁଁ)(?![ऀ-ൿ])"
SELF_NOT = r"(?i)\b(?:i\.e|e\.g)\b\.?"
#: Ends of sentences, markers of list items, and abbreviations whose stop ends nothing.
STOP, MARKER = "[.!?।॥]", r"(?:[*+\-•]|\d{1,3}[.)])"
ABBREVIATION = r"\b(?:Mr|Mrs|Ms|Dr|vs|v|No|Nos|Rs|Sr|Jr|St|etc|approx|s|sec)\.$"


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words of letters only that carry content."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.rlike("[0-9]") & ~t.isin(*FUNCTION_WORDS)))


def statute_label(c: Column) -> Column:
    return F.concat(F.lit("["), c["act_short"], F.lit(" s."), c["section_number"], c["subsections"], F.lit("]"))


def document_label(c: Column) -> Column:
    page = F.coalesce(F.concat(F.lit(" p."), c["page"].cast("string")), F.lit(""))
    return F.concat(F.lit("[Document "), c["document_id"], page, F.lit("]"))


def has_indic(text: Column) -> Column:
    return text.rlike(r"[\x{0900}-\x{0D7F}&&\p{L}]")


def without(text: Column, labels: Column) -> Column:
    """A sentence without these labels; blanks left behind go."""
    bare = F.aggregate(labels, text, lambda t, x: F.replace(t, x, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"\s+([.,;:!?।॥])", "$1"))


def malformed(sentence: Column) -> Column:
    """Whether a label only looks like a citation: of another form, and not the section of a well-formed label beside it."""
    rest = F.regexp_replace(sentence, DOCUMENT, " ")
    valid = F.transform(citations(sentence), statute_label)
    found = []
    for form in LOOKALIKE:
        whole, act, number = (F.regexp_extract_all(rest, F.lit(form), F.lit(i)) for i in range(3))
        found.append(F.exists(F.arrays_zip(whole.alias("w"), act.alias("a"), number.alias("n")), lambda z: ~z["w"].rlike(f"^{CITATION}$") & ~F.array_contains(
            valid, F.concat(F.lit("["), F.upper(z["a"]), F.lit(" s."), z["n"], F.lit("]")))))
    return found[0] | found[1]


def sentence_stream(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, paragraph, seq, starts, sentence, lone): an answer's sentences in order.

    A sentence ends at a stop before white space, but not at the stop of an item's number or of an abbreviation, and a list item begins
    one. A marker alone goes to the sentence before it in its paragraph, and what is only labels to the sentence before it at all: ``lone`` has
    the answer's labels that stood so. ``seq`` counts an answer's sentences from 0, ``starts`` tells the first of a paragraph; blank lines
    part paragraphs. Pieces are joined by windows over one answer.
    """
    ends = rf"(?U)(?<={STOP})(?<!\d[.)])\s+|(?=\n\s*{MARKER}\s)"
    paragraphs = answers.select(key, F.posexplode(F.split(normal_brackets(F.col(text)), r"(?U)\n\s*\n")).alias("paragraph", "__p"))
    pieces = paragraphs.select(key, "paragraph", F.posexplode(F.split("__p", ends)).alias("__i", "__t")).withColumn("__t", F.regexp_replace("__t", r"(?U)^\s+|\s+$", "")).where("__t <> ''")

    def joined(rows: DataFrame, by: list[str], at: str, goes_on: Column, kept: list[Column]) -> DataFrame:
        numbered = rows.withColumn("__on", F.coalesce(goes_on, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(Window.partitionBy(*by).orderBy(at)))
        return numbered.groupBy(*by, "__g").agg(*kept, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "__t"))), lambda x: x["__t"]), " ").alias("__t"))

    inside = Window.partitionBy(key, "paragraph").orderBy("__i")
    before = F.lag("__t").over(inside)
    glued = before.isNotNull() & (F.col("__t").rlike(f"^{MARKER}$") | before.rlike(ABBREVIATION))
    s = joined(pieces, [key, "paragraph"], "__i", glued, []).withColumnRenamed("__g", "__i")
    whole = Window.partitionBy(key)
    in_order = whole.orderBy("__at")
    s = s.withColumn("__at", F.struct("paragraph", "__i")).withColumn("__label", F.col("__t").rlike(rf"^{MARKER}?\s*(?:\[[^\]]*\]\s*)+$") & F.lag("__t").over(in_order).isNotNull())
    labels = F.when(F.col("__label"), F.regexp_extract_all("__t", F.lit(r"\[[^\]]*\]"), F.lit(0)))
    s = s.withColumn("__lone", F.array_distinct(F.flatten(F.collect_list(labels).over(whole))))
    out = joined(s, [key], "__at", F.col("__label"), [F.min("__at").alias("__first"), F.first("__lone").alias("lone")])
    return out.select(key, F.col("__first.paragraph").alias("paragraph"), (F.col("__g") - 1).cast("int").alias("seq"), (F.col("__first.__i") == 1).alias("starts"), F.col("__t").alias("sentence"), "lone")


def _offered(cited: DataFrame, evidence: DataFrame, documents: DataFrame | None) -> DataFrame:
    """(label, token) of what evidence covers each cited label with; a row without a token for each covered label."""
    by_section = ["act_short", "section_number"]
    wanted = cited.where("act_short is not null").select("label", *by_section, "subsections").distinct()
    title = F.col("section_title") if "section_title" in evidence.columns else F.lit(None).cast("string")
    e = evidence.select(*by_section, "subsection", F.concat_ws(" ", title, "text").alias("__words"), F.coalesce("text", F.lit("")).alias("text"))
    fits = (F.col("subsections") == "") | F.coalesce(F.col("subsection") == F.col("subsections"), F.lit(False)) | (F.col("subsection").isNull() & F.contains("text", F.col("subsections")))
    covered = wanted.join(e, by_section).where(fits).select("label", "__words")
    if documents is not None:
        wanted = cited.where("document_id is not null").select("label", "document_id", "page").distinct()
        pages = documents.select("document_id", "page_start", "page_end", F.col("text").alias("__words"))
        there = wanted.join(pages, "document_id").where(F.col("page").isNull() | F.col("page").between(F.col("page_start"), F.col("page_end")))
        covered = covered.union(there.select("label", "__words"))
    return covered.select("label", F.explode_outer(content_tokens(F.col("__words"))).alias("token")).distinct()


def check_answers(answers: DataFrame, evidence: DataFrame, key: str = "answer_id", documents: DataFrame | None = None) -> DataFrame:
    """(key, paragraph, seq, sentence, rule, kept, dropped, seen) of every sentence: the first rule that fits decides.

    ``evidence`` has (act_short, section_number, subsection, text) and may have section_title; ``documents`` has (document_id, page_start,
    page_end, text). ``misattributed``: names an act that the evidence lacks and cites no document. ``malformed``: carries a label
    that can't be checked. ``unknown_section``: without a citation, names a section in prose that the evidence lacks. ``uncited_claim``: states
    a legal consequence, names no section, and the next sentence of its paragraph cites nothing that shares two content words with
    it, one of them not generic. ``invalid``: cites what the evidence lacks, at the subsection's or the page's level. These go. ``self_reference``:
    speaks of the speaker and shares no word with what it cites; ``no_content``: has no words of its own; both stay without their labels.
    ``irrelevant``: shares no content word with what it cites; goes. A label that stood alone needs no shared word. Nor does, in a
    sentence of an Indic script, a document's label, or a statute's whose section number the sentence has.
    Else ``keep``, without labels that share no word. ``kept`` is the text that stays, ``dropped`` the labels taken off,
    ``seen`` whether the sentence counts as text of the answer.

    Citations, prose sections and acts meet the evidence in equi joins; words meet on (label, word), so no text is carried to a sentence.
    """
    s = sentence_stream(answers, key).withColumn("__k", F.struct(key, "seq"))
    statutes, files = citations(F.col("sentence")), document_citations(F.col("sentence"))
    s = s.withColumn("__labels", F.concat(F.transform(statutes, statute_label), F.transform(files, document_label))).withColumn("__bare", without(F.col("sentence"), F.col("__labels")))
    # Stored: sentences are cut once, not once for each of the joins below.
    s = stored(s)
    names = F.create_map(*[F.lit(x) for kv in ACT_NAMES.items() for x in kv])
    acts = evidence.select(F.upper("act_short").alias("__act")).distinct().withColumn("__has", F.lit(True))
    named = names[F.lower(F.regexp_extract("sentence", r"(?i)\b(" + "|".join(sorted(ACT_NAMES, key=len, reverse=True)) + r")\b", 1))]
    flagged = s.withColumn("__act", named).join(acts, "__act", "left").withColumn("__foreign", F.col("__act").isNotNull() & F.col("__has").isNull()).drop("__act", "__has")

    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    one = s.select("__k", "starts", "lone", "__bare", F.explode(statutes).alias("c"))
    two = s.select("__k", "starts", "lone", "__bare", F.explode(files).alias("c"))
    common = ["__k", "starts", "lone", "__bare"]
    cited = one.select(*common, statute_label(F.col("c")).alias("label"), "c.act_short", "c.section_number", "c.subsections", none("string", "document_id"), none("int", "page")).union(
        two.select(*common, document_label(F.col("c")).alias("label"), none("string", "act_short"), none("string", "section_number"), none("string", "subsections"), "c.document_id", "c.page"))
    cited = stored(cited)
    vocabulary = _offered(cited, evidence, documents)
    known = vocabulary.select("label").distinct().withColumn("__ok", F.lit(1))
    own = s.select("__k", F.explode(content_tokens(F.col("__bare"))).alias("token"))
    offered = cited.select("__k", "starts", "label").distinct().join(vocabulary, "label")
    shared = offered.join(own, ["__k", "token"]).select("__k", "label").distinct().withColumn("__shares", F.lit(True))
    number = F.concat(F.lit(r"(?<!\d)"), "section_number", F.lit(r"(?!\d)"))
    per = cited.join(known, "label", "left").join(shared, ["__k", "label"], "left").select(
        "__k", "label", "__ok", F.coalesce("__shares", F.lit(False)).alias("__s"), F.array_contains("lone", F.col("label")).alias("__l"),
        (F.col("document_id").isNotNull() | F.coalesce(F.regexp_like(ascii_digits(F.col("__bare")), number), F.lit(False))).alias("__b"))
    judged = per.groupBy("__k").agg(
        F.count("*").alias("__nc"), F.count("__ok").alias("__nok"), F.bool_or("__s").alias("__rel"), F.bool_or(F.col("__s") | F.col("__l")).alias("__near"), F.bool_or("__b").alias("__bridge"),
        F.collect_set(F.when(F.col("__s") | F.col("__l"), F.col("label"))).alias("__keep"), F.collect_set(F.when(F.col("__b"), F.col("label"))).alias("__over"),
    )
    # What a sentence's citations offer is held against the sentence before it, too, within a paragraph.
    previous = F.struct(F.col(f"__k.{key}").alias(key), (F.col("__k.seq") - 1).alias("seq"))
    lent = offered.where("not starts").withColumn("__k", previous).join(own, ["__k", "token"]).groupBy("__k", "label").agg(
        F.count("*").alias("__n"), F.sum(F.when(F.col("token").isin(*GENERIC), 0).otherwise(1)).alias("__g"))
    sibling = lent.where("__n >= 2 and __g >= 1").select("__k").distinct().withColumn("__sib", F.lit(True))

    parts = [F.regexp_extract_all("sentence", F.lit("(?U)" + PROSE), F.lit(i)) for i in (1, 3)]
    indic = F.regexp_extract_all(ascii_digits(F.col("sentence")), F.lit(INDIC_PROSE), F.lit(1))
    claims = F.concat(F.transform(F.arrays_zip(parts[0].alias("n"), parts[1].alias("a")), lambda z: F.struct(F.upper(z["a"]).alias("a"), z["n"].alias("n"))),
                      F.transform(indic, lambda n: F.struct(F.lit("").alias("a"), n.alias("n"))))
    sections = evidence.select(F.lit("").alias("a"), F.col("section_number").alias("n")).union(evidence.select("act_short", "section_number")).distinct().withColumn("__in", F.lit(1))
    prose = s.where(F.size("__labels") == 0).select("__k", F.inline(claims))
    stray = prose.join(sections, ["a", "n"], "left").groupBy("__k").agg(F.max(F.col("__in").isNull()).alias("__stray"))

    out = flagged.join(judged, "__k", "left").join(sibling, "__k", "left").join(stray, "__k", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    uncited, bare = F.size("__labels") == 0, F.col("__bare")
    names_section = bare.rlike("(?U)" + PROSE) | ascii_digits(bare).rlike(INDIC_PROSE)
    about_self = F.regexp_replace("sentence", SELF_NOT, "").rlike(SELF)
    rule = (
        F.when(F.col("__foreign") & (F.size(files) == 0), "misattributed").when(malformed(F.col("sentence")), "malformed").when(uncited & yes("__stray"), "unknown_section")
        .when(uncited & bare.rlike(CLAIM) & ~names_section & ~yes("__sib"), "uncited_claim").when(uncited, "keep").when(F.col("__nok") < F.col("__nc"), "invalid")
        .when(about_self & ~yes("__rel"), "self_reference").when((F.size(content_tokens(bare)) == 0) & ~has_indic(bare), "no_content")
        .when(~yes("__near") & ~(has_indic(bare) & yes("__bridge")), "irrelevant").otherwise("keep")
    )
    stays = F.when(yes("__near"), F.col("__keep")).otherwise(F.col("__over"))
    dropped = F.when(F.col("rule").isin("self_reference", "no_content", "irrelevant"), F.col("__labels")).when((F.col("rule") == "keep") & ~uncited, F.array_except("__labels", stays)).otherwise(
        F.array().cast("array<string>"))
    kept = F.when(F.col("rule").isin("self_reference", "no_content"), bare).when(F.col("rule") == "keep", F.when(F.size("dropped") > 0, without(F.col("sentence"), F.col("dropped"))).otherwise(F.col("sentence")))
    seen = (bare.rlike("[A-Za-z0-9]") | has_indic(bare)) & F.col("rule").isin("keep", "self_reference", "no_content", "irrelevant")
    return out.withColumn("rule", rule).withColumn("dropped", dropped).select(key, "paragraph", "seq", "sentence", "rule", kept.alias("kept"), "dropped", seen.alias("seen"))


def canonical_labels(text: Column) -> Column:
    """One form for each label: act codes upper case, no blanks inside, documents' ids behind the word; blanks made single and plain."""
    raw = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    out = F.aggregate(F.arrays_zip(raw.alias("r"), citations(text).alias("c")), text, lambda t, z: F.replace(t, z["r"], statute_label(z["c"])))
    out = F.translate(F.regexp_replace(out, r"\s{2,}", " "), "\u202f\u00a0", "  ")
    for word in ("", r"Document\s+"):
        out = F.regexp_replace(out, rf"\[{word}\{{?([0-9a-fA-F]{{8,64}})\}}?(?:\s+p\.(\d{{1,4}}))\]", "[Document $1 p.$2]")
        out = F.regexp_replace(out, rf"\[{word}\{{?([0-9a-fA-F]{{8,64}})\}}?\]", "[Document $1]")
    return out


def kept_text(checked: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, text, n_removed): what stays of each answer, in order; empty where nothing but labels stays."""
    order = F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("seq", "kept"))))
    rows = checked.groupBy(key).agg(order.alias("__s"), F.count(F.when(F.col("kept").isNull(), 1)).alias("n_removed"), F.bool_or("seen").alias("__seen"))
    text = canonical_labels(F.trim(F.array_join(F.transform("__s", lambda x: x["kept"]), " ")))
    return rows.select(key, F.when(F.col("__seen"), text).otherwise("").alias("text"), "n_removed")
