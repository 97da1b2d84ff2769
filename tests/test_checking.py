"""Sentences of answers and the rules that decide them."""

from pyspark.sql import functions as F

from folioscan.functions import language
from folioscan.operators import checking


def sentences(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "answer_id int, text string")
    rows = checking.sentence_stream(df).orderBy("answer_id", "seq").collect()
    return [[(r.sentence, r.starts) for r in rows if r.answer_id == i] for i in range(len(texts))], {r.answer_id: r.lone for r in rows}


def test_sentence_stream(spark):
    got, lone = sentences(
        spark, "One. Two! Three? Four।पाँच॥ six", "The fine is Rs. 500 under sec. 5. Mr. A pays.", "In short:\n* first item\n* second\n1. third", "1. Alone. 2. After.",
        "It holds. [BNS s.5] Next.", "First.\n\n[Document abcdef12 p.1]\nThen this.", "[BNS s.5]", " \n\n ", "Listed:\n* [BNS s.1]\n* [BNS s.2]", None,
    )
    assert got == [
        [("One.", True), ("Two!", False), ("Three?", False), ("Four।पाँच॥", False), ("six", False)], [("The fine is Rs. 500 under sec. 5. Mr. A pays.", True)],
        [("In short:", True), ("* first item", False), ("* second", False), ("1. third", False)], [("1. Alone.", True), ("2. After.", False)],
        [("It holds.", True), ("[BNS s.5] Next.", False)], [("First.", True), ("[Document abcdef12 p.1]\nThen this.", True)], [("[BNS s.5]", True)], [], [("Listed: * [BNS s.1] * [BNS s.2]", True)], [],
    ]
    assert sorted(lone[8]) == ["[BNS s.1]", "[BNS s.2]"] and lone[4] == [] and lone[6] == [] and lone[5] == []


EVIDENCE = [("BNS", "103", "(1)", "Whoever commits murder shall be punished with death."), ("BNS", "303", None, "Theft under (2) is taking movable property."), ("CRPC", "5", None, None)]
FILES = [("abcdef12", 1, 2, "The tenant owes arrears of rent."), ("0badc0de", 4, 4, None)]


def rules(spark, *texts, files=FILES):
    answers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "answer_id int, text string")
    evidence = spark.createDataFrame(EVIDENCE, "act_short string, section_number string, subsection string, text string")
    documents = None if files is None else spark.createDataFrame(files, "document_id string, page_start int, page_end int, text string")
    checked = checking.check_answers(answers, evidence, documents=documents)
    return [(r.rule, r.kept) for r in checked.orderBy("answer_id", "seq").collect()], {r.answer_id: r.text for r in checking.kept_text(checked).collect()}


def test_rules(spark):
    got, kept = rules(
        spark, "Murder is punished [BNS s.103(1)].", "Murder [BNS s.103(2)].", "Theft of property [BNS s.303(2)].", "Rent is owed [Document abcdef12 p.3].", "Arrears [abcdef12 p.2] and murder [BNS s.103].",
        "Our client is a tenant [Document abcdef12].", "We help [Document abcdef12].", "See section 5 of the BNS.", "See section 5.", "धारा 999 कहती है", "Section 5 [BNS 303] [BNS s.303] is theft.",
        "Theft i.e. taking property [BNS s.303].", "Law [CRPC s.5].", "The moon [0badc0de p.4].", "* [BNS s.303]\n* [BNS s.103]", "It is bailable.\n\nTheft of property is bailable [BNS s.303].",
    )
    assert [r for r, _ in got] == [
        "keep", "invalid", "keep", "invalid", "keep", "keep", "self_reference", "unknown_section", "keep", "unknown_section", "keep", "keep", "keep", "irrelevant", "irrelevant", "no_content", "uncited_claim", "keep",
    ]
    assert kept[4] == "Arrears [Document abcdef12 p.2] and murder [BNS s.103]." and kept[6] == "We help." and kept[14] == "" and kept[1] == ""


def test_rules_without_documents_or_evidence(spark):
    got, _ = rules(spark, "Rent is owed [Document abcdef12].", "Plain words.", files=None)
    assert [r for r, _ in got] == ["invalid", "keep"]
    got, _ = rules(spark, "Rent is owed [Document abcdef12].", files=[])
    assert [r for r, _ in got] == ["invalid"]


def test_acts_and_refusals(spark):
    df = spark.createDataFrame([("BNS 5", "Section 5 of the IPC", "Section 5 of the Bharatiya Nyaya Sanhita"), (None, "of the IPC", "of the IPC"), ("BNS", None, None), ("BNS", "x" * 2001, None), ("", "  ", None)], "o string, t string, w string")
    rows = df.select(language.repair_acts(F.col("o"), F.col("t")).alias("r"), language.plausible_translation(F.col("o"), F.col("t")).alias("p"), "w").collect()
    assert [r.r for r in rows][:3] == [r.w for r in rows][:3] and [r.p for r in rows][2:] == [None, None, None]
    says = spark.createDataFrame([(t,) for t in [*language.REFUSALS.values(), "no", None]], "t string").select(language.is_refusal(F.col("t")), language.ends_in_refusal(F.concat(F.lit("so: "), "t"))).collect()
    assert [tuple(r) for r in says] == [(True, True)] * 12 + [(False, False)] * 2
