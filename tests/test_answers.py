"""Edge cases of routing, document references, form search, admission and answer checks."""

from pyspark.sql import functions as F

from folioscan.functions import dialogue
from folioscan.operators import checking, references, workflow
from folioscan.streaming import state


def test_null_and_empty_questions(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "i int, q string")
    got = df.select(dialogue.route(F.col("q")).alias("a"), dialogue.small_talk(F.col("q")).alias("b"), dialogue.without_references(F.col("q"), F.lit(None).cast("array<string>")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("statute", None, "")] * 2


def test_references_precedence(spark):
    docs = spark.createDataFrame([(1, "a", "lease.pdf", 1), (1, "b", "arrears.pdf", 2), (2, "c", None, 1)], "session_id int, document_id string, filename string, position int")
    asked = [
        (1, 1, "the other document", ["a"]), (1, 2, "the other document", None), (1, 3, "what about arrears", None), (1, 4, "that document", None), (2, 5, "previous file", None),
        (2, 6, None, None), (3, 7, "this document", None), (1, 8, "first and second document", None), (1, 9, "the lease", None),
    ]
    q = spark.createDataFrame(asked, "session_id int, query_id int, text string, context array<string>")
    got = sorted((r.query_id, r.outcome, r.document_id) for r in references.resolve(q, docs).collect())
    assert got == [
        (1, "documents", "b"), (2, "ambiguous", None), (3, "documents", "b"), (4, "ambiguous", None), (5, "documents", "c"), (6, "all", None), (7, "no_such_document", None),
        (8, "documents", "a"), (8, "documents", "b"), (9, "all", None),
    ]


def test_form_search(spark):
    forms = spark.createDataFrame([(1, "Bond to keep the Peace"), (23, "Summons to a witness"), (4, None)], "form_number int, title string")
    q = spark.createDataFrame([(1, "23"), (2, "peace keep"), (3, "bond peace"), (4, "to"), (5, "  "), (6, None), (7, "witness summons absent")], "query_id int, query string")
    got = sorted((r.query_id, r.form_number, r.score) for r in workflow.search_forms(q, forms).collect())
    assert got == [(1, 23, 1000000), (2, 1, 200), (3, 1, 250), (4, 1, 500000), (4, 23, 500000)]


def test_admission_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.sql("select id as event_id, cast(if(id % 5 = 4, null, id % 2) as int) as user, timestamp_seconds(id) as ts from range(40)")
        got = {r.event_id: r.allowed for r in state.rate_limit(rows, "user", 2, 10.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = {}, {}
    for i in range(40):
        recent = [t for t in held.get(None if i % 5 == 4 else i % 2, []) if t > i - 10]
        want[i] = len(recent) < 2
        held[None if i % 5 == 4 else i % 2] = recent + [i] * want[i]
    assert got == want


def test_empty_tables(spark):
    answers = spark.createDataFrame([(1, "Plain words. He is liable to a fine.")], "answer_id int, text string")
    evidence = spark.createDataFrame([], "act_short string, section_number string, subsection string, text string")
    assert [r.rule for r in checking.check_answers(answers, evidence).orderBy("seq").collect()] == ["keep", "uncited_claim"]
    assert checking.check_answers(answers.where("false"), evidence).count() == 0
