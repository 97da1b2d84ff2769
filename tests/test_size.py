"""What large tables need: values made once a row, rows dealt over tasks, no question table broadcast."""

import pytest
import pytest
from pyspark.sql import functions as F

from folioscan.functions import dialogue, language, legal, text
from folioscan.operators import checking, index, structure, titles, workflow
from folioscan.plans import answers, composed


def made(spark, use, name="regexp_extract_all("):
    """How often an expression over a text makes its tokens."""
    df = spark.createDataFrame([("x",)], "t string").select(use(F.col("t")).alias("x"))
    return df._jdf.queryExecution().analyzed().toString().count(name)


def test_section_intent_makes_its_marks_once(spark):
    assert made(spark, legal.section_intent) == 1
    asked = [("BNS 12(3)", ("12", "3")), ("within 30 days of section 7", ("7", None)), ("no number", None), ("धारा १२", ("12", None)), ("Rs 500", None), (None, None)]
    got = spark.createDataFrame([(q,) for q, _ in asked], "q string").select(legal.section_intent(F.col("q")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in got] == [w for _, w in asked]


def test_route_makes_its_words_once(spark):
    assert made(spark, dialogue.route) == 2


def test_references_make_their_marks_once(spark):
    assert made(spark, legal.references) == 1
    text = "sections 1, 2 and 3 apply, section 9(2) too, " + "and so on " * 400 + "sub-section (4) of section 8, sections 5 to 7."
    got = spark.createDataFrame([(text,)], "t string").select(legal.references(F.col("t")).alias("r")).first()["r"]
    assert got == ["section 8(4)", "section 1", "section 2", "section 3", "section 9(2)", "section 5", "section 6", "section 7"]


def test_act_repair_finds_acts_once(spark):
    # In the original, in the translation, and in what that is written to.
    assert made(spark, lambda t: language.repair_acts(t, t)) == 3


@pytest.mark.parametrize("name", ["retrieve_route", "retrieved_rows"])
def test_no_question_table_is_broadcast(spark, data, name):
    """A file's size says little of the questions made of it: Spark took them for as small as their customers."""
    plan = composed.QUERIES[name](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    tables = [x for x in plan.split("BroadcastHashJoin")[1:] if x.startswith(" [query_id")]
    assert not tables


def test_forms_are_sent_only_by_keys_that_are_asked_for(spark):
    forms = spark.range(2000).select(F.col("id").alias("form_number"), F.concat(F.lit("Return of stock "), F.col("id").cast("string")).alias("title"))
    q = spark.createDataFrame([(1, "stock 77"), (2, "77"), (3, "of 5 stock")], "query_id int, query string")
    found = workflow.search_forms(q, forms)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["query_id"], r["form_number"]): r["score"] for r in found.collect()}
    assert got[1, 77] == got[1, 770] == 500_000 and got[2, 77] == 1_000_000 and got[2, 1770] == 500_000 and got[3, 5] == 200 and (3, 77) not in got


def test_a_file_is_not_named_by_a_longer_number(spark):
    """Numbers of different lengths meet in a session once a table is large: 100000 stands in 9100000."""
    said = [("what is in rent deed 9100000", "rent-deed-100000.pdf", False), ("what is in rent deed 9100000", "rent-deed-9100000.pdf", True), ("rent of the deed 100000, please", "rent-deed-100000.pdf", True),
            ("rent and rent deed 100000", "rent-deed-100000.pdf", True), ("deed rent 100000", "rent-deed-100000.pdf", False), ("current deed 100000", "rent-deed-100000.pdf", False)]
    got = spark.createDataFrame(said, "q string, f string, w boolean").select("w", dialogue.names_file(F.col("q"), F.col("f")).alias("g")).collect()
    assert [r["g"] for r in got] == [r["w"] for r in got]


def test_title_token_takes_the_first_suffix_that_leaves_three_letters(spark):
    words = "nations creation nation ments payments aged ages ties flies sess age wages sedation x yes stations".split()
    first = lambda w: next((w[: -len(s)] for s in text.TITLE_SUFFIXES if w.endswith(s) and len(w) - len(s) >= 3), w)
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.title_token(F.col("w")).alias("t")).collect()
    assert [r["t"] for r in got] == [first(r["w"]) for r in got]


def test_first_lines_are_read_once_a_section(spark):
    rows = spark.createDataFrame([(1, "a long title\nwith more words")], "doc_id int, text string")
    plan = titles.title_matches(rows.select(F.col("doc_id").alias("title_id"), "text"), rows)._jdf.queryExecution().optimizedPlan().toString()
    # A generator's Project would read the line again for every token that comes out of it.
    assert not [x for x in plan.split("\n") if "Project" in x and "array_contains" in x and "regexp_extract_all" in x]


def test_lines_are_cleaned_once(spark):
    lines = spark.createDataFrame([(1, 1, "a rule glued7. Whoever does"), (1, 2, "GAZETTE OF INDIA"), (1, 3, None)], "doc_id int, line_no int, line string")
    found = structure.clean_page(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("·") == 1
    assert [r["line"] for r in found.orderBy("line_no").collect()] in (["a rule glued.", "7. Whoever does"], ["a rule glued.7. Whoever does"])


@pytest.mark.parametrize("module, name", [(answers, "mrr"), (composed, "eval_dense_hybrid")])
def test_the_sparse_list_is_made_once(spark, data, monkeypatch, module, name):
    calls, made_by = [], index.bm25
    monkeypatch.setattr(index, "bm25", lambda *a, **k: calls.append(1) or made_by(*a, **k))
    plan = module.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "qtf" not in plan


def test_sentences_are_cut_once(spark):
    rows = spark.createDataFrame([(1, "The widget is sold [BNS s.5]. It is not.")], "answer_id int, text string")
    evidence = spark.createDataFrame([("BNS", "5", None, "Whoever sells a widget")], "act_short string, section_number string, subsection string, text string")
    assert "posexplode" not in checking.check_answers(rows, evidence)._jdf.queryExecution().optimizedPlan().toString()
