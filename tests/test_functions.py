"""Values of the text and legal functions."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions import legal, text
from folioscan.functions.vectors import hash_bucket
from folioscan.operators import grounding, index, ranking, sessions, structure
from folioscan.streaming import state


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


STEMS = {
    "murders": "murder", "murdering": "murder", "murdered": "murder", "murderer": "murderer", "killing": "murder", "killed": "murder", "kill": "murder",
    "punishment": "punishment", "punished": "punish", "cheating": "cheat", "cheated": "cheat", "notice": "notic", "notices": "notic", "cruelty": "cruelty",
    "cruel": "cruelty", "cases": "cas", "witnesses": "witness", "committed": "commit", "deliberately": "deliberat", "thief": "theft", "steal": "theft",
    "stole": "theft", "stolen": "theft", "103": "103", "103(1)": "103(1)", "3days": "3days", "parties": "party", "planned": "plan", "multiplying": "multiply",
}


def test_stems(spark):
    rows = spark.createDataFrame(list(STEMS.items()), "w string, want string").withColumn("got", text.stem(F.col("w"))).collect()
    assert {r.w: r.got for r in rows} == STEMS


def test_tokens(spark):
    df = spark.createDataFrame([(1, "What is the punishment for murder?"), (2, None), (3, "")], "doc_id int, text string")
    assert sorted((r.doc_id, r.term) for r in index.terms(df).collect()) == [(1, "murder"), (1, "punishment")]


def test_bucket(spark):
    assert one(spark, hash_bucket(F.lit("murder"))) == 246


@pytest.mark.parametrize(
    "t,want",
    [
        ("see section 103 and section 2(11)", ["section 103", "section 2(11)"]),
        ("sections 383, 384 and 388", ["section 383", "section 384", "section 388"]),
        ("sections 81 to 84", ["section 81", "section 82", "section 83", "section 84"]),
        ("sub-section (1) of section 164 and section 5", ["section 164(1)", "section 5"]),
        ("section 7 and section 7", ["section 7"]),
        ("no reference", []),
    ],
)
def test_references(spark, t, want):
    assert one(spark, legal.references(F.lit(t))) == want


@pytest.mark.parametrize(
    "q,want",
    [
        ("section 103", ("103", None)), ("section 103(2)", ("103", "2")), ("BNS 103", ("103", None)), ("103 BNS", ("103", None)), ("What does 103 say?", ("103", None)),
        ("धारा १०३", ("103", None)), ("30 days notice", None), ("case no. 5", None), ("Rs 300", None), ("2,00,000", None), ("7.5 lakh", None), ("BNS 1030", None), ("page 12", None),
    ],
)
def test_intent(spark, q, want):
    got = one(spark, legal.section_intent(F.lit(q)))
    assert (tuple(got) if got else None) == want


def test_citations(spark):
    got = one(spark, legal.citations(F.lit("a [BNS s.103] b [bns S. 5 (1) (2)] c 【BNSS s.7】 d [BNS 9]")))
    assert [tuple(r) for r in got] == [("BNS", "103", ""), ("BNS", "5", "(1)(2)"), ("BNSS", "7", "")]
    docs = one(spark, legal.document_citations(F.lit("[Document d31f9cab p.2] [{d31f9cab} p.1] [deadbeef00]")))
    assert [tuple(r) for r in docs] == [("d31f9cab", 2), ("d31f9cab", 1), ("deadbeef00", None)]
    docs = one(spark, legal.document_citations(F.lit("[Document doc-17 p.2] [Document {ab12} p.1] [doc-17 p.2] [Document x]")))
    assert [tuple(r) for r in docs] == [("doc-17", 2), ("ab12", 1), ("x", None)]


@pytest.mark.parametrize("t,want", [("कायदा काय आहे", "mr"), ("यह क्या है", "hi"), ("What does धारा 103 say?", "en"), ("", "en"), (None, "en"), ("ধাৰা কি", "as")])
def test_language(spark, t, want):
    assert one(spark, legal.language(F.lit(t).cast("string"))) == want


def test_slug(spark):
    assert one(spark, text.slug(F.lit("BOND AND BAIL-BOND AFTER ARREST UNDER A WARRANT"))) == "Bond-and-Bail-Bond-After-Arrest-Under-a-Warrant"
    assert one(spark, text.slug(F.lit("  ** "))) == "Untitled"


def test_reasoning(spark):
    assert one(spark, text.strip_reasoning(F.lit("a<think>x</think> b <Reasoning> lost"))) == "a b"


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id int, doc_id string, rank int")
    got = {r.doc_id: r for r in ranking.fuse([("dense", ranked("abc")), ("sparse", ranked("bde"))]).collect()}
    assert max(got, key=lambda k: got[k].rrf_score) == "b" and got["b"].rrf_score == pytest.approx(1 / 61 + 1 / 62)
    assert one(spark, ranking.confidence(F.lit(2 / 61))) == 1.0 and one(spark, ranking.confidence(F.lit(1 / 61))) == 0.5
    assert [one(spark, F.round(ranking.relevance_band(F.lit(x)), 9)) for x in (0.48, 0.54, 0.6)] == [0, 0.5, 1]


def test_guard(spark):
    evidence = spark.createDataFrame([("BNS", "103")], "act_short string, section_number string")
    answers = spark.createDataFrame(
        [(1, "He is liable. It is so [BNS s.103]. Bad [BNS s.9]."), (2, "He is liable.\nIt is so [BNS s.103].")], "answer_id int, text string"
    )
    got = {(r.answer_id, r.paragraph, r.seq): r.rule for r in grounding.guard(answers, evidence).collect()}
    assert got == {(1, 0, 0): "keep", (1, 0, 1): "keep", (1, 0, 2): "invalid_citation", (2, 0, 0): "uncited_claim", (2, 1, 0): "keep"}


def test_clean_page(spark):
    lines = spark.createDataFrame(
        [(1, 0, "20 THE GAZETTE OF INDIA EXTRAORDINARY"), (1, 1, "the sub-"), (1, 2, "registrar ( a) shall"), (1, 3, "46"), (1, 4, "end – here")],
        "doc_id int, line_no int, line string",
    )
    assert [r.line for r in structure.clean_page(lines).orderBy("line_no").collect()] == ["the sub-registrar (a) shall", "end - here"]


def test_chunk_pages(spark):
    docs = spark.createDataFrame([(1, "One. Two three.\n\nFour " + "x" * 30), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in structure.chunk_pages(docs, limit=16).orderBy("doc_id", "seq").collect()]
    assert got[0] == (1, "One. Two three.") and all(len(t) <= 16 for _, t in got) and {d for d, _ in got} == {1}


def test_lexical_scores(spark):
    q = spark.createDataFrame([("s", 1, "what is the notice period")], "session string, query_id int, text string")
    c = spark.createDataFrame([("s", "a", "notice period is short"), ("s", "b", "nothing"), ("t", "c", "notice period")], "session string, chunk_id string, text string")
    got = {r.chunk_id: r.score for r in sessions.lexical_scores(q, c, ["session"]).collect()}
    assert got == {"a": pytest.approx(1 / (1 + 0.01 * 3**0.5))}


def test_admission():
    assert state.admit([0, 1, 59.9, 60, 61], 60, 1) == [True, False, False, True, False]
    assert state.admit([0, 30, 61], 60, 2) == [True, True, True]


def test_rate_limit_stream(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    rows = "select id as event_id, 'k' as user, timestamp_seconds(1000 + id * 20) as ts from range(6)"
    spark.sql(rows).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("event_id long, user string, ts timestamp").parquet(str(source))
    q = (state.rate_limit_stream(stream, "user", limit=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start(str(sink)))
    q.awaitTermination(120)
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(sink)).collect()}
    batch = {r.event_id: r.allowed for r in state.rate_limit(spark.sql(rows), "user", 2).collect()}
    assert got == batch and sum(got.values()) == 4


def test_metrics_stream(spark, tmp_path):
    spark.sql("select timestamp_seconds(id * 60) as ts, 'view' as event_type, 1.0D as value from range(10)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = state.request_metrics_stream(stream).writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("m").groupBy().sum("n").first()[0] == 10


def test_inspect_page(spark):
    from folioscan.operators import workflow

    page = lambda *x: tuple(one(spark, workflow.inspect_page(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))))
    assert page("FORM No. 12", "(See section 4)", "BOND") == (12, "BOND", 1.0, True)
    assert page("a", "b", "FORM No.3", "BOND") == (3, "BOND", 0.8, True)
    assert page("FORM  No.  3") == (3, None, 0.6, True)
    assert page("a", "b", "c", "d", "e", "f", "FORM No. 1") == (None, None, 1.0, True)
    assert page() == (None, None, 0.0, False) and page(" ", "") == (None, None, 0.0, False)


def test_workflow_values(spark):
    from folioscan.operators import workflow

    assert one(spark, workflow.remaining_stages(F.lit("EMBEDDING"))) == ["INDEXING", "READY"]
    assert one(spark, workflow.remaining_stages(F.lit("FAILED"))) == [] and one(spark, workflow.remaining_stages(F.lit("READY"))) == []
    assert [one(spark, workflow.retry_delay(F.lit(i), F.lit(None).cast("double"))) for i in (1, 2, 5)] == [0.5, 1.0, 5.0]
    forms = spark.createDataFrame([(1, "Bond to keep the peace"), (2, "Peace bond kept"), (12, "Summons")], "form_number int, title string")
    asks = spark.createDataFrame([(1, "keep peace"), (2, "12"), (3, "the peace"), (4, "nothing here")], "query_id int, query string")
    got = {(r.query_id, r.form_number): r.score for r in workflow.search_forms(asks, forms).collect()}
    assert got == {(1, 1): 250, (2, 12): 1_000_000, (3, 1): 500_000, (3, 2): 150}


def test_visible_text_is_the_same_however_it_is_cut():
    whole = "a <think>x < y</think> b < c <Reasoning >lost< / reasoning> d <think"
    want = "a  b < c  d <think"
    for size in (1, 2, 3, 5, 8, 100):
        view = state.Visible()
        assert "".join(view.push(whole[i : i + size]) for i in range(0, len(whole), size)) + view.rest() == want


def test_streams_keep_state(spark, tmp_path):
    rows = [("s", 0, "a <thi"), ("s", 1, "nk>x</think"), ("s", 2, "> b")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "stream string, seq long, delta string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, seq long, delta string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (state.visible_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert "".join(r.shown for r in got) == "a  b"


def test_session_expires(spark, tmp_path):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:30", "2024-01-01 01:00:00", "2024-01-01 02:00:00"]
    for i, t in enumerate(times):
        s = "a" if i < 2 else "b"
        spark.sql(f"select '{s}' as session_id, 'd{i}' as document_id, timestamp '{t}' as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, document_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (state.session_stream(stream.withWatermark("ts", "0 seconds"), 60.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination(180)
    got = {(r.session_id, r.expired): r.n_documents for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n_documents").collect()}
    assert got[("a", False)] == 2 and got[("a", True)] == 2


def test_pages_are_packed(spark):
    from folioscan.operators.structure import _pieces

    assert _pieces("a\n\nb", 10) == ["a\n\nb"]
    assert _pieces("aaa\n\nbbb\n\ncccccc", 8) == ["aaa\n\nbbb", "cccccc"]
    assert _pieces("One two. Three four. " + "x" * 25, 12) == ["One two.", "Three four.", "x" * 12, "x" * 12, "x"]


def test_sinks(spark, tmp_path):
    from folioscan.sources import tables

    rows = [(f"c{i:03d}", "A", "BNS", None, None, str(i), None, None, None, "t" + str(i), False, False, False, 1, 1, "u", "x", [], False) for i in range(50)]
    chunks = spark.createDataFrame(rows, tables.CHUNK)
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    facts = {"source": "s", "embedder": "e", "ingested_at": "now"}
    search = lambda c, q: c.join(q, "text")
    path = tables.replace_corpus(chunks, vectors, str(tmp_path), "one", spark.createDataFrame([("t7",)], "text string"), search, **facts)
    points = spark.read.parquet(path + "/chunk_vectors")
    assert [(r.id, r.payload.chunk_id) for r in points.orderBy("id").collect()] == [(i + 1, f"c{i:03d}") for i in range(50)]
    manifest = spark.read.json(path + "/manifest").first()
    assert (manifest.chunks, manifest.sections, manifest.acts) == (50, 50, ["BNS"])
    with pytest.raises(ValueError):
        tables.replace_corpus(chunks, vectors, str(tmp_path), "two", spark.createDataFrame([("none",)], "text string"), search, **facts)
    assert spark.read.json(str(tmp_path / "_current")).first().current == "one"
    cached = vectors.withColumn("text_sha256", F.lit("h"))
    tables.write_vector_cache(cached, str(tmp_path / "cache"), "e1")
    tables.write_vector_cache(cached.limit(3), str(tmp_path / "cache"), "e2")
    assert tables.read_vector_cache(spark, str(tmp_path / "cache"), "e1").count() == 50 and tables.read_vector_cache(spark, str(tmp_path / "cache"), "e2").count() == 3
    with pytest.raises(Exception, match="EMBEDDING_MISMATCH"):
        tables.of_dimension(vectors, 3).count()
    with pytest.raises(Exception, match="not safe"):
        tables.upload_paths(spark.createDataFrame([("a", "../b")], "session_id string, document_id string"), "/x").collect()
