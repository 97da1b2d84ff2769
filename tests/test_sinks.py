"""Metrics text, deleted documents, job states, prompt echoes, session search: cases by value."""

from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators import sessions
from folioscan.sources import exposition, tables
from folioscan.streaming import state


def test_numbers(spark):
    values = [0.0, -0.0, 1.0, 60.0, 0.005, 1e-05, 123456.0, 1234567.0, 2.5, 908416.5, float("nan"), float("inf"), -float("inf"), 1e300, -0.00012345678]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, v double").orderBy("i")
    assert [r[0] for r in rows.select(exposition.general(F.col("v"))).collect()] == [f"{v:g}" for v in values] + [None]


def test_exposition(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.2), ("a", 0.7), ('b"\\\n', 100.0), ("c", None)], "route string, v double")
    n = spark.createDataFrame([(2,)], "n int")
    metrics = [exposition.expose_histogram(rows, "latency", "How long.", ["route"], "v", (0.5, 60.0)), exposition.expose_values(n, "asked_total", "Questions.", [], "n"),
               exposition.expose_histogram(rows.where("route = 'a'"), "whole", "All.", [], "v", (1.0,)), exposition.expose_values(n.where("false"), "none", "Nothing.", [], "n", "gauge")]
    exposition.write_exposition(metrics, str(tmp_path / "m"))
    got = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert got == [
        "# HELP asked_total Questions.", "# TYPE asked_total counter", "asked_total 2",
        "# HELP latency How long.", "# TYPE latency histogram", 'latency_bucket{route="a",le="0.5"} 1', 'latency_bucket{route="a",le="60"} 2', 'latency_bucket{route="a",le="+Inf"} 2',
        'latency_count{route="a"} 2', 'latency_sum{route="a"} 0.9', r'latency_bucket{route="b\"\\\n",le="0.5"} 0', r'latency_bucket{route="b\"\\\n",le="60"} 0', r'latency_bucket{route="b\"\\\n",le="+Inf"} 1',
        r'latency_count{route="b\"\\\n"} 1', r'latency_sum{route="b\"\\\n"} 100', "# HELP none Nothing.", "# TYPE none gauge",
        "# HELP whole All.", "# TYPE whole histogram", 'whole_bucket{le="1"} 2', 'whole_bucket{le="+Inf"} 2', "whole_count 2", "whole_sum 0.9",
    ]


def test_forgotten_documents(spark):
    chunks = spark.createDataFrame([("s", "d-p1"), ("s", "d-x-p1"), ("s", "dd-p1"), ("t", "d-p1"), ("s", "e-p1"), ("s", "odd")], "session_id string, chunk_id string")
    owned = spark.createDataFrame([("s", "e", "e-p1")], "session_id string, document_id string, chunk_id string")
    gone = spark.createDataFrame([("s", "d"), ("s", "e")], "session_id string, document_id string")
    assert sorted(map(tuple, tables.forget_documents(chunks, owned, gone).collect())) == [("s", "dd-p1"), ("s", "odd"), ("t", "d-p1")]
    assert tables.forget_documents(chunks, owned, gone.where("false")).count() == 6


def test_job_states(spark):
    steps = {1: ["QUEUED", "PARSING", "CHUNKING", "EMBEDDING", "INDEXING", "READY"], 2: ["QUEUED", "PARSING", "FAILED"], 3: ["PARSING"], 4: ["QUEUED", "CHUNKING", "CHUNKING", "LOST"], 5: ["QUEUED", "FAILED", "QUEUED"]}
    rows = spark.createDataFrame([(k, i, s) for k, v in steps.items() for i, s in enumerate(v)], "job int, seq int, status string")
    got = sorted((r.job, r.seq, r.error) for r in state.status_errors(rows, "job", "status", ["seq"]).collect())
    assert got == [(3, 0, "begins late"), (4, 1, "skips or repeats"), (4, 2, "skips or repeats"), (4, 3, "unknown"), (5, 2, "after its end")]


def test_echoes(spark):
    prompt = "Rules:  keep to the passages\nand cite every one of them by its label, in square brackets, at the end of the sentence."
    rows = ["so: --- statute   EVIDENCE", "KEEP TO the passages and cite every one of them by its label, in square brackets", "keep to the passages", "here is a thinking process", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(text.echoes(F.col("t"), prompt)).collect()] == [True, True, False, True, False]
    assert not df.select(text.echoes(F.lit("short"), "short")).first()[0]


def test_session_search(spark):
    chunks = spark.createDataFrame([("s", "a", "a-p1", "rent is due monthly"), ("s", "b", "b-p1", "the court ruled on rent arrears"), ("s", "b", "b-p2", "nothing more"), ("t", "c", "c-p1", "rent of another session")],
                                   "session_id string, document_id string, chunk_id string, text string")
    docs = spark.createDataFrame([("s", "b", "b.pdf", 1), ("s", "a", "a.pdf", 2)], "session_id string, document_id string, filename string, created_at int")
    q = spark.createDataFrame([("s", 1, "rent arrears"), ("s", 2, "zzqx"), ("s", 3, "zzqx"), ("u", 4, "rent")], "session_id string, query_id int, text string")
    scope = spark.createDataFrame([(2, "b")], "query_id int, document_id string")
    got = sessions.search(q, chunks, docs, scope).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.place, r.chunk_id, r.filename, r.position) for r in got] == [(1, 1, "b-p1", "b.pdf", 1), (1, 2, "a-p1", "a.pdf", 2), (2, 1, "b-p1", "b.pdf", 1), (2, 2, "b-p2", "b.pdf", 1)]
    assert all(r.score == 0.0 for r in got if r.query_id == 2) and got[0].score >= got[1].score > 0
