"""Failover: rules of a pool, the replay of a log, and its stream."""

import pytest
from pyspark.sql import functions as F

from folioscan.streaming import failover

PROVIDERS = [{"id": i, "priority": p, "enabled": i != "off", "is_default": d} for i, p, d in (("a", 2, False), ("b", 1, False), ("c", 3, False), ("off", 0, False))]
REQUESTS = "pool string, request_id long, ts timestamp, stream boolean, outcomes array<struct<provider string, error string, seconds double, emitted boolean>>"


def ask(pool, ts, errors=None, seconds=0.0, stream=False, emitted=False, robin=False, request=1, providers=PROVIDERS):
    outcomes = [{"provider": k, "error": v, "seconds": seconds, "emitted": emitted} for k, v in (errors or {}).items()]
    rows = pool.route({"request_id": request, "ts": ts, "stream": stream, "outcomes": outcomes}, providers, robin)
    return [(r["provider"], r["outcome"]) for r in rows]


def test_order_and_cooldowns():
    pool = failover.Pool()
    assert ask(pool, 0.0) == [("b", "ok")]
    assert ask(pool, 1.0, {"b": "rate_limit", "a": "permanent"}) == [("b", "rate_limit"), ("a", "permanent"), ("c", "ok")]
    assert ask(pool, 30.0) == [("c", "ok")]  # b cools 30 s, a 600 s
    assert ask(pool, 31.0, {"b": "timeout"}) == [("b", "timeout"), ("c", "ok")]
    assert pool.circuits["b"] == [2, 31.0 + 120.0, 31.0]  # the second failure in a row doubles the cooldown of its kind
    assert ask(pool, 151.0) == [("b", "ok")] and pool.circuits["b"][:2] == [0, 0.0]
    for n in range(12):
        until = pool.failed("b", "transient", 0.0)
    assert until == failover.COOLDOWN_MOST
    assert pool.failed("x", "what", 0.0) == 60.0


def test_all_cooling_tries_the_one_that_failed_longest_ago():
    pool = failover.Pool()
    for at, p in ((1.0, "c"), (2.0, "b"), (3.0, "a")):
        pool.failed(p, "permanent", at)
    assert ask(pool, 4.0, {"c": "transient"}) == [("c", "transient"), ("b", "ok")]
    assert ask(failover.Pool(), 0.0, providers=[]) == []


def test_deadline_streams_and_rotation():
    assert ask(failover.Pool(), 0.0, {"b": "transient", "a": "transient"}, seconds=50.0) == [("b", "transient"), ("a", "timeout")]
    assert ask(failover.Pool(), 0.0, {"b": None}, seconds=91.0) == [("b", "timeout"), ]
    assert ask(failover.Pool(), 0.0, {"b": "transient", "a": None}, seconds=95.0, stream=True) == [("b", "transient"), ("a", "ok")]
    assert ask(failover.Pool(), 0.0, {"b": "transient"}, stream=True, emitted=True) == [("b", "transient")]
    pool = failover.Pool()
    assert [ask(pool, float(t), robin=True)[0][0] for t in range(4)] == ["b", "a", "c", "b"]
    default = [p | {"is_default": p["id"] == "c"} for p in PROVIDERS]
    assert ask(failover.Pool(), 0.0, providers=default) == [("c", "ok")]


@pytest.fixture(scope="module")
def log(spark):
    kinds = ["rate_limit", "timeout", None, "permanent", None, "transient"]
    rows = [(None if i % 11 == 0 else f"p{i % 3}", i, 10.0 * (i // 2), i % 5 == 0, [(p, kinds[(i * k) % 6], float(i % 40), i % 2 == 0) for k, p in enumerate("abc", 1)]) for i in range(120)]
    requests = spark.createDataFrame([(a, b, t, s, o) for a, b, t, s, o in rows], REQUESTS.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    providers = spark.createDataFrame([(q, p["id"], p["priority"], p["enabled"], p["is_default"], q == "p1") for q in (None, "p0", "p1", "p2") for p in PROVIDERS],
                                      "pool string, id string, priority int, enabled boolean, is_default boolean, round_robin boolean")
    want = []
    for name in (None, "p0", "p1", "p2"):
        pool = failover.Pool()
        for a, b, t, s, o in sorted((r for r in rows if r[0] == name), key=lambda r: (r[2], r[1])):
            outcomes = [dict(zip(("provider", "error", "seconds", "emitted"), x)) for x in o]
            want += [(name, x["request_id"], x["attempt"], x["provider"], x["outcome"]) for x in pool.route({"request_id": b, "ts": t, "stream": s, "outcomes": outcomes}, PROVIDERS, name == "p1")]
    return requests, providers, sorted(map(repr, want))


def plain(rows):
    return sorted(repr((r.pool, r.request_id, r.attempt, r.provider, r.outcome)) for r in rows)


def test_replay(spark, log):
    requests, providers, want = log
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert plain(failover.replay(requests, providers).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert failover.replay(requests.where("false"), providers).count() == 0


def test_stream_agrees_with_the_log(spark, log, tmp_path):
    requests, providers, want = log
    for i in range(3):
        requests.where((F.floor((F.col("request_id")) / 40)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = failover.replay_stream(stream, providers).writeStream.format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert plain(spark.table("attempts").collect()) == want
