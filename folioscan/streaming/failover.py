"""Replay of provider failover over an event log: circuits with a cooldown for each kind of failure, and the attempts of every request.

A request tries the providers of its pool one after the other, each once: those that aren't cooling in their order, and only when all
of them cool, the one whose last failure is longest ago. What a request does depends on how earlier ones ended, so a pool's requests are
folded in order of time; pools are dealt over tasks, and what is held is one circuit per provider.

Cases: ties in time go by request id; a provider that a request's outcomes don't name answers at once; an unknown kind of failure
cools like "unknown"; a pool without enabled providers has no attempt and its requests aren't served; an empty log gives no rows; a null
pool is a pool of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscan.operators.workflow import COOLDOWNS
from folioscan.shipping import ship

#: Seconds that cooldowns never exceed, that a request may take over all attempts, and that an attempt gets at least.
COOLDOWN_MOST, DEADLINE, ATTEMPT_LEAST = 3600.0, 90.0, 1.0

_ATTEMPT = "request_id long, attempt int, provider string, outcome string, at double, cooling_until double, served boolean"


class Pool:
    """Circuits of a pool's providers: {id: [failures in a row, cooling until, last failure]}, and how far round-robin has come."""

    def __init__(self, circuits: dict | None = None, rotation: int = 0):
        self.circuits, self.rotation = circuits or {}, rotation

    def order(self, providers: list[dict], now: float) -> list[str]:
        """Provider ids in the order in which they would be tried now."""
        ids = [p["id"] for p in sorted((p for p in providers if p["enabled"]), key=lambda p: (not p["is_default"], p["priority"], p["id"]))]
        turn = self.rotation % len(ids) if ids else 0
        ids = ids[turn:] + ids[:turn]
        ready = [i for i in ids if now >= self.circuits.get(i, (0, 0.0, None))[1]]
        return ready or sorted(ids, key=lambda i: self.circuits.get(i, (0, 0.0, None))[2] or 0.0)

    def failed(self, provider: str, kind: str, now: float) -> float:
        n = self.circuits.get(provider, (0,))[0] + 1
        until = now + min(COOLDOWNS.get(kind, COOLDOWNS["unknown"]) * 2.0 ** (n - 1), COOLDOWN_MOST)
        self.circuits[provider] = [n, until, now]
        return until

    def succeeded(self, provider: str) -> None:
        self.circuits[provider] = [0, 0.0, self.circuits.get(provider, (0, 0.0, None))[2]]

    def route(self, request: dict, providers: list[dict], round_robin: bool) -> list[dict]:
        """The attempts of a request: one row each, the last tells whether it was served."""
        now, rows, tried = request["ts"], [], set()
        until = now + DEADLINE
        outcomes = {o["provider"]: o for o in request["outcomes"] or []}
        while ready := [i for i in self.order(providers, now) if i not in tried]:
            provider, left = ready[0], until - now
            if tried and left <= 0 and not request["stream"]:
                break
            tried.add(provider)
            o = outcomes.get(provider) or {"error": None, "seconds": 0.0, "emitted": False}
            error, seconds = o["error"], o["seconds"] or 0.0
            if not request["stream"] and seconds > max(left, ATTEMPT_LEAST):
                error, seconds = "timeout", max(left, ATTEMPT_LEAST)
            now += seconds
            cooling = self.failed(provider, error, now) if error else self.succeeded(provider)
            rows.append({"request_id": request["request_id"], "attempt": len(rows) + 1, "provider": provider, "outcome": error or "ok", "at": now, "cooling_until": cooling, "served": not error})
            # What a stream has shown can't be taken back, so it doesn't go on elsewhere.
            if not error or request["stream"] and o["emitted"]:
                break
        if rows and rows[-1]["served"]:
            self.rotation += round_robin
        return rows


def _log(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Requests with the providers of their pool, ``ts`` in seconds."""
    own = providers.groupBy(F.col("pool").alias("__p")).agg(
        F.collect_list(F.struct("id", "priority", "enabled", "is_default")).alias("providers"), F.bool_or(F.coalesce("round_robin", F.lit(False))).alias("round_robin"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = requests.select("pool", "request_id", seconds.alias("ts"), F.coalesce("stream", F.lit(False)).alias("stream"), "outcomes")
    return rows.join(own, F.col("pool").eqNullSafe(F.col("__p"))).drop("__p")


def replay(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """(pool, request_id, attempt, provider, outcome, at, cooling_until, served) of every attempt.

    ``requests`` has (pool, request_id, ts, stream, outcomes array<struct<provider, error, seconds, emitted>>): what each provider would answer, error null
    for success. ``providers`` has (pool, id, priority, enabled, is_default, round_robin).
    """
    ship(requests.sparkSession)
    out = T.StructType([T.StructField("pool", requests.schema["pool"].dataType), *T._parse_datatype_string(_ATTEMPT).fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, pool, name = to_arrow_schema(out), None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if pool is None or r["pool"] != name:
                    pool, name = Pool(), r["pool"]
                rows += [{"pool": name} | a for a in pool.route(r, r["providers"], r["round_robin"])]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _log(requests, providers).repartition("pool").sortWithinPartitions("pool", "ts", "request_id").mapInArrow(fold, out)


def replay_stream(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """The same on a stream of requests; circuits are the state of their pool, and a batch's requests go in order of time."""
    ship(requests.sparkSession)
    kind = requests.schema["pool"].dataType.simpleString()
    columns = ["pool", *(f.name for f in T._parse_datatype_string(_ATTEMPT).fields)]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = Pool()
        if state.exists:
            ids, failures, until, failed, rotation = state.get
            pool = Pool({i: [n, u, None if f < 0 else f] for i, n, u, f in zip(ids, failures, until, failed)}, rotation)
        rows = []
        plain = lambda xs: [x if isinstance(x, dict) else x.asDict() for x in xs] if xs is not None else []
        for r in pd.concat(list(frames)).sort_values(["ts", "request_id"]).to_dict("records"):
            rows += [{"pool": key[0]} | a for a in pool.route(r | {"outcomes": plain(r["outcomes"])}, plain(r["providers"]), bool(r["round_robin"]))]
        held = sorted(pool.circuits.items())
        state.update(([i for i, _ in held], [c[0] for _, c in held], [c[1] for _, c in held], [-1.0 if c[2] is None else c[2] for _, c in held], pool.rotation))
        yield pd.DataFrame(rows, columns=columns)

    return _log(requests, providers).groupBy("pool").applyInPandasWithState(
        step, f"pool {kind}, {_ATTEMPT}", "ids array<string>, failures array<int>, until array<double>, failed array<double>, rotation int", "append", GroupStateTimeout.NoTimeout)
