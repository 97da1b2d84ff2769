"""Stateful operators: admission, circuit breaking, job states, request metrics; batch and streaming.

Admission folds a key's events in order: its decisions depend on its earlier ones, so the fold is sequential by
nature, and keys are dealt over tasks. The streaming
forms keep the same state per key in the state store.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscan.operators.workflow import STAGES
from folioscan.shipping import ship


def admit(times: list[float], window: float, limit: int, held: deque | None = None) -> list[bool]:
    """Sliding-window admission in time order; what is rejected is not recorded."""
    recent = held if held is not None else deque()
    out = []
    for t in times:
        while recent and recent[0] <= t - window:
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out


def rate_limit(events: DataFrame, key: str, limit: int, window: float = 60.0) -> DataFrame:
    """(event_id, key, ts, allowed) of every event; ties in time by event_id.

    A key's events stand together and in order in one partition and stream through it: what is held is one batch
    and, of the current key, the admitted times within the window (``limit`` at most), however many events it has.
    """
    ship(events.sparkSession)
    out = f"event_id long, {key} {events.schema[key].dataType.simpleString()}, ts timestamp, allowed boolean"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for f in frames:
            seconds = f["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            allowed: list[bool] = []
            run = f[key].ne(f[key].shift()) & ~(f[key].isna() & f[key].shift().isna())
            run.iloc[:1] = True
            starts = [*run.to_numpy().nonzero()[0].tolist(), len(f)]
            for a, b in zip(starts, starts[1:]):
                k = None if pd.isna(f[key].iloc[a]) else f[key].iloc[a]
                if (k,) != current:
                    current, held = (k,), deque()
                allowed += admit(seconds[a:b].tolist(), window, limit, held)
            yield f.assign(allowed=allowed)

    ordered = events.select("event_id", key, "ts").repartition(key).sortWithinPartitions(key, "ts", "event_id")
    return ordered.mapInPandas(fold, out)


def rate_limit_stream(events: DataFrame, key: str, limit: int, window: float = 60.0) -> DataFrame:
    """Streaming admission: the admitted times of a key are its state and expire with the window.

    Events of a micro-batch are taken in time order; a key that is silent for a window is forgotten.
    """
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        seconds = f["ts"].astype("datetime64[us]").astype("int64") / 1e6
        f = f.assign(allowed=admit(seconds.tolist(), window, limit, held))
        state.update((list(held),))
        state.setTimeoutDuration(int(window * 1000))
        yield f[["event_id", key, "ts", "allowed"]]

    return events.select("event_id", key, "ts").groupBy(key).applyInPandasWithState(
        step, f"event_id long, {key} {kind}, ts timestamp, allowed boolean", "held array<double>",
        "append", GroupStateTimeout.ProcessingTimeTimeout,
    )


def circuit_breaker(events: DataFrame, key: str, failed: str, base: float = 60.0, most: float = 3600.0) -> DataFrame:
    """(event_id, key, failures, cooldown): consecutive failures so far and the cooldown they cause.

    A run of failures is an island between successes, so no fold is needed.
    """
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    run = Window.partitionBy(key, "__run").orderBy("ts", "event_id")
    bad = F.col(failed).cast("int")
    failures = F.sum(bad).over(run)
    cool = F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("failures") - 1), F.lit(most))
    return (
        events.withColumn("__run", F.sum(1 - bad).over(order)).withColumn("failures", failures)
        .withColumn("cooldown", F.when(F.col("failures") > 0, cool).otherwise(0.0)).select("event_id", key, "failures", "cooldown")
    )


def latest_status(events: DataFrame, key: str, status: str, seq: list[str]) -> DataFrame:
    """(key, status, n_events): the status of each job's last event."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*seq)).alias("status"), F.count("*").alias("n_events"))


def status_errors(events: DataFrame, key: str, status: str, seq: list[str]) -> DataFrame:
    """(key, status, before, error) of each job's events that can't follow the one before, null if none came before.

    A job begins as queued and goes one stage on at a time, or fails from any stage but the last; what has failed or is ready stays so.
    """
    order = Window.partitionBy(key).orderBy(*seq)
    stages = F.array(*[F.lit(s) for s in STAGES])
    place = lambda c: F.array_position(stages, c).cast("int")
    rows = events.withColumn("before", F.lag(status).over(order))
    now, was = F.col(status), F.col("before")
    error = (
        F.when((place(now) == 0) & (now != "FAILED"), "unknown").when(was.isNull(), F.when(now != STAGES[0], "begins late"))
        .when(was.isin("FAILED", STAGES[-1]), "after its end").when(now == "FAILED", None).when(place(now) != place(was) + 1, "skips or repeats")
    )
    return rows.withColumn("error", error).where("error is not null").select(key, *seq, status, "before", "error")


def request_metrics_stream(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Streaming counters and sums per window and event type; late events beyond the watermark are left out."""
    return (
        events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )


class Visible:
    """What of a streamed text may be shown: reasoning wrappers are left out, also where a tag comes in pieces.

    The tail that may still become a tag is held back; ``rest`` gives it up at the end.
    """

    TAG = r"<\s*(/?)\s*(think|thinking|reasoning)\s*>"
    #: The beginning of a tag, up to every length.
    OPENED = r"<\s*/?\s*[a-z]{0,9}\s*$"

    def __init__(self, held: str = "", inside: bool = False):
        self.held, self.inside = held, inside

    def push(self, delta: str) -> str:
        text, shown, at = self.held + delta, "", 0
        for m in re.finditer(self.TAG, text, re.I):
            closes = bool(m.group(1))
            if closes != self.inside:
                continue
            shown += "" if self.inside else text[at : m.start()]
            at, self.inside = m.end(), not closes
        tail = re.search(self.OPENED, text[at:], re.I)
        names = ("think", "thinking", "reasoning")
        word = re.sub(r"[^a-z]", "", tail.group().lower()) if tail else ""
        cut = at + tail.start() if tail and any(n.startswith(word) for n in names) else len(text)
        self.held = text[cut:]
        return shown + ("" if self.inside else text[at:cut])

    def rest(self) -> str:
        return "" if self.inside else self.held


def visible_deltas(deltas: DataFrame) -> DataFrame:
    """(stream, seq, shown) of (stream, seq, delta): what each piece of an answer adds to what is shown, in order.

    A stream's pieces stand together in one partition and run through it; what is held is a tag's length.
    """
    ship(deltas.sparkSession)
    kind = deltas.schema["stream"].dataType.simpleString()
    last = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("seq"))) == 1
    ordered = deltas.withColumn("last", last).repartition("stream").sortWithinPartitions("stream", "seq")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        view = Visible()
        for f in frames:
            shown = []
            for delta, last in zip(f["delta"], f["last"]):
                shown.append(view.push(delta or "") + (view.rest() if last else ""))
                view = Visible() if last else view
            yield f.assign(shown=shown)[["stream", "seq", "shown"]]

    return ordered.select("stream", "seq", "delta", "last").mapInPandas(fold, f"stream {kind}, seq {deltas.schema['seq'].dataType.simpleString()}, shown string")


def visible_stream(deltas: DataFrame) -> DataFrame:
    """The same on a stream of (stream, seq, delta): pieces of a batch in order of seq, a tag's beginning kept as state."""
    ship(deltas.sparkSession)
    kind = deltas.schema["stream"].dataType.simpleString()

    def fold(key, frames, kept: GroupState):
        view = Visible(*(kept.get if kept.exists else ("", False)))
        rows = sorted((r for f in frames for r in f[["seq", "delta"]].itertuples(index=False)), key=lambda r: r[0])
        shown = [(key[0], int(seq), view.push(delta or "")) for seq, delta in rows]
        kept.update((view.held, view.inside))
        yield pd.DataFrame(shown, columns=["stream", "seq", "shown"])

    return deltas.groupBy("stream").applyInPandasWithState(fold, f"stream {kind}, seq long, shown string", "held string, inside boolean", "append", GroupStateTimeout.NoTimeout)


def session_stream(changes: DataFrame, ttl: float) -> DataFrame:
    """(session_id, n_documents, expired) of a stream of (session_id, document_id, ts): a session's documents, gone ``ttl`` seconds after its last write.

    ``changes`` carries a watermark on ts; a session that expires gives one last row.
    """
    ship(changes.sparkSession)
    kind = changes.schema["session_id"].dataType.simpleString()

    def fold(key, frames, kept: GroupState):
        if kept.hasTimedOut:
            n = len(kept.get[0])
            kept.remove()
            yield pd.DataFrame({"session_id": [key[0]], "n_documents": [n], "expired": [True]})
            return
        held, newest = (set(kept.get[0]), kept.get[1]) if kept.exists else (set(), 0)
        for f in frames:
            held |= set(f["document_id"].astype(str))
            newest = max(newest, int(f["ts"].max().timestamp() * 1000))
        kept.update((sorted(held), newest))
        # A watermark that has passed the end already lets the session go with the next batch.
        kept.setTimeoutTimestamp(max(newest + int(ttl * 1000), kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "n_documents": [len(held)], "expired": [False]})

    return changes.groupBy("session_id").applyInPandasWithState(
        fold, f"session_id {kind}, n_documents long, expired boolean", "documents array<string>, newest long", "append", GroupStateTimeout.EventTimeTimeout
    )
