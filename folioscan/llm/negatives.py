"""Hard-negative mining over a vector-approximation file.

Vectors become whole numbers and a score is their inner product with an anchor. Each block of vectors has an
approximation file: every dimension is cut into ``CELLS`` cells of about equal numbers of vectors, and a vector
is the list of its cells. For an anchor, a table per pair of dimensions has the least and the greatest
contribution of each pair of cells; looked up and added they bound every vector's score from both sides. Only vectors whose
bounds leave them a chance are scored exactly: for positives those that reach the k-th best lower
bound, for negatives those that may lie in the window of scores and reach the k-th best lower bound of those that surely do.

Vectors and anchors are dealt in blocks of bounded size; each pair of blocks is a task, which returns at most k rows
for an anchor or window, and a window function takes the best of all blocks. The anchors are a stated share of the
rows, so no task ever holds more than a block of either.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
another dimension than the anchor's answer nothing; exactly repeated rows count once; other rows of an anchor's id
are not its positives or negatives; an id's differing rows are anchors of their own; fewer candidates than asked for give as
many rows; scores beyond 64 bits are cut to that range; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import materialize
from folioscan.shipping import ship

CELLS = 32
BLOCK = 8192
ANCHOR_BLOCK = 2048
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90

_LONG = np.iinfo(np.int64)


def usable(v: Column) -> Column:
    """A vector whose components are all finite numbers."""
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class ApproximationFile:
    """Cells of a block's vectors, with bounds and exact scores by whole-number arithmetic."""

    def __init__(self, x: np.ndarray, cells: int = CELLS):
        self.x, (n, d) = x, x.shape
        self.pairs = -(-d // 2)
        code = np.zeros((n, 2 * self.pairs), np.int64)
        self.low, self.high = np.zeros((2, 2 * self.pairs, cells), np.int64)
        order = np.argsort(x, axis=0, kind="stable")
        for j in range(d):
            values = x[order[:, j], j]
            cuts = np.unique(values[np.arange(1, cells) * n // cells])
            cell = np.searchsorted(cuts, values, "right")
            code[order[:, j], j] = cell
            there, first = np.unique(cell, return_index=True)
            last = np.append(first[1:], n) - 1
            self.low[j, there], self.high[j, there] = values[first], values[last]
        joint = code[:, 0::2] * cells + code[:, 1::2]
        self.at = joint + np.arange(self.pairs) * cells * cells
        self.most = np.abs(x).max(axis=0, initial=0).astype(object)

    def kind(self, anchor: np.ndarray):
        """Whole numbers of 64 bits while no sum can leave them, else Python's."""
        return np.int64 if int((np.abs(anchor.astype(object)) * self.most).sum()) < 2**62 else object

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each vector's cells allow."""
        q = np.zeros(2 * self.pairs, self.kind(anchor))
        q[: len(anchor)] = anchor
        a, b = self.low * q[:, None], self.high * q[:, None]
        tables = [m[0::2, :, None] + m[1::2, None, :] for m in (np.minimum(a, b), np.maximum(a, b))]
        return tuple(t.reshape(-1)[self.at].sum(axis=1) for t in tables)

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        kind = self.kind(anchor)
        return self.x[at].astype(kind) @ anchor.astype(kind)

    def best(self, anchor: np.ndarray, may: np.ndarray, ids: np.ndarray, k: int, bounds) -> list[tuple[int, int]]:
        """(id, score) of the k highest among the vectors that may."""
        least, most = bounds
        at = np.flatnonzero(may)
        if len(at) > k:
            at = at[most[at] >= np.partition(least[at], len(at) - k)[len(at) - k]]
        return _first(ids[at], self.exact(anchor, at), k)

    def window(self, anchor: np.ndarray, may: np.ndarray, ids: np.ndarray, k: int, bounds, positive: int, low: int = LOW, high: int = HIGH) -> list[tuple[int, int]]:
        """(id, score) of the k highest with low * positive <= 100 * score <= high * positive among the vectors that may."""
        low, high = -(-low * positive // 100), high * positive // 100
        least, most = bounds
        at = np.flatnonzero(may & (most >= low) & (least <= high))
        sure = least[at][(least[at] >= low) & (most[at] <= high)]
        if len(sure) > k:
            at = at[most[at] >= np.partition(sure, len(sure) - k)[len(sure) - k]]
        score = self.exact(anchor, at)
        inside = (score >= low) & (score <= high)
        return _first(ids[at[inside]], score[inside], k)


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    if score.dtype == object:
        score = np.clip(score, _LONG.min, _LONG.max).astype(np.int64)
    order = np.lexsort((ids, ~score))[:k]
    return list(zip(ids[order].tolist(), score[order].tolist()))


def _vectors(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, d)


def _miner(k: int, negatives: bool):
    """Of a block of vectors and a block of anchors: the k best of each anchor's own label, or of the others in each of its windows."""

    def mine(rows: pa.Table) -> pa.Table:
        out = {"a": [], "positive_score": [], "id": [], "score": []}
        points, anchors = rows.filter(rows.column("a").is_null()), rows.filter(rows.column("a").is_valid())
        if points.num_rows and anchors.num_rows:
            d = rows.column("d")[0].as_py()
            x, ids, label = _vectors(points.column("x"), d), points.column("id").to_numpy(), points.column("label").to_numpy()
            asks = zip(anchors.column("a").to_pylist(), _vectors(anchors.column("x"), d), anchors.column("id").to_pylist(), anchors.column("label").to_pylist(), anchors.column("scores").to_pylist())
            if negatives:
                files = {None: (ApproximationFile(x), ids, label)}
            else:
                files = {y: (ApproximationFile(x[label == y]), ids[label == y], label[label == y]) for y in np.unique(label).tolist()}
            for a, q, own, y, scores in asks:
                if (key := None if negatives else y) not in files:
                    continue
                file, names, labels = files[key]
                bounds, may = file.bounds(q), (names != own) & ((labels != y) if negatives else True)
                for positive in scores if negatives else [None]:
                    found = file.window(q, may, names, k, bounds, positive) if negatives else file.best(q, may, names, k, bounds)
                    for name, score in found:
                        for c, v in zip(out, (a, positive, name, score)):
                            out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return mine


def _met(points: DataFrame, anchors: DataFrame, blocks: tuple[int, int], k: int, negatives: bool) -> DataFrame:
    """Every block of vectors with every block of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    p, q = blocks
    null = F.lit(None)
    dealt = points.select(deal("a", p).alias("p"), every(q).alias("q"), "d", null.cast("long").alias("a"), "id", "label", "x", null.cast("array<bigint>").alias("scores")).union(
        anchors.select(every(p).alias("p"), deal("a", q).alias("q"), "d", "a", "id", "label", "x", "scores"))
    return dealt.groupBy("p", "q", "d").applyInArrow(_miner(k, negatives), "a long, positive_score long, id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``vec_id``, ``label`` and ``embedding``."""
    ship(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(usable(v) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    whole = F.transform(v, lambda x: F.floor(x * 256))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("x"), is_anchor.alias("asks")).distinct()
    points = materialize(rows.select(F.monotonically_increasing_id().alias("a"), F.size("x").alias("d"), "*"))
    anchors = points.where("asks")
    blocks = max(1, -(-points.count() // block)), max(1, -(-anchors.count() // anchor_block))

    found = _met(points, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), blocks, positives, False)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    pairs = materialize(best.select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    windows = pairs.groupBy("a").agg(F.collect_set("positive_score").alias("scores"))  # at most ``positives``
    found = _met(points, anchors.join(windows, "a"), blocks, negatives, True)
    order = Window.partitionBy("a", "positive_score").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = anchors.select("a", F.col("id").alias("anchor_id"))
    return best.join(pairs, ["a", "positive_score"]).join(names, "a").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
