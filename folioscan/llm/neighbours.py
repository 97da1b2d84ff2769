"""Approximate nearest neighbours: a forest of sorted hash strings, ascended synchronously.

Every tree has a string of ``BITS`` random-hyperplane bits for each vector, and is the sorted array of
these strings. A query descends each tree by a binary search to the string that shares the longest prefix with its own, and begins at the
longest of all trees. From there all trees ascend together, over the lengths of ``LEVELS`` that are shorter: at prefix length x the
candidates are the vectors that share x bits with the query in some tree. Candidates are measured exactly, in double precision. A query stops
ascending once the chance that a vector as near as its current last place shares no
prefix of length x in any tree falls below ``MISS``; at length 0 every vector is a candidate, so
sparse regions and small tables end exact.

The forest is dealt over blocks of vectors, each with trees of its own, and queries over blocks of
queries; each pair of blocks is a task, whose result is the block's best for each query. Blocks have
bounded sizes, so a task's memory doesn't grow with the table, and no vector depends on another
block's presence. Equal vectors share one entry with their ``k + 1`` smallest ids, which is all that
a top k can name, so a vector with a third of all rows is one candidate.

Cases: vectors that are null, empty, zero or hold a null or non-finite component neither ask nor
answer; vectors of another dimension than the query's are no candidates; an id's repeated rows
count once, by their best score; fewer candidates than k give as many rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import materialize
from folioscan.shipping import ship

TREES = 16
BITS = 48
LEVELS = (40, 32, 24, 18, 14, 11, 9, 7, 6, 5, 4, 3, 2, 1, 0)
_LADDER = np.array(LEVELS[::-1])
MISS = 0.01
BLOCK = 4096
QUERY_BLOCK = 4096
SALT = 32


def usable(v: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


class Forest:
    """Sorted hash strings of a block of vectors."""

    def __init__(self, x: np.ndarray, seed: int = 17):
        self.planes = np.random.default_rng(seed).normal(size=(x.shape[1], TREES * BITS))
        self.x, self.norm = x, np.sqrt((x * x).sum(1))
        strings = self.strings(x / self.norm[:, None])
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Bits of each tree, first bit highest: (trees, vectors)."""
        bits = (x @ self.planes > 0).reshape(len(x), TREES, BITS)
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return (bits * weights).sum(2, dtype=np.uint64).T

    def longest(self, strings: np.ndarray) -> np.ndarray:
        """For each query the bits of the longest prefix that it shares with a string of any tree: the neighbours of its place in the order have it."""
        best = np.zeros(strings.shape[1], np.int64)
        for held, own in zip(self.sorted, strings):
            at = np.searchsorted(held, own)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(held) - 1)):
                differ = held[near] ^ own
                best = np.maximum(best, BITS - np.frexp(differ.astype(np.float64))[1])
        return best

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and cosines of all it has measured, nearest first, k at least if there are."""
        norms = np.sqrt((queries * queries).sum(1))
        strings = self.strings(queries / norms[:, None])
        n, m = len(self.x), len(queries)
        seen = np.zeros((m, n), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * m
        active, depth = np.arange(m), self.longest(strings)
        while len(active):
            drop = (BITS - depth).astype(np.uint64)
            low = strings[:, active] >> drop << drop
            high = low + (np.uint64(1) << drop)
            begin = np.stack([np.searchsorted(s, q) for s, q in zip(self.sorted, low)])
            end = np.stack([np.searchsorted(s, q) for s, q in zip(self.sorted, high)])
            still = []
            for j, (q, level) in enumerate(zip(active.tolist(), depth.tolist())):
                fresh = np.zeros(n, bool)
                if level:
                    for t in range(TREES):
                        fresh[self.order[t, begin[t, j] : end[t, j]]] = True
                else:
                    fresh[:] = True
                fresh &= ~seen[q]
                at = np.flatnonzero(fresh)
                if len(at):
                    seen[q] |= fresh
                    score = (self.x[at] * queries[q]).sum(1) / (self.norm[at] * norms[q])
                    at, score = np.concatenate([found[q][0], at]), np.concatenate([found[q][1], score])
                    best = np.argsort(-score, kind="stable")[: k + 1] if len(at) > k + 1 else np.argsort(-score, kind="stable")
                    # Ties with the last place stay: ids decide later.
                    if len(at) > k + 1:
                        best = np.concatenate([best, np.setdiff1d(np.flatnonzero(score == score[best[-1]]), best)])
                    found[q] = (at[best], score[best])
                if level and len(found[q][0]) > k:
                    agree = 1 - np.arccos(np.clip(found[q][1][k], -1, 1)) / np.pi
                    if (1 - agree**level) ** TREES <= MISS:
                        continue
                if level:
                    still.append(j)
            # The next level is the longest of the ladder that is shorter than the one at hand.
            active, depth = active[still], _LADDER[np.searchsorted(_LADDER, depth[still]) - 1]
        return found


def _searcher(k: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        asks = pdf["ids"].isna().to_numpy()
        if asks.all() or not asks.any():
            return empty
        stack = lambda s: np.stack([np.asarray(v, np.float64) for v in s])
        points, queries = pdf[~asks], pdf[asks]
        ids = [np.asarray(v) for v in points["ids"]]
        names = queries["id"].to_numpy()
        q_out, v_out, s_out = [], [], []
        for name, (at, score) in zip(names, Forest(stack(points["v"])).search(stack(queries["v"]), k)):
            best = sorted((-s, int(i)) for p, s in zip(at, score) for i in ids[p] if i != name)[:k]
            q_out += [name] * len(best)
            v_out += [i for _, i in best]
            s_out += [-s for s, _ in best]
        return pd.DataFrame({"query_id": q_out, "vec_id": v_out, "score": s_out}) if q_out else empty

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that asks, against all others."""
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).distinct()
    # The k + 1 smallest ids of each vector: first by salted parts, then of what these leave.
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALT))).orderBy("vec_id")
    ranked = rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    whole = Window.partitionBy("v").orderBy("vec_id")
    least = ranked.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    points = materialize(least.groupBy("v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = materialize(rows.where("asks").select("v", F.col("vec_id").alias("id")))
    n_points, n_queries = points.count(), queries.count()
    p_blocks, q_blocks = max(1, -(-n_points // block)), max(1, -(-n_queries // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = points.select(deal(p_blocks).alias("p"), every(q_blocks).alias("q"), F.size("v").alias("d"), "id", "ids", "v").union(
        queries.select(every(p_blocks).alias("p"), deal(q_blocks).alias("q"), F.size("v").alias("d"),
                       "id", F.lit(None).cast("array<bigint>").alias("ids"), "v"))
    found = dealt.groupBy("p", "q", "d").applyInPandas(_searcher(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
