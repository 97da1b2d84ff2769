"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 4-word shingles, XXH64 with seed 42, a bit is 1 where over half the hashes have it.
Equal fingerprints collapse first, so a group of exact copies is one row. Pairs at 4 or fewer
differing bits agree wholly on at least one of 5 blocks of bits, so fingerprints are dealt by
(block, bits of the block), which loses no link. Each dealt group is indexed hierarchically:
fingerprints sorted by Gray rank, every node holding the bits that all fingerprints below it share,
factored out of its children. Two nodes are compared by the differences of their shared bits; a
pair of groups is pruned as soon as the accumulated differences pass the limit, or once both sides are
already connected, so near copies in thousands do not become pairs in millions.

A dealt group beyond ``LIMIT`` members is cut, in Gray order of the whole group, into pages of
bounded size; pages are indexed alone first, then only members of different components meet:
those outside the group's largest component are sent to all of its pages. Links found are edges of a
spanning forest of each group, never all pairs.

Cases: null and empty texts have fingerprint zero and link like any other; repeated rows get their
fingerprint's component; a null doc_id takes part and never names a component unless it is alone;
no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_texts, materialize
from folioscan.llm.components import components
from folioscan.shipping import ship

WORDS = 4
DIFFER = 4
LIMIT = 2000
FAN = 8
#: Groups up to this size are one leaf of the index.
LEAF = 24
#: Bit ranges (from, width) of the 5 blocks.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a UTF-8 text."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = np.concatenate(([0], ends[: len(tokens) - words] + 1)).tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    step = 1 << 15
    for at in range(0, len(stops), step):
        hashes = b"".join([digest(joined[b:e], 42) for b, e in zip(begins[at : at + step], stops[at : at + step])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    value = 0
    for bit in (counts * 2 > len(stops)).tolist():
        value = value << 1 | bit
    return value


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``fp``, the fingerprint as a signed long."""

    def setup():
        def compute(texts, _):
            return {"fp": [f - (1 << 64) if (f := fingerprint(t)) >> 63 else f for t in texts]}

        return compute

    return map_texts(docs, list(keep), setup, "fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray sequence."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class _Forest:
    """Union-find over positions, smallest position as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = lo != hi
            if not open_.any():
                return
            np.minimum.at(self.root, hi[open_], lo[open_])
            self.settle()
            a, b = a[open_], b[open_]


def gray_links(fp: np.ndarray, differ: int = DIFFER, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) that connect all fingerprints of a group at ``differ`` bits or fewer.

    ``known``: components already found elsewhere; links within one are left out.
    """
    order = np.argsort(gray_rank(fp), kind="stable")
    sorted_ = fp[order]
    n = len(fp)
    forest = _Forest(n)
    if known is not None:
        _, label = np.unique(known[order], return_inverse=True)
        first = np.full(label.max() + 1, n)
        np.minimum.at(first, label, np.arange(n))
        forest.root = first[label]
    start = forest.root.copy()
    # Neighbours in Gray order first: most of a group of near copies is connected by these alone.
    for gap in (1, 2, 3):
        if n > gap:
            near = np.flatnonzero(np.bitwise_count(sorted_[gap:] ^ sorted_[:-gap]) <= differ)
            forest.link(near, near + gap)
    levels = [(sorted_, np.full(n, ~np.uint64(0)), np.arange(n))]
    while len(levels[-1][0]) > 1:
        pattern, mask, _ = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        ones = np.bitwise_and.reduceat(pattern & mask, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        levels.append((ones, ones | zeros, at))

    def uniform(level: int) -> np.ndarray:
        """The component of each node's members, -1 where they have several."""
        own = forest.root
        for _ in range(level):
            at = np.arange(0, len(own), FAN)
            lo, hi = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
            own = np.where((lo == hi) & (lo >= 0), lo, -1)
        return own

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        pattern, mask, _ = levels[level]
        same = uniform(level)
        # By pieces, so that what one piece connects prunes the next.
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            apart = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= differ
            apart &= (same[x] != same[y]) | (same[x] < 0)
            x, y = x[apart], y[apart]
            if level == 0:
                forest.link(x, y)
                same = forest.root
            elif len(x):
                below = len(levels[level - 1][0])
                kids = np.arange(FAN)
                cx = np.repeat((x[:, None] * FAN + kids), FAN, axis=1).ravel()
                cy = np.tile((y[:, None] * FAN + kids), (1, FAN)).ravel()
                ok = (cx < below) & (cy < below) & (cx <= cy if level > 1 else cx < cy)
                descend(level - 1, cx[ok], cy[ok])
                same = uniform(level)

    top = len(levels) - 1
    if top:
        descend(top, np.zeros(1, np.int64), np.zeros(1, np.int64))
    # One edge for each component that joined another.
    forest.settle()
    heads = np.flatnonzero(start == np.arange(n))
    joined = heads[forest.root[heads] != heads]
    return order[joined], order[forest.root[joined]]


def _linker(known: bool):
    """Links of a batch of groups; groups no larger than a leaf are compared within it, all at once."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "bits", "page"], kind="stable")
        values = pdf["fp"].to_numpy().astype(np.int64)
        fp = values.view(np.uint64)
        keys = pdf[["block", "bits", "page"]].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        sizes = np.diff(np.append(starts, len(fp)))
        own = np.repeat(np.arange(len(starts)), sizes)
        root = pdf["root"].to_numpy() if known else values
        leaf = sizes[own] <= LEAF
        forest = _Forest(len(fp))
        for gap in range(1, int(min(LEAF, sizes.max()))):
            near = leaf[gap:] & (own[gap:] == own[:-gap]) & (root[gap:] != root[:-gap])
            near &= np.bitwise_count(fp[gap:] ^ fp[:-gap]) <= DIFFER
            at = np.flatnonzero(near)
            forest.link(at, at + gap)
        linked = np.flatnonzero(forest.root != np.arange(len(fp)))
        a, b = [linked], [forest.root[linked]]
        for k in np.flatnonzero(sizes > LEAF):
            lo, hi = starts[k], starts[k] + sizes[k]
            x, y = gray_links(fp[lo:hi], known=root[lo:hi] if known else None)
            a.append(x + lo)
            b.append(y + lo)
        return pd.DataFrame({"a": values[np.concatenate(a)], "b": values[np.concatenate(b)]})

    return link


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    ship(distinct.sparkSession)
    block = F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("bits"),
            )
            for i, (at, width) in enumerate(BLOCKS)
        ]
    )
    dealt = materialize(distinct.select("fp", F.explode(block).alias("k")).select("fp", "k.*"))
    sizes = dealt.groupBy("block", "bits").agg(F.count("*").alias("n")).where("n > 1")
    keyed = dealt.join(sizes, ["block", "bits"])
    # Pages: runs of leading Gray-rank bits would gather near copies; a hash spreads them evenly.
    paged = keyed.withColumn("pages", F.ceil(F.col("n") / limit)).withColumn(
        "page", F.pmod(F.xxhash64("fp"), F.col("pages"))
    )
    edge = "a long, b long"
    # Most groups are tiny; they reach Python in batches of about ``limit`` rows, whatever their number.
    batches = max(1, -(-dealt.count() // limit))
    batch = F.pmod(F.xxhash64("block", "bits", "page"), F.lit(batches))
    first = materialize(paged.select("block", "bits", "page", "fp").groupBy(batch.alias("batch"))
                        .applyInPandas(_linker(False), edge))
    large = paged.where("pages > 1")
    if large.isEmpty():
        return first
    roots = components(first)
    named = large.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "block", "bits", "page", "pages", "fp", F.coalesce("root", "fp").alias("root")
    )
    named = materialize(named)
    counts = named.groupBy("block", "bits", "root").agg(F.count("*").alias("m"))
    largest = counts.groupBy("block", "bits").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("k"))
    mixed = named.join(largest.where("k > 1"), ["block", "bits"])
    stays = mixed.where("root = main").select("block", "bits", "page", "fp", "root")
    goes = mixed.where("root <> main").select(
        "block", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)).alias("page"), "fp", "root"
    )
    second = stays.union(goes).groupBy(batch.alias("batch")).applyInPandas(_linker(True), edge)
    return first.union(materialize(second))


def _grouped(docs: DataFrame, keep: tuple[str, ...], limit: int = LIMIT) -> DataFrame:
    """``keep`` columns of every document with fp, component_id and __root, the fingerprint that names its component."""
    names = [c for c in keep if c != "doc_id"]
    marked = materialize(fingerprints(docs, ("doc_id", *names)))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), limit))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id", F.col("root").alias("__root"))
    return marked.join(of_fp, F.col("fp") == F.col("__fp")).drop("__fp")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``keep`` columns (one of a computed name gives way) of every document with fingerprint and component_id."""
    names = [c for c in keep if c not in ("doc_id", "fingerprint", "component_id", "fp", "__root")]
    return _grouped(docs, ("doc_id", *names), limit).select(
        "doc_id", *names, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without all but one of each near-duplicate group: the smallest doc_id stays.

    Groups are told apart by their fingerprints, as two may hold different texts of one doc_id. Of several texts with
    that doc_id in a group the one with the smallest hash stays, of equal rows one. Rows without a doc_id can't be
    named and stay.
    """
    hashed = docs.withColumn("__h", F.xxhash64("text"))
    marked = _grouped(hashed.where("doc_id is not null"), ("doc_id", "__h"))
    stay = (
        marked.groupBy("__root").agg(F.min(F.struct("doc_id", "__h")).alias("s"))
        .select(F.col("s.doc_id").alias("__id"), F.col("s.__h").alias("__least"))
    )
    named = hashed.join(stay, (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__least")), "left_semi")
    return named.dropDuplicates(["doc_id", "__h"]).unionByName(hashed.where("doc_id is null")).drop("__h")
