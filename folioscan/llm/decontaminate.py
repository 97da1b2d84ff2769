"""Benchmark decontamination: prefix-filtered join of rare shingles with exact verification.

Every benchmark item becomes windows of 13 consecutive words (a shorter item is one window). A
document contains a window only if it contains each shingle of it, so for containment 1.0 the
necessary prefix of a window, with its shingles ordered by rarity, is its rarest shingle. The
document frequency that orders shingles is counted over all documents. Document shingles are
joined with these prefixes only; a match fixes where the window would start, which gives the
positional and length bounds, and the words of that window-sized span are then compared exactly.

Benchmarks are taken in blocks of bounded size, so what travels with a task never grows with the
benchmark; each block is one pass over the documents.

Cases: null or word-free texts have ``n_words`` 0 and are clean; items without an id or without
words take no part; rows repeated in the benchmark count as one item; repeated documents are
judged row by row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import fold_texts, map_texts

#: A word: a run of digits, letters a to z and everything beyond ASCII (bytes from 0x80).
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
SHINGLE = 4
BLOCK_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cases A-Z only, then takes the words."""
    return TOKEN.findall(text.lower())


def _keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of each run of ``size`` ids; 0 where a word is outside the vocabulary."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for j in range(size):
        part = ids[j : j + n]
        known &= part > 0
        key = (key + part.astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return np.where(known, key | np.uint64(1), np.uint64(0))


class Block:
    """Windows of a bounded block of items, and the prefix shingle of each once rarity is known."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                owners[tuple(ids[i : i + window])].add(item)
        self.windows = list(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.zeros((len(self.windows), window), np.int64)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.shingles = {s: np.unique(self._all(s)[0]) for s in self.sizes}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _all(self, size: int):
        """Keys of all shingles of the windows that use this size, with window and offset."""
        of = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == size)
        keys, window, offset = [], [], []
        for i in of:
            k = _keys(self.words[i, : self.lengths[i]], size)
            keys.append(k)
            window.append(np.full(len(k), i))
            offset.append(np.arange(len(k)))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, window, offset))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, a 0 after each text, and where each text starts."""
        get = self.vocabulary.get
        lists = [[get(w, 0) for w in tokens(t)] for t in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        ids = np.fromiter(chain.from_iterable((*x, 0) for x in lists), np.int64, int(starts[-1]))
        return ids, starts

    def count(self, texts: list[bytes]) -> Counter:
        """How often each benchmark shingle stands in these texts."""
        ids, _ = self.ids(texts)
        found: Counter = Counter()
        for s, known in self.shingles.items():
            keys = _keys(ids, s)
            keys = keys[keys != 0]
            if len(keys):
                keys = keys[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]
                for k, n in zip(*np.unique(keys, return_counts=True)):
                    found[(s, int(k))] += int(n)
        return found

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Takes each window's rarest shingle (ties: the first) as its prefix."""
        for s in self.sizes:
            keys, window, offset = self._all(s)
            counts = np.array([frequency.get((s, int(k)), 0) for k in keys], np.int64)
            best = np.lexsort((offset, counts, window))
            first = best[np.concatenate(([True], np.diff(window[best]) != 0))]
            by_key = first[np.argsort(keys[first], kind="stable")]
            distinct, at = np.unique(keys[by_key], return_index=True)
            self.prefix[s] = (distinct, np.append(at, len(by_key)), window[by_key], offset[by_key])

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every exact occurrence."""
        starts, windows = [], []
        for s, (distinct, at, window, offset) in self.prefix.items():
            keys = _keys(ids, s)
            pos = np.flatnonzero(keys)
            slot = np.minimum(np.searchsorted(distinct, keys[pos]), len(distinct) - 1)
            hit = distinct[slot] == keys[pos]
            pos, slot = pos[hit], slot[hit]
            for lo in range(0, len(pos), 50_000):
                p, k = pos[lo : lo + 50_000], slot[lo : lo + 50_000]
                many = at[k + 1] - at[k]
                entry = np.repeat(at[k] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                begin, w = np.repeat(p, many) - offset[entry], window[entry]
                inside = (begin >= 0) & (begin + self.lengths[w] <= len(ids))
                begin, w = begin[inside], w[inside]
                for j in range(self.words.shape[1]):
                    in_word = j < self.lengths[w]
                    same = ~in_word | (ids[np.minimum(begin + j, len(ids) - 1)] == self.words[w, j])
                    begin, w = begin[same], w[same]
                starts.append(begin)
                windows.append(w)
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (none, none)

    def scan(self, texts: list[bytes]) -> dict[str, list]:
        """Per text: number of words, hit spans (start, end alternating, merged) and items."""
        ids, bounds = self.ids(texts)
        begin, window = self.occurrences(ids)
        spans: list[list[int]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        owner = np.searchsorted(bounds, begin, side="right") - 1
        for i in np.lexsort((begin, owner)):
            d, b = int(owner[i]), int(begin[i] - bounds[owner[i]])
            e = b + int(self.lengths[window[i]])
            if spans[d] and b <= spans[d][-1]:
                spans[d][-1] = max(spans[d][-1], e)
            else:
                spans[d] += [b, e]
            items[d].update(self.items[window[i]])
        n_words = (np.diff(bounds) - 1).tolist()
        return {"n_words": n_words, "__spans": spans, "__items": [sorted(x) for x in items]}


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Blocks of items, each of about ``block_bytes`` at most; one collect per block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    rows = rows.where(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield Block([(r.i, r.t.encode()) for r in part.toLocalIterator()])


def shingle_counts(docs: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """Occurrences of the block's shingles over all documents; as many rows as the block has shingles."""

    def setup():
        seen: Counter = Counter()

        def drain():
            return {"size": [k[0] for k in seen], "key": [k[1] - (1 << 63) for k in seen], "n": list(seen.values())}

        return (lambda texts, _: seen.update(block.count(texts))), drain

    counted = fold_texts(docs, [], setup, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
    return {(r["size"], r["key"] + (1 << 63)): r["n"] for r in counted.toLocalIterator()}


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``keep`` columns of every document with n_words, n_hit, n_items, items_sha256, contaminated."""
    parts = []
    for block in _blocks(benchmark, block_bytes):
        block.order(shingle_counts(docs, block) if block.windows else {})
        parts.append(block)
    kept = [*keep]

    def passed(block: Block, columns: list[str], source: DataFrame) -> DataFrame:
        return map_texts(
            source, columns, lambda: lambda texts, _: block.scan(texts),
            "n_words long, __spans array<long>, __items array<string>",
        )

    if len(parts) == 1:
        found = passed(parts[0], kept, docs)
    else:
        # Each block sees every row once; equal rows have equal results, so their number is enough.
        keyed = docs.select(*kept, "text", F.xxhash64("text").alias("__h"), F.octet_length("text").alias("__l"))
        each = [passed(b, [*kept, "__h", "__l"], keyed) for b in parts]
        union = each[0]
        for x in each[1:]:
            union = union.unionByName(x)
        grouped = union.groupBy(*kept, "__h", "__l", "n_words").agg(
            F.flatten(F.collect_list("__spans")).alias("__s"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
            (F.count("*") / F.lit(len(parts))).cast("int").alias("__n"),
        )
        found = map_spans(grouped, kept).select(*kept, "n_words", "__spans", "__items")
    signed = F.transform("__spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("__items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "__items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .drop("__spans", "__items")
    )


def map_spans(grouped: DataFrame, kept: list[str]) -> DataFrame:
    """Merges the spans that several blocks found in a document and restores repeated rows."""
    begins = F.filter("__s", lambda _, i: i % 2 == 0)
    ends = F.filter("__s", lambda _, i: i % 2 == 1)
    pairs = F.array_sort(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e"))))
    merged = F.aggregate(
        pairs,
        F.array().cast("array<bigint>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1) >= x["b"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.greatest(F.element_at(a, -1), x["e"]))),
        ).otherwise(F.concat(a, F.array(x["b"], x["e"]))),
    )
    return grouped.withColumn("__spans", merged).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__n")))


def items_digest(items: list[str]) -> str:
    """The digest the operator returns for a list of item ids."""
    return sha256(",".join(sorted(items)).encode()).hexdigest()
