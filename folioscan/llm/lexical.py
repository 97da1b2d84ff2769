"""Ranked lexical search over a bit-sliced impact index.

A document's score for an item is a sum of integer impacts: a term's weight times the gain of its count in the
document. Documents are dealt over segments of about ``SEGMENT``. A segment's index has, for each term, one bitmap over
the segment's documents for every bit of the impact, kept only at the 64-document words where the term occurs.
An item's terms are added for all documents at once by carry arithmetic on whole bitmaps (sums and carries apart,
carries rippled at the end), a repeated term by its shifted bitmaps. The top k come from the most
significant slice down: documents with the bit are ahead of those without it as long as more than k of them are
left, so no score is put together but those returned. Segments number documents by ascending id, which settles ties.

Only terms that some item asks for are indexed; counts, lengths and document frequencies are those of all documents.
One pass over the texts makes the postings; they are shuffled once, by segment, and met there by the items' terms.
Items are dealt in blocks of about ``ITEM_TERMS`` terms, so a task holds one segment and one block. Neither
items nor postings pass through the driver, which sees three counts.

Cases: a null or empty text has no terms and is no document in the counts; an item without terms, or of terms that no
document has, returns no row; a null item_id is an item like any other, and all null ones are one item; the
texts of an item_id's rows are taken together, exactly repeated rows once; rows that share a doc_id are
documents of their own, a null doc_id comes after all others at equal scores; empty tables give no rows;
further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import fold_texts, materialize

SEGMENT = 8192
ITEM_TERMS = 1 << 18
TERM = rb"[0-9A-Za-z\x80-\xff]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_GROUP = "segment int, block int, item long, t long, qtf long, w long, row long, doc_id long, gain long"
_FOUND = "item long, row long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return re.findall(TERM, text.translate(_LOWER))


def counted(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, term, tf): the postings; rows without a term have sums over documents, their number in tf, their terms in n."""

    def setup():
        def take(texts, part):
            rows, ids = part.column("row").to_pylist(), part.column("doc_id").to_pylist()
            out = {c: [] for c in ("row", "doc_id", "n", "term", "tf")}
            documents = total = 0
            for row, doc_id, text in zip(rows, ids, texts):
                found = Counter(terms(text))
                n, m = found.total(), len(found)
                documents, total = documents + (n > 0), total + n
                out["row"] += [row] * m
                out["doc_id"] += [doc_id] * m
                out["n"] += [n] * m
                out["term"] += [t.decode("utf-8", "replace") for t in found]
                out["tf"] += found.values()
            for c, v in (("row", None), ("doc_id", None), ("n", total), ("term", None), ("tf", documents)):
                out[c].append(v)
            return out

        return take, lambda: None

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return fold_texts(rows, ("row", "doc_id"), setup, "row long, doc_id long, n long, term string, tf long", rows=128)


def asked(items: DataFrame) -> DataFrame:
    """(item_id, term, qtf): how often an item's texts hold a term."""
    def setup():
        def take(texts, part):
            at, names, n = [], [], []
            for i, text in enumerate(texts):
                found = Counter(terms(text))
                at += [i] * len(found)
                names += [t.decode("utf-8", "replace") for t in found]
                n += found.values()
            return {"item": part.column("item").take(pa.array(at, pa.int64())), "term": names, "qtf": n}

        return take, lambda: None

    rows = items.select("item_id", "text").distinct()
    kind = rows.schema["item_id"].dataType.simpleString()
    found = fold_texts(rows.select(F.col("item_id").alias("item"), "text"), ("item",), setup, f"item {kind}, term string, qtf long", rows=128)
    return found.groupBy(F.col("item").alias("item_id"), "term").agg(F.sum("qtf").alias("qtf"))


class Index:
    """Impact bitmaps of a segment: ``slices[t]`` is (words, bits x words), ``size`` documents in the order of ties."""

    def __init__(self, size: int, t: np.ndarray, at: np.ndarray, impact: np.ndarray):
        self.size, self.words = size, -(-size // 64)
        order = np.lexsort((at, t))
        t, at, impact = t[order], at[order], impact[order].astype(np.uint64)
        names, begin = np.unique(t, return_index=True)
        self.slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for name, a, b in zip(names.tolist(), begin, [*begin[1:], len(t)]):
            words, first = np.unique(at[a:b] >> 6, return_index=True)
            bits = np.arange(int(impact[a:b].max()).bit_length(), dtype=np.uint64)
            placed = (impact[a:b] >> bits[:, None] & np.uint64(1)) << (at[a:b] & 63).astype(np.uint64)
            if len(bits):
                self.slices[name] = words, np.bitwise_or.reduceat(placed, first, axis=1)

    def add(self, query: list[tuple[int, int]]) -> np.ndarray:
        """Bitmaps (bits x words) of the sum of the query's impacts, each taken as often as the query says."""
        known = [(self.slices[t], qtf) for t, qtf in query if t in self.slices]
        height = sum((qtf << len(m)) for (_, m), qtf in known).bit_length() + 1
        total, carry = np.zeros((2, height, self.words), np.uint64)
        for (words, bitmaps), qtf in known:
            where = slice(None) if len(words) == self.words else words
            for shift in range(qtf.bit_length()):
                if qtf >> shift & 1:
                    low, high = shift, shift + len(bitmaps)
                    a, b = total[:, where], carry[:, where]
                    part = a ^ b
                    both = a & b
                    both[low:high] |= part[low:high] & bitmaps
                    part[low:high] ^= bitmaps
                    total[:, where] = part
                    carry[1:, where] = both[:-1]
                    carry[0, where] = 0
        while carry.any():
            both = total & carry
            total ^= carry
            carry[1:], carry[0] = both[:-1], 0
        return total

    def top(self, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best with a score above 0, the lower place first among equals."""
        ahead, level = np.zeros(self.words, np.uint64), np.bitwise_or.reduce(total, axis=0)
        have = 0
        for bitmap in total[::-1]:
            with_bit = level & bitmap
            n = int(np.bitwise_count(with_bit).sum())
            if have + n > k:
                level = with_bit
            else:
                ahead |= with_bit
                have += n
                level = level & ~bitmap
        places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        at = np.concatenate([places(ahead), places(level)[: k - have]])
        bits = total[:, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
        score = (bits << np.arange(len(total), dtype=np.uint64)[:, None]).sum(0, dtype=np.uint64).astype(np.int64)
        order = np.lexsort((at, -score))
        return at[order], score[order]


def _searcher(k: int):
    def search(rows: pa.Table) -> pa.Table:
        posting = rows.filter(rows.column("item").is_null())
        query = rows.filter(rows.column("item").is_valid())
        numbers = lambda table, c: table.column(c).to_numpy()
        out = {"item": [], "row": [], "doc_id": [], "score": []}
        if posting.num_rows and query.num_rows:
            weight = dict(zip(numbers(query, "t").tolist(), numbers(query, "w").tolist()))
            row, first, at = np.unique(numbers(posting, "row"), return_index=True, return_inverse=True)
            ids = posting.column("doc_id").combine_chunks().take(pa.array(first))
            null, plain = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            order = np.lexsort((row, plain, null))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            names, t = np.unique(numbers(posting, "t"), return_inverse=True)
            w = np.array([weight.get(x, 0) for x in names.tolist()], np.int64)[t]
            asked_for = w > 0
            index = Index(len(order), names[t][asked_for], place[at][asked_for], (w * numbers(posting, "gain"))[asked_for])
            items: dict[int, list] = {}
            for item, name, qtf in zip(*(numbers(query, c).tolist() for c in ("item", "t", "qtf"))):
                items.setdefault(item, []).append((name, qtf))
            for item, wanted in items.items():
                best, score = index.top(index.add(wanted), k)
                out["item"] += [item] * len(best)
                out["row"] += row[order[best]].tolist()
                out["doc_id"] += ids.take(pa.array(order[best])).to_pylist()
                out["score"] += score.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return search


def search(docs: DataFrame, items: DataFrame, k: int = 20, segment: int = SEGMENT, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    wanted = materialize(asked(items))
    ids = materialize(wanted.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()))
    names = materialize(wanted.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    # One pass over the texts: a term that nobody asks for goes before anything is stored.
    postings = materialize(counted(docs).join(names, "term", "left").where("term is null or t is not null").drop("term"))
    total = postings.where("t is null").agg(F.sum("tf").alias("n"), F.sum("n").alias("l")).first()
    n, length = int(total.n or 0), max(1, int(total.l or 0))
    segments, blocks = max(1, -(-n // segment)), max(1, -(-wanted.count() // item_terms))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    df = postings.where("t is not null").groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000.0 * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    queries = (
        wanted.join(names, "term").join(df, "t").join(ids, wanted["item_id"].eqNullSafe(ids["item_id"]))
        .select("item", "t", "qtf", weight.alias("w"), F.pmod("item", F.lit(blocks)).cast("int").alias("block"))
        .where("w > 0")
    )
    m = F.expr(f"75L + ((25L * n * {n}L) div {length}L)")
    gain = postings.where("t is not null").withColumn("m", m).withColumn("gain", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)"))
    null = lambda c: F.lit(None).cast("long").alias(c)
    dealt = gain.select(
        F.pmod(F.xxhash64("row"), F.lit(segments)).cast("int").alias("segment"), every(blocks).alias("block"), null("item"), "t", null("qtf"), null("w"), "row", "doc_id", "gain"
    ).union(materialize(queries).select(every(segments).alias("segment"), "block", "item", "t", "qtf", "w", null("row"), null("doc_id"), null("gain")))
    found = dealt.groupBy("segment", "block").applyInArrow(_searcher(k), _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")
