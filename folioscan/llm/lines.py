"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Two styles make signatures and verify pairs, by the same rules: built-in functions only (``line_builtin``, which the query and the pipeline use), and
numpy in Arrow batches (``line_numpy``); all else is DataFrame functions. Lines are a text's pieces between line feeds, trimmed. Equal
lines collapse first (combined in tasks before the shuffle), so a line that stands in a third of all documents
is one row of the table of distinct lines, which is stored bucketed by line id and not shuffled again.

A line's shingles are its runs of ``SHINGLE`` characters, beginning at every character; a shorter line is its
own shingle. Two lines are similar where these sets have a Jaccard similarity of ``SIMILAR`` or more and neither line
is over twice as long as the other. The shingles' 64-bit hashes, XORed with fixed constants, give the minima of a signature, which
only makes candidates.
``BANDS`` bands of ``ROWS`` minima make candidates: at a Jaccard similarity of 0.8 a pair shares a
band with probability 0.986, above 0.9 with 0.9996. Within a band's group lines are sorted by a further
minimum, so that similar lines stand side by side, and each is paired with the ``BACK`` before it and
with the group's first: all pairs of a small group, and a group of near copies costs its size, not its square. Each line of such
a group is marked once, by a bit among ``64 * WORDS`` for every shingle: no two shingle sets differ in fewer shingles than their marks in bits,
so a pair whose marks differ in too many can't be similar and goes, and no other does. What is left is verified by the
exact Jaccard similarity of both lines' shingle sets (0.8 or more) before it becomes edges of the components.

A larger group that these edges leave in several components (lines of one template, say) is not left at that. Of a group
of up to ``WHOLE`` lines all pairs of different components that were not compared yet go the same way, through marks and verification. The lines of still larger groups are joined exactly, by
prefixes of their shingles in order of rarity: of two similar lines the smaller set's first ninth and the larger set's first
fifth share a shingle, so each pair of different components is found, and boilerplate, which comes last in that order, joins
nothing. Of a shingle's lines only those outside its most frequent component meet all others.

Of each component one line stays: the first in the document with the smallest id. Line ids are 64-bit
hashes of the line; with a billion distinct lines the chance of any collision is 3 %.

Cases: blank lines are kept and never compared; null texts have no lines and stay null; empty
texts stay empty; lines of a null doc_id count as after all others; rows repeated whole share their result;
of several texts with one id the smaller hash comes first; no rows give no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_
from types import ModuleType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm import line_builtin, line_numpy
from folioscan.llm.common import materialize, scratch_dir
from folioscan.llm.components import components
from folioscan.llm.line_rules import SHINGLE, SIMILAR

#: Partners before it that a line of a band's group is paired with.
BACK = 3
#: Groups of up to so many lines are compared pair by pair where they stay in several components; larger ones are joined by prefixes.
WHOLE = 128
_LAST = (1 << 63) - 1


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, h, line_no, line, lid): every line that isn't blank; doc is never null."""
    lines = docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("h"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    # Trimming looks at every character of a line; most lines show at either end that there is nothing to trim.
    blanks = " \t\r\x0b\x0c"
    ends = reduce(or_, [at("line", F.lit(c)) for at in (F.startswith, F.endswith) for c in blanks])
    lines = lines.withColumn("line", F.when(ends, F.btrim("line", F.lit(blanks))).otherwise(F.col("line"))).where("line <> ''")
    return lines.withColumn("lid", F.xxhash64("line"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(lid, line, doc, n) of every distinct line, stored bucketed by lid."""
    return _bucketed(occurrences(docs).groupBy("lid").agg(F.max("line").alias("line"), F.min("doc").alias("doc"), F.count("*").alias("n")))


def _bucketed(lines: DataFrame) -> DataFrame:
    """``lines``, stored bucketed by lid."""
    spark = lines.sparkSession
    name = f"folioscan_lines_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (lines.write.option("path", scratch_dir(spark)).option("compression", "zstd").bucketBy(buckets, "lid")
     .format("parquet").saveAsTable(name))
    return spark.table(name)


def neighbours(lines: DataFrame, style: ModuleType = line_builtin) -> DataFrame:
    """(key, lid, place, top, prior): the groups of the bands, but for their first members, which are ``top``."""
    rows = style.band_rows(lines)
    group = Window.partitionBy("key").orderBy("o", "lid")
    return rows.select(
        "key", "lid", F.row_number().over(group).alias("place"),
        F.first("lid").over(group.rowsBetween(Window.unboundedPreceding, 0)).alias("top"),
        F.array(*[F.lag("lid", k).over(group) for k in range(1, BACK + 1)]).alias("prior"),
    ).where("place > 1")


def candidate_pairs(near: DataFrame) -> DataFrame:
    """(a, b), a < b, of lines that stand near each other, or with the first, in the group of a band."""
    pairs = near.select("lid", F.explode(F.concat("prior", F.array("top"))).alias("p")).where("lid <> p")
    return pairs.select(F.least("lid", "p").alias("a"), F.greatest("lid", "p").alias("b")).distinct()


def members(near: DataFrame, lines: DataFrame) -> DataFrame:
    """(lid, line, size, marks) of every line of a band's group, with its marks, stored bucketed by lid."""
    inside = near.select(F.explode(F.array("lid", "top")).alias("lid")).distinct()
    # The ids are few and short: they are hashed, the lines need no sort.
    own = _bucketed(lines.select("lid", "line").join(inside.hint("shuffle_hash"), "lid", "left_semi"))
    return _bucketed(own.join(line_builtin.marks(own), "lid"))


def unconnected(near: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, lid, root, n) of the members of all larger groups that ``edges`` leave in several components; n: the group's size."""
    # All pairs of a group of up to ``BACK`` + 2 lines are candidates already.
    large = near.where(F.col("place") > BACK + 2).groupBy("key").agg(F.max("place").alias("n"))
    inside = near.join(large, "key").select("key", "n", F.explode(F.array("lid", "top")).alias("lid")).distinct()
    roots = components(edges).withColumnRenamed("node", "lid")
    named = materialize(inside.join(roots, "lid", "left").select("key", "lid", F.coalesce("root", "lid").alias("root"), "n"))
    split = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return materialize(named.join(split, "key", "left_semi"))


def group_pairs(open_: DataFrame) -> DataFrame:
    """(a, b), a < b, of all lines of different roots in one group."""
    own, other = (open_.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("lid", "root")]) for x in "ab")
    both = own.join(other, "key").where((F.col("lid_a") < F.col("lid_b")) & (F.col("root_a") != F.col("root_b")))
    return both.select(F.col("lid_a").alias("a"), F.col("lid_b").alias("b")).distinct()


def prefix_pairs(open_: DataFrame, lines: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b), a < b, of different roots among ``open_`` (lid, root): all that can have a similarity of ``least``, few others."""
    runs = materialize(line_builtin.hash_rows(lines.select("lid", "line").join(open_, "lid"), "root"))
    by_root = runs.groupBy("x", "root").agg(F.count("*").alias("m"))
    rarity = by_root.groupBy("x").agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.max_by("root", F.struct("m", "root")).alias("main"))
    line = Window.partitionBy("lid")
    placed = runs.join(rarity, "x").withColumn("at", F.row_number().over(line.orderBy("n", "x")) - 1).withColumn("size", F.count("*").over(line))
    # A little room for rounding; a prefix that is too long by one shingle only makes candidates.
    size = F.col("size")
    probe, index = size - F.ceil(least * size - 1e-6) + 1, size - F.ceil(2 * least / (1 + least) * size - 1e-6) + 1
    first = materialize(placed.where((F.col("at") < probe) & (F.col("k") > 1)).select(
        "lid", "root", "size", "at", "x", (F.col("at") < index).alias("short"), (F.col("root") == F.col("main")).alias("main")
    ))
    names = ["lid", "root", "size", "at", "x", "main"]
    small = first.where("short").select(*[F.col(c).alias(c if c == "x" else f"{c}_a") for c in names])
    great = first.select(*[F.col(c).alias(c if c == "x" else f"{c}_b") for c in names])
    # At its first common shingle a pair can share no more than what is left of either.
    shared = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    fits = (F.col("root_a") != F.col("root_b")) & ((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("lid_a") < F.col("lid_b"))))
    fits &= (F.col("size_a") >= least * F.col("size_b") - 1e-6) & ((1 + least) * shared >= least * (F.col("size_a") + F.col("size_b")) - 1e-6)
    both = [small.where("not main_a").join(great, "x").where(fits), small.where("main_a").join(great.where("not main_b"), "x").where(fits)]
    return both[0].union(both[1].select(*both[0].columns)).select(F.least("lid_a", "lid_b").alias("a"), F.greatest("lid_a", "lid_b").alias("b")).distinct()


def finer_pairs(open_: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b) of open lines (key, lid, root, n) of different roots: all pairs of a group that may be similar, however large it is."""
    pairs = group_pairs(open_.where(F.col("n") <= WHOLE))
    rest = open_.where(F.col("n") > WHOLE).select("lid", "root").distinct()
    return pairs if rest.isEmpty() else pairs.union(prefix_pairs(rest, lines)).distinct()


def possible_pairs(pairs: DataFrame, inside: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those (a, b) whose marks don't rule out a similarity of ``least``; a pair that has it is always among them."""
    a, b = (inside.select(F.col("lid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "marks")]) for x in "ab")
    words = F.zip_with("marks_a", "marks_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(words, F.lit(0), lambda sum_, n: sum_ + n)
    # Sizes count repeats, and so are never too small.
    fits = (1 + least) * differ <= (1 - least) * (F.col("size_a") + F.col("size_b")) + 1e-6
    return pairs.join(a, "a").join(b, "b").where(fits).select("a", "b")


def similar_pairs(pairs: DataFrame, inside: DataFrame, style: ModuleType = line_builtin) -> DataFrame:
    """Those (a, b) whose lines' shingle sets have a Jaccard similarity of ``SIMILAR`` or more; ``inside`` are the ``members``."""
    text = inside.select("lid", "line")
    both = possible_pairs(pairs, inside).join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")
    both = both.where((F.length("ta") <= 2 * F.length("tb") + SHINGLE) & (F.length("tb") <= 2 * F.length("ta") + SHINGLE))
    return style.similar(both, SIMILAR)


def near_line_edges(lines: DataFrame, style: ModuleType = line_builtin) -> DataFrame:
    """Verified edges (a, b) between ids of similar lines."""
    near = materialize(neighbours(lines, style))
    inside, met = members(near, lines), materialize(candidate_pairs(near))
    edges = materialize(similar_pairs(met, inside, style))
    if near.where(F.col("place") > BACK + 2).isEmpty():
        return edges
    open_ = unconnected(near, edges)
    if open_.isEmpty():
        return edges
    more = finer_pairs(open_, inside).join(met, ["a", "b"], "left_anti")
    return edges.union(materialize(similar_pairs(more, inside, style)))


def dropped_lines(docs: DataFrame, native: bool = True) -> DataFrame:
    """(doc, h, line_no, root) of every line that goes, and the component that keeps another."""
    lines = distinct_lines(docs)
    roots = components(near_line_edges(lines, line_builtin if native else line_numpy))
    of = lines.select("lid", "doc", "n").join(roots.withColumnRenamed("node", "lid"), "lid", "left")
    of = of.where("root is not null or n > 1").select("lid", "doc", F.coalesce("root", "lid").alias("root"))
    keeper = of.groupBy("root").agg(F.min("doc").alias("keeper"))
    affected = of.select("lid", "root").join(keeper, "root")
    seen = materialize(occurrences(docs).select("doc", "h", "line_no", "lid").join(affected, "lid").drop("lid"))
    # Elsewhere all lines of the component go; in the document that keeps one the first stays. Only
    # that document's rows meet by component, so a component in a third of all documents is no hot key.
    own = seen.where("doc = keeper")
    stays = (
        own.groupBy("root", "h").agg(F.min("line_no").alias("__no"))
        .groupBy("root").agg(F.min_by(F.struct("h", "__no"), "h").alias("__stays"))
    )
    others = own.join(stays, "root").where("not (h = __stays.h and line_no = __stays.__no)")
    columns = ["doc", "h", "line_no", "root"]
    return seen.where("doc <> keeper").select(*columns).union(others.select(*columns)).distinct()


def _drops(docs: DataFrame, native: bool) -> DataFrame:
    drops = dropped_lines(docs, native).groupBy("doc", "h").agg(F.sort_array(F.collect_set("line_no")).alias("__drop"))
    return drops.select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), "__drop")


def _join(docs: DataFrame, drops: DataFrame) -> DataFrame:
    own = docs.withColumn("__own", F.xxhash64("text"))
    on = (F.coalesce("doc_id", F.lit(_LAST)) == F.col("__doc")) & (F.col("__own") == F.col("__h"))
    return own.join(drops, on, "left").drop("__doc", "__h", "__own")


def dedup_report(docs: DataFrame, native: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped) of every document; dropped: the line numbers, from 0."""
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    small = docs.select("doc_id", F.xxhash64("text").alias("__own"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines"))
    on = (F.coalesce("doc_id", F.lit(_LAST)) == F.col("__doc")) & (F.col("__own") == F.col("__h"))
    return small.join(_drops(docs, native), on, "left").select(
        "doc_id", F.col("n_lines").cast("long"),
        (F.col("n_lines") - F.coalesce(F.size("__drop"), F.lit(0)).cast("long")).alias("n_kept"),
        F.coalesce("__drop", F.array().cast("array<int>")).alias("dropped"),
    )


def dedup_lines(docs: DataFrame, native: bool = True) -> DataFrame:
    """The documents with only the lines that stay; n_chars, where there is one, follows the text."""
    columns = docs.columns
    joined = _join(docs, _drops(docs, native)).withColumn("__lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    )
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
