"""Line signatures and exact similarity by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.line_rules import BANDS, MASKS, ROWS, SHINGLE, WORDS

#: Characters by which the pieces that shingles are taken from advance.
PIECE = 8
_signed = lambda c: (c + (1 << 63)) % (1 << 64) - (1 << 63)


def shingles(line: Column) -> Column:
    """The runs of ``SHINGLE`` characters at every character; a shorter line as a whole."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}|\A.{{1,{SHINGLE - 1}}}\z))."), F.lit(1))


def shingle_hashes(lines: DataFrame, *keep: str) -> DataFrame:
    """(lid, x0 ... x7) and ``keep``: the hashes of ``PIECE`` shingles in a row; a line's last shingle repeats where there are fewer.

    Four bytes hold any character, so taking a shingle costs its own length, wherever it stands in the line.
    """
    wide = lines.select("lid", *keep, F.encode("line", "UTF-32").alias("__u"))
    last = F.greatest((F.length("__u") / 4).cast("int") - (SHINGLE - 1), F.lit(1))
    places = wide.withColumn("__last", last).select("lid", *keep, "__u", "__last", F.explode(F.sequence(F.lit(1), "__last", F.lit(PIECE))).alias("__i"))
    begin = [F.least(F.col("__i") + k, F.col("__last")) * 4 - 3 for k in range(PIECE)]
    return places.select("lid", *keep, *[F.xxhash64(F.substring("__u", at, F.lit(4 * SHINGLE))).alias(f"x{k}") for k, at in enumerate(begin)])


def _minimum(mask: int) -> Column:
    """The minimum of all of a line's shingle hashes under an XOR mask: first of each piece's, then of the pieces'."""
    return F.min(F.least(*[F.col(f"x{k}").bitwiseXOR(F.lit(_signed(mask))) for k in range(PIECE)]))


def _minima(lines: DataFrame) -> DataFrame:
    """(lid, m0 ... m17): minima of all of each line's shingle hashes under fixed XOR masks."""
    return shingle_hashes(lines).groupBy("lid").agg(*[_minimum(c).alias(f"m{i}") for i, c in enumerate(MASKS)])


def band_rows(lines: DataFrame) -> DataFrame:
    """(lid, key, o) for each signed line and band: the band's hash, and what orders its group.

    The next band's first minimum orders a group: short groups of bits suffice, and compress well.
    """
    signed = _minima(lines)
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    after = [F.col(f"m{(b + 1) % BANDS * ROWS}") for b in range(BANDS)]
    entries = [F.struct(k.alias("key"), F.shiftrightunsigned(o, 40).cast("int").alias("o")) for k, o in zip(bands, after)]
    return signed.select("lid", F.explode(F.array(*entries)).alias("e")).select("lid", "e.key", "e.o")


def marks(lines: DataFrame) -> DataFrame:
    """(lid, size, marks): how many shingles each line has, repeats counted, and ``WORDS`` words with a bit set for every shingle, by its hash.

    The words stand in one array: a join that carries a column for each on either side makes code that is slow to begin.
    """
    sized = lines.select("lid", "line", F.greatest(F.length("line") - (SHINGLE - 1), F.lit(1)).alias("size"))
    x = shingle_hashes(sized, "size").select("lid", "size", F.explode(F.array(*[f"x{k}" for k in range(PIECE)])).alias("x"))
    words = x.groupBy("lid", "size", F.pmod("x", F.lit(WORDS)).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(x >> 20 & 63))")).alias("bits"))
    each = [F.coalesce(F.bit_or(F.when(F.col("at") == k, F.col("bits"))), F.lit(0).cast("long")) for k in range(WORDS)]
    return words.groupBy("lid", "size").agg(F.array(*each).alias("marks"))


def hash_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """(lid, x) and ``keep``: each distinct shingle hash of each line."""
    runs = shingle_hashes(lines, *keep)
    return runs.select("lid", *keep, F.explode(F.array(*[f"x{k}" for k in range(PIECE)])).alias("x")).distinct()


def shingle_set(line: Column) -> Column:
    """The hashes of a line's shingles, some of them repeated: eight to a piece, the last piece ends with the line."""
    width = PIECE + SHINGLE - 1
    pieces = F.concat(F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{width}}})).{{{PIECE}}}"), F.lit(1)), F.array(F.right(line, F.lit(width))))
    of = lambda p: F.array(*[F.xxhash64(F.substring(p, i, SHINGLE)) for i in range(1, PIECE + 1)])
    short = F.transform(shingles(line), lambda x: F.xxhash64(x))
    return F.when(F.length(line) < width, short).otherwise(F.flatten(F.transform(pieces, of)))


def similar(both: DataFrame, least: float) -> DataFrame:
    """(a, b) of those rows (a, b, ta, tb) whose lines' shingle sets have a Jaccard similarity of ``least`` or more."""
    # Each step is a projection of its own, so that each set is made once; the generator keeps them apart.
    sets = both.select("a", "b", *[F.array_distinct(shingle_set(F.col(t))).alias(x) for t, x in (("ta", "xa"), ("tb", "xb"))])
    counts = sets.select("a", "b", F.size(F.array_intersect("xa", "xb")).alias("common"), (F.size("xa") + F.size("xb")).alias("sum"))
    yes = (1 + least) * F.col("common") >= least * F.col("sum") - 1e-9
    return counts.select("a", "b", F.explode(F.when(yes, F.array(F.lit(1)))).alias("__yes")).select("a", "b")
