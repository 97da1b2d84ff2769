"""Mixing sources to target weights: capped water-filling and seeded systematic repetition.

Sources get weights; each is clamped at ``max_epochs`` times its size and the excess is shared
again by weight until no source is above its clamp. The fixed point is computed in closed form:
with sources ordered by clamp/weight, the water level after clamping the first k is
(total - clamped sizes) / (weights left), and the first k whose level does not exceed the next
ratio is the answer. All of it runs on one row per source.

A source's target is then met in repetitions of documents: whole epochs for every document, and
for the fraction the documents that come first in a seeded order until the fraction is filled
(the last by whether its middle lies within). The running sum that this needs is taken per
(source, slice of the order) with the slices' totals added from a small table, so a source with a
third of all rows is spread over as many tasks as there are slices.

Cases: null sources form one source, ordered last; null or empty texts have size 0 and are never
repeated; rows repeated in the input are documents of their own; no rows give no rows; if nothing
has a size all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import WORD

SEED = "mix-1"
SLICES = 1024


def text_size(text: Column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the given weights in turn over sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    index = F.pmod(rank - 1, F.lit(len(weights))).cast("int")
    return sources.withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), index))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight) → adds ``target``; one row per source."""
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(F.col("__ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        sources.withColumn("__ratio", cap / F.col("weight"))
        .withColumn("__left", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__level", F.col("__left") / F.col("__weights"))
        .withColumn("__fits", F.col("__level") <= F.col("__ratio"))
        .withColumn("__water", F.first(F.when(F.col("__fits"), F.col("__level")), True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("weight") * F.col("__water"), cap.cast("double"))
    return levels.select("source", "source_size", "weight", F.coalesce(target, cap.cast("double")).alias("target"))


def mixture(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), max_epochs: int = 3, weights=(1, 2, 3),
            seed: str = SEED, slices: int = SLICES) -> DataFrame:
    """``columns`` of every document with size, source_size, target, repeats and taken."""
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    shift = 32 - (slices.bit_length() - 1)
    # Kept columns travel in a struct: their names can't clash with those used here.
    sized = docs.select(
        F.struct(*columns).alias("__row"), F.col("source").alias("__source"), text_size(F.col("text")).alias("size"), hashed.alias("__order")
    )
    sized = sized.withColumn(
        "__slice", F.shiftright(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long"), shift).cast("int")
    )
    parts = sized.groupBy(F.col("__source").alias("source"), "__slice").agg(F.sum("size").alias("__part"))
    running = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__offset", F.coalesce(F.sum("__part").over(running), F.lit(0)))
    totals = parts.groupBy("source").agg(F.sum("__part").alias("source_size"))
    targets = water_fill(cyclic_weights(totals, weights), max_epochs)
    slices_ = offsets.alias("o").join(
        targets.withColumnRenamed("source", "__s"), F.col("o.source").eqNullSafe(F.col("__s"))
    ).select("source", F.col("__slice").alias("__k"), "__offset", "source_size", "target")
    order = Window.partitionBy("__source", "__slice").orderBy("__order", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("__before", before).join(
        slices_, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__slice") == F.col("__k"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    fraction = F.col("target") - F.col("__epochs") * F.col("source_size")
    middle = F.col("__before") + F.col("__offset") + F.col("size") / 2
    return (
        placed.withColumn("__epochs", epochs.cast("long"))
        .withColumn("repeats", F.when(F.col("size") == 0, F.lit(0)).otherwise(
            F.col("__epochs") + F.when(middle <= fraction, 1).otherwise(0)).cast("int"))
        .withColumn("taken", F.col("repeats") * F.col("size"))
        .select("__row.*", "size", "source_size", "target", "repeats", "taken")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with ``copy`` counting from 1.

    All columns of the documents stay; a new one whose name a document column has gets ``mix_`` before it.
    """
    chosen = mixture(docs.withColumn("__all", F.struct(*docs.columns)), ("doc_id", "__all"), **options).where(F.col("repeats") > 0)
    name = lambda c: f"mix_{c}" if c in docs.columns else c
    return chosen.select(
        "__all.*", *[F.col(c).alias(name(c)) for c in ("size", "source_size", "target")],
        F.explode(F.sequence(F.lit(1), "repeats")).alias(name("copy")),
    )
