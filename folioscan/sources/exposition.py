"""Metrics as text: counters, gauges and cumulative histograms in the Prometheus exposition format.

A metric's series are few (one per combination of labels), so its lines are made after aggregation; they carry what orders them, and are
sorted once when the text is written.

Cases: a null label is empty; an empty metric has its two heading lines; NaN and infinite values are written as nan, inf and -inf.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def general(value: Column) -> Column:
    """A number with six digits that count, as "%g" writes it; null stays null.

    Built-in formats round ties by the shortest decimal, not by the number itself, so this is done in Arrow batches: of series, which are few.
    """

    @F.pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        return pd.Series([f"{x:g}" for x in values], dtype="object")

    return F.when(value.isNotNull(), written(F.coalesce(value.cast("double"), F.lit(0.0))))


def escaped(value: Column) -> Column:
    """A label's value with backslashes, quotes and line feeds escaped."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _braces(labels: list[str], *more: Column) -> Column:
    pairs = [F.concat(F.lit(f'{x}="'), escaped(F.col(x)), F.lit('"')) for x in labels] + [F.concat(F.lit('le="'), m, F.lit('"')) for m in more]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("")


def _key(labels: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in labels]).cast("array<string>")


def _headed(spark: SparkSession, name: str, kind: str, about: str, rows: DataFrame) -> DataFrame:
    heading = spark.createDataFrame([(name, [], -2, f"# HELP {name} {about}"), (name, [], -1, f"# TYPE {name} {kind}")], "name string, labels array<string>, place int, line string")
    return heading.union(rows.select(F.lit(name), "labels", "place", "line"))


def expose_values(series: DataFrame, name: str, about: str, labels: list[str], value: str, kind: str = "counter") -> DataFrame:
    """(name, labels, place, line) of a counter or gauge: one row of ``series`` per combination of labels."""
    line = F.concat(F.lit(name), _braces(labels), F.lit(" "), general(F.col(value)))
    return _headed(series.sparkSession, name, kind, about, series.select(_key(labels).alias("labels"), F.lit(0).alias("place"), line.alias("line")))


def expose_histogram(observed: DataFrame, name: str, about: str, labels: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(name, labels, place, line) of a histogram over rows: a cumulative line per bound and one without bound, then count and sum.

    One aggregation counts all buckets; rows without a value count nowhere.
    """
    wide = observed.groupBy(*labels).agg(F.count(value).alias("__n"), F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("__sum"),
                                         *[F.count(F.when(F.col(value) <= b, 1)).alias(f"__b{i}") for i, b in enumerate(bounds)])
    wide = wide.where("__n > 0")
    said = lambda suffix, braces, number: F.concat(F.lit(name + suffix), braces, F.lit(" "), general(F.col(number)))
    lines = [said("_bucket", _braces(labels, F.lit(f"{b:g}")), f"__b{i}") for i, b in enumerate(bounds)]
    lines += [said("_bucket", _braces(labels, F.lit("+Inf")), "__n"), said("_count", _braces(labels), "__n"), said("_sum", _braces(labels), "__sum")]
    rows = wide.select(_key(labels).alias("labels"), F.posexplode(F.array(*lines)).alias("place", "line"))
    return _headed(observed.sparkSession, name, "histogram", about, rows)


def exposition(metrics: list[DataFrame]) -> DataFrame:
    """(line) of all metrics, sorted by name, then labels; the heading of a metric comes first."""
    rows = reduce(DataFrame.unionByName, metrics)
    return rows.orderBy("name", F.col("place") >= 0, "labels", "place").select("line")


def write_exposition(metrics: list[DataFrame], path: str) -> None:
    """The text as one file in order; it has a line per series and bound, whatever the number of events."""
    exposition(metrics).coalesce(1).write.mode("overwrite").text(path)
