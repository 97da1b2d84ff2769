"""Citation labels of answers and the sources they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Forms of labels.
LABEL = r"\[([A-Za-z][^\]\[]{1,80}?)\]"
STATUTE = r"(?i)^([A-Za-z]{2,6})\s+s\.(\d+)"
FILE = r"(?i)^Document\s+(\S+?)(?:\s+p\.(\d+))?$"


def labels(text: Column) -> Column:
    """The distinct statute and document labels of an answer, without brackets, in order of first appearance."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LABEL), F.lit(1)), F.trim)
    return F.array_distinct(F.filter(found, lambda x: x.rlike(STATUTE) | x.rlike(FILE)))


def _section(label: Column) -> Column:
    return F.when(label.rlike(STATUTE), F.concat(F.lower(F.regexp_extract(label, STATUTE, 1)), F.lit(" s."), F.regexp_extract(label, STATUTE, 2)))


def _file(label: Column) -> Column:
    return F.when(label.rlike(FILE), F.regexp_extract(label, FILE, 1))


def match_labels(answers: DataFrame, sources: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, pos, label, source_no) of every label: the source it stands for, null if none.

    ``sources`` has (key, source_no, citation, source_type, page_start, page_end), in the order of source_no. A source of the same
    label comes first, then one of the same section whatever its subsections, then a user's document of the same id whose pages hold the label's page, then
    any chunk of that document; among equals the first. Labels and sources meet in one equi join on what they may share; no label is compared
    with a source of another answer.
    """
    asked = answers.select(key, F.posexplode(labels(F.col(text))).alias("pos", "label"))
    page = F.nullif(F.regexp_extract("label", FILE, 2), F.lit("")).cast("long")
    meets = lambda label, file: F.array_compact(F.array(F.concat(F.lit("="), label), F.concat(F.lit("s:"), _section(label)), F.concat(F.lit("d:"), file)))
    own = F.trim(F.regexp_replace("citation", r"^\[|\]$", ""))
    s = sources.withColumn("__own", own).withColumn("__file", F.when(F.col("source_type") == "user_document", _file(F.col("__own"))))
    s = s.select(F.col(key).alias("__key"), "source_no", "page_start", "page_end", F.explode(F.array_distinct(meets(F.col("__own"), F.col("__file")))).alias("__by"))
    a = asked.withColumn("__page", page).withColumn("__meet", F.explode(F.array_distinct(meets(F.col("label"), _file(F.col("label"))))))
    covers = F.coalesce(F.col("__page").between(F.col("page_start"), F.col("page_end")), F.lit(False))
    rank = F.when(F.startswith("__by", F.lit("=")), 0).when(F.startswith("__by", F.lit("s:")), 1).when(covers, 2).otherwise(3)
    met = a.join(s, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__meet") == F.col("__by"))).select(key, "pos", "label", "source_no", rank.alias("__r"))
    first = Window.partitionBy(key, "pos").orderBy("__r", "source_no")
    best = met.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(F.col(key).alias("__key"), F.col("pos").alias("__pos"), "source_no")
    return asked.join(best, F.col(key).eqNullSafe(F.col("__key")) & (F.col("pos") == F.col("__pos")), "left").select(key, "pos", "label", "source_no")
