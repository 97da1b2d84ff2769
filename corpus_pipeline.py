"""The corpus pipeline: stages that clean and mix a documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the rows are written
as Parquet to the shared folder and read again, which cuts lineage.

Cases: columns other than doc_id, text, lang, source and n_chars travel along, whatever their names; rows of one doc_id, or of none, are
documents of their own; an empty table gives an empty one from every stage. What each stage makes of nulls, empty and very long texts, ties
and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontaminate as _decontaminate
from folioscan.llm import langid as _langid
from folioscan.llm import lines as _lines
from folioscan.llm import mixture as _mixture
from folioscan.llm import simhash as _simhash
from folioscan.llm.common import materialize, remainder


#: The least probability of its likeliest language that a document needs to stay.
LEAST_SURE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or none that the network gives ``LEAST_SURE`` or more.

    A null or empty text goes; a null language or id is no reason to go; repeated rows share their fate; a very long text is judged by windows over all of it.
    """
    learn = F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))
    # Whole rows go through as a struct: no column's name can clash with the prediction's.
    carried = docs.withColumn("__row", F.struct(*docs.columns))
    return _langid.identify(carried, learn, ("__row",)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select("__row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of similar lines, over all documents; every document stays, though it may be left without lines.

    A null text stays null, an empty one empty; of rows that are repeated whole each keeps the same lines; of equal lines the one in the smallest doc_id
    stays, a null id comes last.
    """
    return _lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the smallest doc_id, of rows that share it one.

    Null and empty texts have no words and are one group; rows without a doc_id can't be named and stay.
    """
    return _simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items contaminate: a twentieth or more of their words within windows of items.

    A null or empty text has no words and stays, as does all where the benchmark is empty; repeated rows share their fate.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    carried = docs.withColumn("__row", F.struct(*docs.columns))
    return _decontaminate.decontaminate(carried, benchmark, ("__row",)).where("not contaminated").select("__row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that each source comes to its target size; a column ``copy`` counts a document's repetitions.

    Null and empty texts have no size and are not taken; a null source is a source; reruns take the same documents.
    """
    return _mixture.mixed_rows(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
]

#: The stages train a model and follow hashes that SQL has no twin of.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
