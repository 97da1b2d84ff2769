"""Which uploads of a session a question points at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import dialogue


def resolve(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(session_id, query_id, outcome, document_id): the documents that each question is about.

    ``queries`` has (session_id, query_id, text, context), the context being ids that the conversation cited;
    ``documents`` has (session_id, document_id, filename, position from 1). Outcomes: ``documents`` with one row per
    document; ``all``, ``ambiguous`` and ``no_such_document`` with one row and no id. "Other" comes before "all",
    then places and file names, then "this document". "Previous" with one upload means that upload.

    Questions meet the uploads of their own session only; what the uploads of a question say together are windows.
    """
    t = F.col("__t")
    asked = queries.select("session_id", "query_id", "text", F.coalesce("context", F.array().cast("array<string>")).alias("__c"), dialogue.words(F.col("text")).alias("__t"))
    asked = asked.select(
        "*", dialogue.ordinals(t).alias("__o"), dialogue.mentions(t, dialogue.LATEST).alias("__last"), dialogue.mentions(t, dialogue.PREVIOUS).alias("__prev"),
        dialogue.mentions(t, dialogue.OTHER).alias("__other"), dialogue.mentions(t, dialogue.EVERY).alias("__all"), dialogue.deictic(t).alias("__this"),
    )
    pairs = asked.join(documents.select("session_id", F.col("document_id").cast("string").alias("document_id"), "filename", (F.col("position") - 1).alias("__p")), "session_id", "left")
    one = Window.partitionBy("session_id", "query_id")
    total = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))).over(one)
    n = F.count("document_id").over(one)
    p, size = F.col("__p"), F.col("__n")
    picked = (
        F.array_contains("__o", p) | (F.col("__last") & (p == size - 1)) | (F.col("__prev") & (p == F.greatest(size - 2, F.lit(0))))
        | dialogue.names_file(F.col("text"), F.col("filename"))
    )
    known = F.array_contains("__c", F.col("document_id"))
    judged = pairs.withColumn("__n", n).withColumn("__pick", F.coalesce(picked, F.lit(False))).withColumn("__known", F.coalesce(known, F.lit(False)))
    judged = judged.withColumn("__np", total(F.col("__pick"))).withColumn("__nk", total(F.col("__known")))
    placed = (F.size("__o") > 0) | ((F.col("__last") | F.col("__prev")) & (size > 0)) | (F.col("__np") > 0)
    rest = size - F.col("__nk")
    outcome = (
        F.when(F.col("__other"), F.when((F.col("__nk") > 0) & (rest == 1), "documents").otherwise("ambiguous")).when(F.col("__all"), "all")
        .when(placed, F.when(F.col("__np") > 0, "documents").otherwise("no_such_document"))
        .when(F.col("__this"), F.when((size == 1) | (F.col("__nk") == 1), "documents").when(size == 0, "no_such_document").otherwise("ambiguous"))
        .otherwise("all")
    )
    mine = F.when(F.col("__other"), ~F.col("__known")).when(placed, F.col("__pick")).otherwise((size == 1) | F.col("__known"))
    first = F.row_number().over(one.orderBy("__p")) == 1
    out = judged.withColumn("outcome", outcome).withColumn("__mine", mine).withColumn("__first", first)
    ids = F.when(F.col("outcome") == "documents", F.col("document_id"))
    return out.where(F.when(F.col("outcome") == "documents", F.col("__mine")).otherwise(F.col("__first"))).select("session_id", "query_id", "outcome", ids.alias("document_id"))
