"""Postings, corpus statistics and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import raw_tokens, stem
from folioscan.session import stored

K1 = 1.5
B = 0.75


def terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term): one row per token occurrence."""
    return docs.select(key, F.explode(raw_tokens(F.col(text))).alias("token")).select(key, stem(F.col("token")).alias("term"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return terms(docs, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def lengths(post: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, dl): tokens per document that has any."""
    return post.groupBy(key).agg(F.sum("tf").alias("dl"))


def corpus_stats(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row (n_docs, n_tokens, avgdl); avgdl 0 for an empty corpus."""
    n = docs.agg(F.count("*").alias("n_docs"))
    t = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    avg = F.when(F.col("n_docs") == 0, F.lit(0.0)).otherwise(F.col("n_tokens") / F.col("n_docs"))
    return n.crossJoin(t).withColumn("avgdl", avg)


def bm25(queries: DataFrame, docs: DataFrame, key: str = "doc_id", query: str = "query_id", scored: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(query, key, score) of all documents that share a term with the query.

    ``queries`` has (query, text). Statistics are those of ``docs``; ``scored``, a subset of keys, limits what is
    scored but never the statistics. Repeated query terms count each time.
    """
    q = terms(queries, query).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    # Texts are cut into tokens once, and stored; only distinct tokens are stemmed, and of these the few that asked terms come from meet the documents.
    tokens = stored(docs.select(key, raw_tokens(F.col(text)).alias("t")))
    words = tokens.select(F.explode("t").alias("token")).distinct().select("token", stem(F.col("token")).alias("term"))
    asked = stored(words.join(q.select("term").distinct(), "term", "left_semi"))
    found = tokens.select(key, F.size("t").alias("dl"), F.explode("t").alias("token")).join(asked, "token")
    post = stored(found.groupBy(key, "dl", "term").agg(F.count("*").alias("tf")))
    stats = tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("n_tokens"))
    stats = stats.select("n_docs", F.when(F.col("n_docs") == 0, F.lit(0.0)).otherwise(F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))
    hit = post if scored is None else post.join(scored.select(key).distinct(), key, "left_semi")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # A term's weight is worked out once, and a posting's before it meets the questions; the one row of totals is broadcast.
    weights = document_frequency(post).crossJoin(F.broadcast(stats)).select("term", "n_docs", "avgdl", idf.alias("idf"))
    impact = hit.join(weights, "term").select(key, "term", (F.col("idf") * saturated).alias("impact"))
    return impact.join(q, "term").groupBy(query, key).agg(F.sum(F.col("qtf") * F.col("impact")).alias("score"))


def top_k(scores: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", positive: bool = True) -> DataFrame:
    """Per query the k best by score rounded to 6 places, ties to the smaller key, with rank from 1."""
    rounded = scores.withColumn("score", F.round("score", 6))
    rounded = rounded.where(F.col("score") > 0) if positive else rounded
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return rounded.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(query, key, "score", "rank")
