"""Documents of a session: upload order, lexical search, fused search, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import lexical_tokens
from folioscan.functions.vectors import hashing_embedding
from folioscan.operators import index
from folioscan.operators.workflow import session_fused


def positions(documents: DataFrame) -> DataFrame:
    """Adds the 1-based upload position within the session."""
    return documents.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "document_id")))


def lexical_scores(queries: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, query_id, chunk_id, score): share of query words present, with a mild length penalty.

    ``by`` are the columns that query and chunk must share; only shared words meet in the join.
    """
    q = queries.select(*by, "query_id", lexical_tokens(F.col("text")).alias("__q"))
    q = q.select(*by, "query_id", F.size("__q").alias("__nq"), F.explode("__q").alias("word"))
    c = chunks.select(*by, "chunk_id", lexical_tokens(F.col("text")).alias("__c"))
    c = c.select(*by, "chunk_id", F.size("__c").alias("__nc"), F.explode("__c").alias("word"))
    hits = q.join(c, [*by, "word"]).groupBy(*by, "query_id", "chunk_id", "__nq", "__nc").agg(F.count("*").alias("n"))
    score = F.col("n") / F.col("__nq") * (1.0 / (1.0 + 0.01 * F.sqrt("__nc")))
    return hits.select(*by, "query_id", "chunk_id", F.round(score, 9).alias("score"))


def hashed_scores(queries: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, query_id, chunk_id, score): cosine of the hashed vectors; pairs meet on (by, bucket), so what shares no bucket isn't compared."""
    q = hashing_embedding(index.terms(queries.withColumn("__id", F.struct(*by, "query_id")), "__id"), "__id").select(*[f"__id.{c}" for c in (*by, "query_id")], "bucket", F.col("weight").alias("__q"))
    c = hashing_embedding(index.terms(chunks.withColumn("__id", F.struct(*by, "chunk_id")), "__id"), "__id").select(*[f"__id.{c}" for c in (*by, "chunk_id")], "bucket", F.col("weight").alias("__c"))
    return q.join(c, [*by, "bucket"]).groupBy(*by, "query_id", "chunk_id").agg(F.round(F.sum(F.col("__q") * F.col("__c")), 6).alias("score"))


def search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, scope: DataFrame | None = None, dense: DataFrame | None = None, dense_k: int = 8, lexical_k: int = 10) -> DataFrame:
    """(session_id, query_id, place, chunk_id, document_id, score, filename, position): what a session's documents have for its questions.

    ``queries`` has (session_id, query_id, text), ``chunks`` (session_id, document_id, chunk_id, text), ``documents`` (session_id,
    document_id, filename, created_at); ``scope`` (query_id, document_id) the documents that a question names, all of which share one budget;
    ``dense`` (session_id, query_id, chunk_id, score) similarities in place of the hashed vectors'. The dense and the lexical list are fused
    within the dense list's budget. Where a question names documents and nothing in them fits, their first chunks stand in. Rows
    go by the score that they report, the dense one or else the lexical one, then by their place in the fused list. Nothing crosses sessions.
    """
    by = ["session_id"]
    owner = chunks.select("session_id", "chunk_id", "document_id")

    def within(rows: DataFrame) -> DataFrame:
        """Rows of questions that name no document, and of the named documents of those that do."""
        if scope is None:
            return rows
        named = scope.select("query_id").distinct().withColumn("__named", F.lit(True))
        told = rows.join(named, "query_id", "left").join(scope.select("query_id", "document_id").distinct().withColumn("__in", F.lit(True)), ["query_id", "document_id"], "left")
        return told.where("__named is null or __in").drop("__named", "__in")

    def best(scored: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("session_id", "query_id").orderBy(F.desc("score"), "chunk_id")
        rows = within(scored.where("score > 0").join(owner, ["session_id", "chunk_id"]))
        return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    near = best(dense if dense is not None else hashed_scores(queries, chunks, by), dense_k)
    words = best(lexical_scores(queries, chunks, by), lexical_k)
    keys = ["session_id", "query_id", "chunk_id"]
    found = session_fused(near, words, ["session_id", "query_id"]).select(*keys, F.col("rank").alias("__rank"))
    if scope is not None:
        lost = queries.select("session_id", "query_id").join(scope.select("query_id").distinct(), "query_id", "left_semi").join(found, ["session_id", "query_id"], "left_anti")
        own = lost.join(scope.select("query_id", "document_id").distinct(), "query_id").join(owner, ["session_id", "document_id"])
        first = own.withColumn("__rank", F.row_number().over(Window.partitionBy("session_id", "query_id").orderBy("chunk_id")).cast("long"))
        found = found.unionByName(first.where(F.col("__rank") <= dense_k).select(*keys, "__rank"))
    scored = found.join(near.select(*keys, F.col("score").alias("__d")), keys, "left").join(words.select(*keys, F.col("score").alias("__l")), keys, "left")
    scored = scored.withColumn("score", F.coalesce("__d", "__l", F.lit(0.0))).join(owner, ["session_id", "chunk_id"])
    names = positions(documents).select("session_id", "document_id", "filename", "position")
    order = Window.partitionBy("session_id", "query_id").orderBy(F.desc("score"), "__rank")
    out = scored.join(names, ["session_id", "document_id"], "left").withColumn("place", F.row_number().over(order).cast("long"))
    return out.select("session_id", "query_id", "place", "chunk_id", "document_id", "score", "filename", "position")


def cache_delta(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """Chunks whose vector must be made anew: no cached row has their id and text digest."""
    fresh = chunks.select("chunk_id", F.sha2("text", 256).alias("text_sha256"))
    return fresh.join(cached.select("chunk_id", "text_sha256"), ["chunk_id", "text_sha256"], "left_anti")


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
