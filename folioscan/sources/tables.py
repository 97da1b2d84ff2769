"""Readers and writers: pages, chunk files, manifests, sessions, metrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.text import safe_id
from folioscan.session import stored

#: Declared schema of a chunk row; readers fail on rows that don't fit.
CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "act", "act_short", "chapter", "chapter_title", "section_number", "section_title", "subsection", "clause", "text")]
    + [T.StructField(n, T.BooleanType()) for n in ("has_illustration", "has_proviso", "has_exception")]
    + [T.StructField(n, T.IntegerType()) for n in ("page_start", "page_end")]
    + [T.StructField("source_uri", T.StringType()), T.StructField("ingested_at", T.StringType())]
    + [T.StructField("references", T.ArrayType(T.StringType())), T.StructField("needs_review", T.BooleanType())]
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunks under the declared schema."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Full rewrite as JSON lines, by id within files; the commit makes it all or nothing."""
    chunks.sortWithinPartitions("chunk_id").write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str, least: int = 25, most: int = 30, refusals: int = 5) -> DataFrame:
    """Golden questions; a set that breaks its constraints fails when it is read."""
    schema = "id string, question string, type string, expected_sections array<string>, must_refuse boolean, corpus string"
    golden = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    facts = golden.agg(
        F.count("*").alias("n"), F.sum(F.col("must_refuse").cast("int")).alias("r"),
        F.sum(F.when(F.col("must_refuse") & (F.size("expected_sections") > 0), 1).otherwise(0)).alias("bad"),
    ).first()
    if not (least <= facts["n"] <= most and (facts["r"] or 0) >= refusals and not facts["bad"]):
        raise ValueError(f"golden set breaks its constraints: {facts}")
    return golden


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """One row per form of a manifest document."""
    forms = "forms array<struct<form_number:int,title:string,source_page_start:int,source_page_end:int,output_filename:string,sha256:string>>"
    return spark.read.schema(forms).option("multiLine", True).json(path).select(F.explode("forms").alias("f")).select("f.*")


def read_binary(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Files up to a size with their digest; the size is asked before contents are read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes)
    return files.withColumn("sha256", F.sha2("content", 256))


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """Rows of one session of a table partitioned by session; other sessions' files aren't opened."""
    return spark.read.parquet(path).where(F.col("session_id") == session_id)


def write_sessions(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").partitionBy("session_id").parquet(path)


def replace_vectors(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Full replacement of the vector table: point id (from 1, by chunk id), embedding and the whole chunk as payload."""
    points = chunks.select("chunk_id", F.struct(*chunks.columns).alias("payload")).join(vectors.select("chunk_id", "embedding"), "chunk_id")
    # Ids without one task's sort: rows are sorted by range, and the sizes of the ranges before give each range its first id.
    ranged = points.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").withColumn("__p", F.spark_partition_id())
    placed = stored(ranged.withColumn("__m", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(F.broadcast(before.select("__p", "__first", "__before")), "__p")
    out.select((F.col("__before") + F.col("__m") - F.col("__first") + 1).alias("id"), "embedding", "payload").write.mode("overwrite").parquet(path)


def write_corpus(chunks: DataFrame, vectors: DataFrame, root: str, source: str, embedder: str, ingested_at: str) -> None:
    """Both sinks of an ingest from one stored table, and its manifest."""
    once = stored(chunks)
    write_chunks(once, f"{root}/chunks")
    replace_vectors(once, vectors, f"{root}/chunk_vectors")
    facts = once.agg(F.count("*").alias("chunks"), F.countDistinct("act_short", "section_number").alias("sections"), F.sort_array(F.collect_set("act_short")).alias("acts"))
    facts.select(F.lit(source).alias("source"), F.lit(embedder).alias("embedder"), F.lit(ingested_at).alias("ingested_at"), "*").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def replace_corpus(chunks: DataFrame, vectors: DataFrame, root: str, name: str, question: DataFrame, search, **facts) -> str:
    """Writes a corpus beside the one in use and names it current only if ``search(chunks, question)`` finds something.

    Where nothing is found the folder that was current stays so, and the job fails.
    """
    path = f"{root}/{name}"
    write_corpus(chunks, vectors, path, **facts)
    spark = chunks.sparkSession
    if search(read_chunks(spark, f"{path}/chunks"), question).isEmpty():
        raise ValueError(f"{path} doesn't answer the question that a corpus must answer")
    spark.createDataFrame([(name,)], "current string").coalesce(1).write.mode("overwrite").json(f"{root}/_current")
    return path


def write_summary(summary: DataFrame, cases: DataFrame, path: str) -> None:
    """An evaluation run: the figures of its configurations and the cases they come from."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    cases.write.mode("overwrite").json(f"{path}/cases")


def write_vector_cache(vectors: DataFrame, path: str, embedder: str) -> None:
    """Embeddings by text digest and embedder; a run's rows replace those of its embedder only."""
    (vectors.select("chunk_id", "text_sha256", "embedding", F.lit(embedder).alias("embedder")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("embedder").parquet(path))


def read_vector_cache(spark: SparkSession, path: str, embedder: str) -> DataFrame:
    """The rows of one embedder; other embedders' files aren't opened."""
    return spark.read.parquet(path).where(F.col("embedder") == embedder).drop("embedder")


def upload_paths(uploads: DataFrame, root: str) -> DataFrame:
    """Adds ``path`` of each upload (session_id, document_id); ids that aren't safe in a path fail the job."""
    safe = safe_id(F.col("session_id")) & safe_id(F.col("document_id"))
    path = F.concat(F.lit(root.rstrip("/") + "/"), "session_id", F.lit("/"), "document_id", F.lit(".pdf"))
    return uploads.withColumn("path", F.when(safe, path).otherwise(F.raise_error(F.lit("an id is not safe in a path"))))


def of_documents(chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Chunks (chunk_id) of the documents that are allowed; a chunk id names its document before "-p"."""
    own = F.split("chunk_id", "-p", 2)[0]
    return chunks.withColumn("__d", own).join(allowed.select(F.col("document_id").alias("__d")).distinct(), "__d", "left_semi").drop("__d")


def of_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of a dimension; the job fails where there are some but none of it."""
    fits = F.size("embedding") == dimension
    facts = vectors.agg(F.count(F.when(fits, 1)).alias("__ok"))
    # The condition needs both sides, so no row is dropped before the guard has seen it.
    wanted = F.when(F.col("__ok") == 0, F.raise_error(F.lit("EMBEDDING_MISMATCH")).cast("boolean")).otherwise(fits)
    return vectors.crossJoin(F.broadcast(facts)).where("embedding is not null").where(wanted).drop("__ok")


def without_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks whose document isn't in ``gone``."""
    return chunks.join(gone.select("document_id"), "document_id", "left_anti")


def forget_documents(chunks: DataFrame, owned: DataFrame, gone: DataFrame) -> DataFrame:
    """``chunks`` (session_id, chunk_id) without those of the documents in ``gone`` (session_id, document_id).

    ``owned`` (session_id, document_id, chunk_id) tells a document's chunks. A document that it has lost is found by its chunks' ids, which begin with its own
    id and a hyphen: every such beginning of a chunk's id meets the lost documents in an equi join.
    """
    named = owned.join(gone.select("session_id", "document_id").distinct(), ["session_id", "document_id"], "left_semi")
    lost = gone.select("session_id", "document_id").distinct().join(named, ["session_id", "document_id"], "left_anti")
    ends = F.filter(F.sequence(F.lit(1), F.length("chunk_id")), lambda i: F.substring(F.col("chunk_id"), i, F.lit(1)) == "-")
    begun = chunks.where(F.contains("chunk_id", F.lit("-"))).select("session_id", "chunk_id", F.explode(F.transform(ends, lambda i: F.substring(F.col("chunk_id"), F.lit(1), i - 1))).alias("document_id"))
    orphans = begun.join(lost, ["session_id", "document_id"], "left_semi").select("session_id", "chunk_id")
    return chunks.join(named.select("session_id", "chunk_id").union(orphans).distinct(), ["session_id", "chunk_id"], "left_anti")


def prometheus(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One text line per series: name{label="value",...} value, label values escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), escape(F.col(x).cast("string")), F.lit('"')) for x in labels])
    return metrics.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
