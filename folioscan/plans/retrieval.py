"""Index, ranking, fusion and evaluation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions.text import LAYMAN, STOPWORDS, TITLE_SUFFIXES, title_token
from folioscan.functions.vectors import hashing_embedding
from folioscan.operators import evaluation, index, ranking, sessions
from folioscan.session import spread

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name == "documents" else df


def dealt(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose rows are much work each: dealt over all cores where the file has few splits."""
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYMAN.items())


def terms_sql(name: str, source: str, key: str) -> str:
    """CTEs that end in ``name`` (key, term), one row per token occurrence."""
    return rf"""
{name}0 AS (SELECT {key}, t FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\([0-9]+\))?')) AS t
            FROM {source}) WHERE t NOT IN ({_STOP})),
{name}1 AS (SELECT {key}, t, regexp_matches(t, '^[0-9]') OR length(t) <= 3 OR regexp_matches(t, '[0-9]$') AS f,
            CASE WHEN ends_with(t, 'ies') AND length(t) >= 5 THEN left(t, length(t) - 3) || 'y'
                 WHEN ends_with(t, 'sses') OR (ends_with(t, 'es') AND length(t) >= 5) THEN left(t, length(t) - 2)
                 WHEN ends_with(t, 's') AND NOT regexp_matches(t, '(ss|us|is)$') THEN left(t, length(t) - 1) ELSE t END AS s FROM {name}0),
{name}2 AS (SELECT {key}, t, f, s, CASE WHEN ends_with(s, 'ing') AND length(s) >= 6 THEN left(s, length(s) - 3)
                 WHEN ends_with(s, 'ed') AND length(s) >= 5 THEN left(s, length(s) - 2) END AS b FROM {name}1),
{name}3 AS (SELECT {key}, t, f, CASE WHEN b IS NOT NULL THEN CASE WHEN length(b) >= 2 AND right(b, 1) = substring(b, length(b) - 1, 1)
                   AND right(b, 1) NOT IN ('l', 's', 'z') THEN left(b, length(b) - 1) ELSE b END
                 WHEN ends_with(s, 'ly') AND length(s) >= 6 THEN left(s, length(s) - 2) ELSE s END AS e FROM {name}2),
{name}4 AS (SELECT {key}, CASE WHEN f THEN t WHEN ends_with(e, 'e') AND length(e) >= 4 THEN left(e, length(e) - 1) ELSE e END AS z FROM {name}3),
{name} AS (SELECT {key}, CASE z {_MAP} ELSE z END AS term FROM {name}4)"""


_DOC_TERMS = terms_sql("dt", "documents", "doc_id")
_POST = f"{_DOC_TERMS}, post AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL)"
_ITEMS = "items AS (SELECT item_id AS query_id, text FROM benchmark)"
_BM25 = f"""{_POST}, {_ITEMS}, {terms_sql("qt", "items", "query_id")},
q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM q JOIN df USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("tokenize_docs", f"WITH {_DOC_TERMS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_distinct FROM dt GROUP BY doc_id")
def tokenize_docs(spark, d):
    return index.postings(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query("term_freq", f"WITH {_POST} SELECT doc_id, term, tf FROM post")
def term_freq(spark, d):
    return index.postings(table(spark, d, "documents"))


@query("doc_freq", f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(spark, d):
    return index.document_frequency(index.postings(table(spark, d, "documents")))


@query("corpus_stats", f"""WITH {_POST} SELECT (SELECT count(*) FROM documents) AS n_docs, sum(tf)::BIGINT AS n_tokens,
    sum(tf)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl FROM post""")
def corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    return index.corpus_stats(docs, index.postings(docs))


_TOP = "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0} WHERE score > 0) WHERE rank <= {1}"


@query("bm25_topk", f"WITH {_BM25} {_TOP.format('bm', 10)}")
def bm25_topk(spark, d):
    return index.top_k(index.bm25(_queries(spark, d), table(spark, d, "documents")), 10)


@query("bm25_filtered_global_idf", f"WITH {_BM25}, fl AS (SELECT bm.* FROM bm JOIN documents USING (doc_id) WHERE lang = 'fr') {_TOP.format('fl', 10)}")
def bm25_filtered(spark, d):
    docs = table(spark, d, "documents")
    return index.top_k(index.bm25(_queries(spark, d), docs, scored=docs.where(ranking.matches(lang="fr"))), 10)


_COS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS q_label, round(list_dot_product(q.e, v.e)
      / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
      FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"""


def _cosine(spark, d, k: int) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.cosine_topk(q, v, k)


@query("cosine_topk", f"""WITH {_COS} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM c WHERE score > 0) WHERE rank <= 10""")
def cosine_topk(spark, d):
    return _cosine(spark, d, 10).where("score > 0")


@query("max_similarity", f"WITH {_COS} SELECT query_id, max(score) AS best, least(1.0, greatest(0.0, round((max(score) - 0.48) / 0.12, 6)))::DOUBLE AS band FROM c GROUP BY query_id")
def max_similarity(spark, d):
    best = _cosine(spark, d, 1).select("query_id", F.col("score").alias("best"))
    return best.withColumn("band", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round((F.col("best") - 0.48) / 0.12, 6))))


_HASH = r"""hc AS (SELECT doc_id, ('0x' || substring(sha256(term), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM dt GROUP BY ALL)"""


@query("hashing_embed", f"WITH {_DOC_TERMS}, {_HASH} SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM hc")
def hashing_embed(spark, d):
    return hashing_embedding(index.terms(table(spark, d, "documents")), "doc_id").withColumn("weight", F.round("weight", 6))


_LEX = r"""lq AS (SELECT query_id, 'src' || (query_id % 20) AS session, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'),
         lambda t: t NOT IN ('what','who','is','are','the','a','an','of','to','in','and','or','on','for'))) AS q FROM items),
lc AS (SELECT doc_id, source AS session, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'),
         lambda t: t NOT IN ('what','who','is','are','the','a','an','of','to','in','and','or','on','for'))) AS c FROM documents),
lx AS (SELECT lq.session, query_id, doc_id AS chunk_id, round(len(list_intersect(q, c))::DOUBLE / len(q) * (1.0 / (1.0 + 0.01 * sqrt(len(c)))), 9) AS score
       FROM lq JOIN lc USING (session) WHERE len(list_intersect(q, c)) > 0)"""


def _lexical(spark, d) -> DataFrame:
    q = _queries(spark, d).withColumn("session", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    c = table(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("chunk_id"), "text")
    return sessions.lexical_scores(q, c, ["session"])


@query("lexical_overlap", f"WITH {_ITEMS}, {_LEX} SELECT session, query_id, chunk_id, score FROM lx")
def lexical_overlap(spark, d):
    return _lexical(spark, d)


_RRF = f"""WITH {_BM25}, {_LEX}, a AS ({_TOP.format('bm', 20)}),
b0 AS (SELECT query_id, chunk_id AS doc_id, score FROM lx), b AS ({_TOP.format('b0', 20)}),
u AS (SELECT query_id, doc_id, 0 AS l, rank AS r FROM a UNION ALL SELECT query_id, doc_id, 1, rank FROM b),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf_score, min(l * 1000000 + r) AS first_seen,
             min(r) FILTER (l = 0) AS sparse_rank, min(r) FILTER (l = 1) AS lexical_rank FROM u GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first_seen) AS rank FROM f)"""


def _fused(spark, d, sparse: DataFrame | None = None) -> DataFrame:
    """Sparse and lexical lists fused; ``sparse``, the first 20 rows of each question's sparse list, where it is there already."""
    if sparse is None:
        sparse = index.top_k(index.bm25(_queries(spark, d), table(spark, d, "documents")), 20)
    lexical = index.top_k(_lexical(spark, d).withColumnRenamed("chunk_id", "doc_id").select("query_id", "doc_id", "score"), 20)
    fused = ranking.fuse([("sparse", sparse), ("lexical", lexical)])
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first_seen")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


@query("rrf_fusion", _RRF + """ SELECT query_id, doc_id, rrf_score, sparse_rank, lexical_rank, rank,
    CASE WHEN sparse_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'hybrid' WHEN sparse_rank IS NOT NULL THEN 'sparse' ELSE 'lexical' END AS source FROM k WHERE rank <= 10""")
def rrf_fusion(spark, d):
    source = F.when(F.col("sparse_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "hybrid").when(F.col("sparse_rank").isNotNull(), "sparse")
    return _fused(spark, d).where("rank <= 10").drop("first_seen").withColumn("source", source.otherwise("lexical"))


@query("hybrid_confidence", _RRF + " SELECT query_id, count(*) AS n, round(least(max(rrf_score) / (2.0::DOUBLE / 61), 1.0), 6) AS confidence, max(rrf_score) / (2.0::DOUBLE / 61) >= 0.1 AS sufficient FROM k WHERE rank <= 10 GROUP BY query_id")
def hybrid_confidence(spark, d):
    top = _fused(spark, d).where("rank <= 10").groupBy("query_id").agg(F.count("*").alias("n"), F.max("rrf_score").alias("t"))
    c = ranking.confidence(F.col("t"))
    return top.select("query_id", "n", F.round(c, 6).alias("confidence"), (c >= 0.1).alias("sufficient"))


_EXPECT = "ex AS (SELECT i.item_id AS query_id, doc_id FROM benchmark i JOIN documents d ON d.doc_id % 97 = i.item_id % 97)"


@query("recall_at_k", f"""WITH {_BM25}, r AS ({_TOP.format('bm', 10)}), {_EXPECT} SELECT query_id,
    sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS recall_at_5, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS recall_at_10,
    coalesce(1.0::DOUBLE / min(rank), 0.0) AS reciprocal_rank FROM ex LEFT JOIN r USING (query_id, doc_id) GROUP BY query_id""")
def recall_at_k(spark, d):
    docs = table(spark, d, "documents")
    expected = _queries(spark, d).join(docs.select("doc_id"), F.col("doc_id") % 97 == F.col("query_id") % 97).select("query_id", "doc_id")
    return evaluation.recall_and_rank(expected, index.top_k(index.bm25(_queries(spark, d), docs), 10))


_SUFFIX = " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 3 THEN left(w, length(w) - {len(s)})" for s in TITLE_SUFFIXES)


@query("df_weights", f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM documents),
    t AS (SELECT DISTINCT doc_id, CASE {_SUFFIX} ELSE w END AS token FROM w)
    SELECT token, count(*) AS df, CASE WHEN count(*) / (SELECT count(*) FROM documents)::DOUBLE <= 0.05 THEN 1.0::DOUBLE
      WHEN count(*) / (SELECT count(*) FROM documents)::DOUBLE <= 0.15 THEN 0.3::DOUBLE ELSE 0.05::DOUBLE END AS weight FROM t GROUP BY token""")
def df_weights(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    df = words.select("doc_id", title_token(F.col("w")).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("df"))
    share = F.col("df") / F.col("n")
    weight = F.when(share <= 0.05, 1.0).when(share <= 0.15, 0.3).otherwise(0.05)
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("token", "df", weight.alias("weight"))
