"""Queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import bpe as _bpe
from folioscan.llm import brown as _brown
from folioscan.llm import decontaminate as _decontaminate
from folioscan.llm import langid as _langid
from folioscan.llm import lexical as _lexical
from folioscan.llm import licenses as _licenses
from folioscan.llm import lines as _lines
from folioscan.llm import mixture as _mixture
from folioscan.llm import negatives as _negatives
from folioscan.llm import neighbours as _neighbours
from folioscan.llm import pii as _pii
from folioscan.llm import quality as _quality
from folioscan.llm import simhash as _simhash
from folioscan.llm.common import held_out, remainder
from folioscan.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture.mixture(_table(spark, sf_dir, "documents")).drop("repeats")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.dedup_report(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    learn = F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))
    return _langid.identify(docs, learn, ("doc_id", "held_out"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5, 1).alias("held_out"))
    return _brown.class_scores(docs, ~F.col("held_out"), ("doc_id", "held_out"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    learn = F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))
    return _quality.classify(docs, _table(spark, sf_dir, "labels"), learn, ("doc_id", "held_out"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii.find_pii(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return _bpe.encode(_table(spark, sf_dir, "documents"), path, pattern, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return _negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_class_lm": op4_class_lm,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_license_scan": op7_license_scan,
    "op8_simhash": op8_simhash,
    "op9_nearest": op9_nearest,
    "op10_decontaminate": op10_decontaminate,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
      FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, source_size, least(weight * water.level, cap::DOUBLE) AS target FROM l, water),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size
             THEN 1 ELSE 0 END END * size)::BIGINT AS taken
FROM p
"""

OP10_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS v),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, u, v), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark, low WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, len(g) AS n, array_to_string(g, ' ') AS g FROM (
          SELECT item, w[k:k + least(13, len(w)) - 1] AS g
          FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id,
             coalesce(regexp_extract_all(translate(text, u, v), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
      FROM documents, low),
g AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
o AS (SELECT DISTINCT r, p, g.n, item FROM g JOIN win ON g.g = win.g AND g.n = win.n),
h AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM o) GROUP BY r),
m AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'),
                            (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(q, label)),
h AS (SELECT r, k - 1 AS pos, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d), p
      WHERE w[k:k + len(q) - 1] = q)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(l, '') AS base_labels
FROM d LEFT JOIN (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l
                  FROM h GROUP BY r) USING (r)
"""

OP12_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS v),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), u, v), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents, low),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
      FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
      FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c),
q AS (SELECT item_id, term, count(*)::BIGINT AS qtf FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, u, v), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark), low) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

OP13_SQL = """
WITH e AS (SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, v FROM (
             SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
             WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
               AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.id, s.score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= 10
"""

#: The base columns of op7 only; what the automaton adds is tested against brute force.
BASE_SQL = {"op7_license_scan": OP7_SQL}

ORACLE_SQL = {"op1_mix_sources": OP1_SQL, "op10_decontaminate": OP10_SQL, "op12_ranked_search": OP12_SQL, "op13_hard_negatives": OP13_SQL}
