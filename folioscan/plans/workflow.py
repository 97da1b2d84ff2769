"""Queries of the workflow operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import workflow
from folioscan.plans.retrieval import dealt, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


@query("inspect_pages", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN (o_custkey % 50)::INT END AS form_number,
    CASE WHEN o_orderkey % 4 = 1 AND o_orderpriority NOT IN ('2-HIGH', '5-LOW') THEN o_orderpriority END AS title, CASE o_orderkey % 4 WHEN 0 THEN 0.0::DOUBLE
    WHEN 1 THEN CASE WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END WHEN 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
    o_orderkey % 4 <> 0 AS has_text FROM orders""")
def inspect_pages(spark, d):
    head = F.concat(F.lit("FORM No. "), (F.col("o_custkey") % 50).cast("string"))
    m = F.col("o_orderkey") % 4
    lines = F.when(m == 0, F.array(F.lit(" "))).when(m == 1, F.array(F.lit(""), F.lit("12"), head, F.lit("(See section 4)"), F.col("o_orderpriority"))).when(
        m == 2, F.array(F.lit("a"), F.lit("b"), head)).otherwise(F.array(F.lit("no header"), F.lit("here")))
    return table(spark, d, "orders").select("o_orderkey", workflow.inspect_page(lines).alias("p")).select("o_orderkey", "p.*")


@query("forms_search",
       """WITH f AS (SELECT p_partkey, p_name, string_split_regex(lower(p_name), '[^a-z0-9]+') AS w FROM part),
    q AS (SELECT n_nationkey AS query_id, lower(p_name) AS q, list_distinct(w) AS w, w AS o FROM nation JOIN f ON p_partkey = n_nationkey + 1)
    SELECT query_id, p_partkey AS form_number, CASE WHEN contains(lower(p_name), q) THEN 500000 ELSE len(q.w) * 100 + CASE WHEN list_sort(list_transform(q.o, lambda x: list_position(f.w, x))) = list_transform(q.o, lambda x: list_position(f.w, x)) THEN 50 ELSE 0 END END::BIGINT AS score
    FROM q, f WHERE contains(lower(p_name), q) OR list_has_all(f.w, q.w)""")
def forms_search(spark, d):
    part = dealt(spark, d, "part")
    q = table(spark, d, "nation").join(part, F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.col("n_nationkey").alias("query_id"), F.col("p_name").alias("query"))
    return workflow.search_forms(q, part.select(F.col("p_partkey").alias("form_number"), F.col("p_name").alias("title")))


@query("form_filenames", """SELECT o_orderkey, n || CASE WHEN r > 1 THEN '-' || r ELSE '' END || '.pdf' AS filename FROM (SELECT o_orderkey, 'FORM-' || o_custkey % 40 AS n,
    row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS r FROM orders)""")
def form_filenames(spark, d):
    name = F.concat(F.lit("FORM-"), (F.col("o_custkey") % 40).cast("string"))
    return workflow.unique_names(table(spark, d, "orders"), name, ["o_orderkey"]).select("o_orderkey", "filename")


@query("remaining_stages", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'PARSING,CHUNKING,EMBEDDING,INDEXING,READY' WHEN 1 THEN 'CHUNKING,EMBEDDING,INDEXING,READY' WHEN 2 THEN 'EMBEDDING,INDEXING,READY'
    WHEN 3 THEN 'INDEXING,READY' WHEN 4 THEN 'READY' ELSE '' END AS stages FROM orders""")
def remaining_stages(spark, d):
    status = F.get(F.array(*[F.lit(s) for s in (*workflow.STAGES, "FAILED")]), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(workflow.remaining_stages(status), ",").alias("stages"))


@query("retry_delay", """SELECT l_orderkey, l_linenumber, l_partkey, least(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.5::DOUBLE * pow(2.0::DOUBLE, l_linenumber - 1) END, 5.0::DOUBLE) AS delay FROM lineitem""")
def retry_delay(spark, d):
    asked = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", workflow.retry_delay(F.col("l_linenumber"), asked).alias("delay"))


@query("redact_fields", """SELECT event_id, event_type AS kind, '***redacted***' AS a, '***redacted***' AS b, '***redacted***' AS c, user_id::VARCHAR AS d, '***redacted***' AS my_password,
    CASE WHEN event_id % 2 = 0 THEN '***redacted***' ELSE 'plain' END AS note FROM events""")
def redact_fields(spark, d):
    fields = F.create_map(F.lit("Api_Token"), F.lit("x"), F.lit("APIKEY"), F.lit("y"), F.lit("user"), F.col("user_id").cast("string"))
    nested = F.array(F.struct(F.struct(F.lit("z").alias("db_credential"), F.lit(1).alias("n")).alias("inner")))
    note = F.when(F.col("event_id") % 2 == 0, "**********").otherwise("plain")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), fields.alias("m"), nested.alias("s"), F.lit("pw").alias("my_password"), note.alias("note"))
    m = F.col("m")
    return workflow.redact(e).select("event_id", "kind", m["Api_Token"].alias("a"), m["APIKEY"].alias("b"), F.col("s")[0]["inner"]["db_credential"].alias("c"), m["user"].alias("d"), "my_password", "note")


@query("refusal_ladder", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'insufficient_evidence' WHEN turn % 5 = 4 THEN 'prompt_echo' WHEN trim(text) = '' THEN 'empty_answer'
    WHEN turn % 2 = 0 THEN 'no_citations' END AS refusal FROM conversations""")
def refusal_ladder(spark, d):
    r = workflow.refusal(F.col("role") != "system", F.col("text"), F.col("turn") % 2, F.col("turn") % 5 == 4)
    return table(spark, d, "conversations").select("conv_id", "turn", r.alias("refusal"))


@query("failover_order", """SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey % 7 > 3)::INT, CASE WHEN s_suppkey % 7 > 3 THEN s_acctbal END, s_suppkey % 3, s_suppkey) AS place FROM supplier""")
def failover_order(spark, d):
    p = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("priority"), (F.col("s_suppkey") % 7).alias("cooling_until"), F.col("s_acctbal").alias("failed_at"))
    return workflow.failover_order(p, F.lit(3), ["s_nationkey"]).select(F.col("id").alias("s_suppkey"), "place")


@query("session_upsert", """SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey""")
def session_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return workflow.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("session_hybrid", """WITH d AS (SELECT o_custkey AS s, o_orderkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_custkey % 3 > 0),
    l AS (SELECT o_custkey AS s, o_orderkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
    u AS (SELECT s, c, r, 1 AS dn FROM d WHERE r <= 3 UNION ALL SELECT s, c, r, 0 FROM l WHERE r <= 5), f AS (SELECT s, c, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, max(dn) AS dn FROM u GROUP BY s, c),
    k AS (SELECT s, c, score, sum(dn) OVER (PARTITION BY s) AS n, row_number() OVER (PARTITION BY s ORDER BY score DESC, c) AS rank FROM f)
    SELECT s AS session_id, c AS chunk_id, score, rank FROM k WHERE n = 0 OR rank <= n""")
def session_hybrid(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "session_id", "o_orderkey": "chunk_id"})
    by = Window.partitionBy("session_id")
    dense = o.where("session_id % 3 > 0").withColumn("rank", F.row_number().over(by.orderBy(F.desc("o_totalprice"), "chunk_id"))).where("rank <= 3")
    lexical = o.withColumn("rank", F.row_number().over(by.orderBy("o_orderdate", "chunk_id"))).where("rank <= 5")
    return workflow.session_fused(dense, lexical, ["session_id"])


@query("source_validation", """SELECT l_orderkey AS source_id, count(*) AS n_pages, bool_or(l_linenumber <= 3 AND l_returnflag = 'R') AS titled, count(*) >= 4 AS long_enough FROM lineitem GROUP BY l_orderkey""")
def source_validation(spark, d):
    """A source's title must stand on its first three pages, and it must have pages enough."""
    p = table(spark, d, "lineitem")
    titled = F.bool_or((F.col("l_linenumber") <= 3) & (F.col("l_returnflag") == "R"))
    return p.groupBy(F.col("l_orderkey").alias("source_id")).agg(F.count("*").alias("n_pages"), titled.alias("titled"), (F.count("*") >= 4).alias("long_enough"))
