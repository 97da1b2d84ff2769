"""Queries of retrieval as a whole, of evaluation figures, and of page rules, with SQL twins that state their own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.functions.vectors import hashing_embedding
from folioscan.operators import composed, evaluation, index, ranking, sessions, structure, workflow
from folioscan.plans import retrieval as r
from folioscan.plans.answers import _asked, _cases
from folioscan.plans.retrieval import table
from folioscan.session import stored
from folioscan.sources import tables
from folioscan.streaming import state

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _forms(forms: list[tuple], column: str) -> str:
    return f"SELECT c_custkey, i::INT AS form, {_cases(forms)} AS {column} FROM customer, range(0, {len(forms)}) r(i)"


_FOREIGN = [
    ("Which rule of the Coastal Fishing Act binds a skipper?", "Coastal Fishing Act"), ("Describe the Code of Harbour Duties", "Code of Harbour Duties"), ("fine for a broken seal in New York", "New York law"),
    ("murder in the uK", "uK law"), ("law to be Evidence Act", "be Evidence Act"), ("the act of sealing", None), ("dues under this act", None), ("the Test Sanhita Act", None), ("under Indian law", None),
    ("the Harbour Code", "Harbour Code"), ("the harbour code", None), ("does the law punish smuggling", None), ("Indian Harbour Code section 5", "Indian Harbour Code"), ("the BNS Act, please", None), ("", None),
]


@query("foreign_gate", _forms(_FOREIGN, "foreign_name"))
def foreign_gate(spark, d):
    words = F.array(*[F.lit(w) for w in ("test", "sanhita", "bns")])
    return _asked(spark, d, _FOREIGN).select("c_custkey", "form", composed.foreign_statute(F.col("q"), words).alias("foreign_name"))


@query("corpus_vocabulary", "SELECT 'bns,india,indian,nyaya,of,sanhita,test' AS words")
def corpus_vocabulary(spark, d):
    c = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "Act of Nyaya").otherwise("Test Sanhita Code, 2023").alias("act"), F.lit("BNS").alias("act_short"))
    return composed.corpus_vocabulary(c).select(F.array_join("words", ",").alias("words"))


_DENSE = rf"""{r._HASH}, he AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM hc),
hq0 AS (SELECT query_id, ('0x' || substring(sha256(term), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM qt GROUP BY ALL),
hq AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM hq0),
dn AS (SELECT query_id, doc_id, round(sum(hq.w * he.w), 6) AS score FROM hq JOIN he USING (bucket) GROUP BY ALL)"""


def _dense_rows(terms: DataFrame, key: str) -> DataFrame:
    """(key, embedding): the hashed vectors with their zeros."""
    cells = hashing_embedding(terms, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "weight"))).alias("m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.col("m")[i.cast("int")], F.lit(0.0))).alias("embedding"))


@query("hybrid_dense_sparse", f"""WITH {r._BM25}, {_DENSE}, a AS ({r._TOP.format('dn', 20)}), b AS ({r._TOP.format('bm', 20)}),
    u AS (SELECT query_id, doc_id, 0 AS l, rank AS r FROM a UNION ALL SELECT query_id, doc_id, 1, rank FROM b),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf_score, min(l * 1000000 + r) AS fs, min(r) FILTER (l = 0) AS dr, min(r) FILTER (l = 1) AS sr FROM u GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, fs) AS rank FROM f)
    SELECT query_id, doc_id, rrf_score, rank, CASE WHEN dr IS NOT NULL AND sr IS NOT NULL THEN 'hybrid' WHEN dr IS NOT NULL THEN 'dense' ELSE 'sparse' END AS source FROM k WHERE rank <= 10""")
def hybrid_dense_sparse(spark, d):
    """Dense and sparse lists of every benchmark item over all documents, fused, with what found each row."""
    docs, asked = table(spark, d, "documents"), r._queries(spark, d)
    vectors = _dense_rows(index.terms(docs), "doc_id")
    dense = ranking.cosine_topk(_dense_rows(index.terms(asked, "query_id"), "query_id"), vectors, 20, key="doc_id", others=False).where("score > 0")
    sparse = index.top_k(index.bm25(asked, docs), 20)
    ids = asked.select("query_id", "text").withColumns({"route": F.lit("statute"), "kind": F.lit("hybrid"), "act": F.lit(None).cast("string"), "intent": F.lit(None).cast("struct<section_number:string,subsection:string>")})
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.lit("T").alias("act_short"), F.lit("0").alias("section_number"), F.lit(None).cast("string").alias("subsection"), "text")
    named = lambda x: x.withColumnRenamed("doc_id", "chunk_id")
    results, _ = composed.statute_evidence(ids, chunks, named(dense), named(sparse))
    return results.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("score").alias("rrf_score"), "rank", "source")


_SESSION_ITEMS = "items AS (SELECT item_id AS query_id, CASE WHEN item_id % 8 = 1 THEN 'zzqx' ELSE text END AS text FROM benchmark)"


@query("session_search", f"""WITH {r._POST}, {_SESSION_ITEMS}, {r.terms_sql("qt", "items", "query_id")}, {_DENSE.split(", dn AS")[0]}, {r._LEX},
    ok AS (SELECT query_id, doc_id, source AS session, query_id % 4 <= 1 AS named FROM items JOIN documents ON source = 'src' || (query_id % 20) WHERE query_id % 4 > 1 OR doc_id % 5 = query_id % 5),
    d0 AS (SELECT query_id, doc_id, round(sum(hq.w * he.w), 6) AS score FROM hq JOIN he USING (bucket) JOIN ok USING (query_id, doc_id) GROUP BY ALL),
    d1 AS ({r._TOP.format('d0', 8)}), l0 AS (SELECT lx.query_id, chunk_id AS doc_id, score FROM lx JOIN ok ON ok.query_id = lx.query_id AND ok.doc_id = lx.chunk_id), l1 AS ({r._TOP.format('l0', 10)}),
    u AS (SELECT query_id, doc_id, rank, 1 AS d FROM d1 UNION ALL SELECT query_id, doc_id, rank, 0 FROM l1),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s, max(d) AS d FROM u GROUP BY ALL),
    g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS k, sum(d) OVER (PARTITION BY query_id) AS n FROM f),
    h AS (SELECT query_id, doc_id, k FROM g WHERE n = 0 OR k <= n UNION ALL
          SELECT query_id, doc_id, k FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM ok WHERE named AND query_id NOT IN (SELECT query_id FROM f)) WHERE k <= 8),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(d1.score, l1.score, 0) DESC, k) AS place, doc_id AS chunk_id, coalesce(d1.score, l1.score, 0)::DOUBLE AS score,
           'f' || doc_id || '.pdf' AS filename, position FROM h LEFT JOIN d1 USING (query_id, doc_id) LEFT JOIN l1 USING (query_id, doc_id) JOIN p USING (doc_id)""")
def session_search(spark, d):
    """Every benchmark item asked of one source's documents as a session; some name documents, some of these find nothing."""
    docs = table(spark, d, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text", F.col("doc_id").alias("created_at"),
                                               F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    q = r._queries(spark, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("session_id"), F.when(F.col("query_id") % 8 == 1, "zzqx").otherwise(F.col("text")).alias("text"))
    scope = q.where("query_id % 4 <= 1").join(docs, "session_id").where("document_id % 5 = query_id % 5").select("query_id", "document_id")
    return sessions.search(q, docs, docs, scope).select("query_id", "place", "chunk_id", "score", "filename", F.col("position").cast("long").alias("position"))


@query("eval_dense_hybrid", f"""WITH {r._BM25}, {_DENSE}, {r._EXPECT}, a AS ({r._TOP.format('dn', 20)}), b AS ({r._TOP.format('bm', 20)}),
    u AS (SELECT query_id, doc_id, 0 AS l, rank AS r FROM a UNION ALL SELECT query_id, doc_id, 1, rank FROM b),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS s, min(l * 1000000 + r) AS fs FROM u GROUP BY ALL),
    rs AS (SELECT 'dense' AS config, query_id, doc_id, rank FROM a WHERE rank <= 10 UNION ALL SELECT * FROM (SELECT 'hybrid', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fs) AS rank FROM f) WHERE rank <= 10),
    e AS (SELECT config, query_id, doc_id, rank FROM (SELECT * FROM ex, (VALUES ('dense'), ('hybrid')) v(config)) LEFT JOIN rs USING (config, query_id, doc_id)),
    p AS (SELECT config, query_id, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r5, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r10, coalesce(1.0::DOUBLE / min(rank), 0.0) AS rr FROM e GROUP BY ALL)
    SELECT config, count(*) AS n_cases, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr FROM p GROUP BY config""")
def eval_dense_hybrid(spark, d):
    """An evaluation run: the dense list alone against dense and sparse fused, means over all cases."""
    docs, asked = table(spark, d, "documents"), r._queries(spark, d)
    vectors = stored(_dense_rows(index.terms(docs), "doc_id"))
    # Stored: vectors are counted and compared, both lists are judged alone or fused.
    dense = stored(ranking.cosine_topk(_dense_rows(index.terms(asked, "query_id"), "query_id"), vectors, 20, key="doc_id", others=False).where("score > 0"))
    sparse = stored(index.top_k(index.bm25(asked, docs), 20))
    fused = ranking.fuse([("dense", dense), ("sparse", sparse)])
    hybrid = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first_seen")).cast("long")).where("rank <= 10")
    expected = asked.join(docs.select("doc_id"), F.col("doc_id") % 97 == F.col("query_id") % 97).select("query_id", "doc_id")
    runs = {"dense": dense.where("rank <= 10"), "hybrid": hybrid}
    scored = [evaluation.recall_and_rank(expected, run).withColumn("config", F.lit(name)) for name, run in runs.items()]
    return scored[0].unionByName(scored[1]).groupBy("config").agg(F.count("*").alias("n_cases"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("recall_at_5", "recall_at_5"), ("recall_at_10", "recall_at_10"), ("reciprocal_rank", "mrr"))])


#: What is asked, and what comes of it: in a corpus of one act and of two, each for customers with and without documents.
_RETRIEVE = [
    ("section {}", ["statute"] * 4), ("what has the Coastal Fishing Act on section {}", ["documents", "refused:foreign_statute"] * 2), ("BNSS {}", ["statute", "statute", "documents", "refused:no_session"]),
    ("what does my notice say", ["documents", "refused:no_session"] * 2), ("what is theft", ["statute"] * 4), ("what is nothing at all", ["documents", "refused:no_session"] * 2),
    ("explain section {} in my notice", ["merged", "statute"] * 2), ("section 951", ["documents", "refused:no_session"] * 2), ("what is weak", ["merged", "statute"] * 2),
]


def _retrieve_sql() -> str:
    arms = " ".join(f"WHEN {i} THEN [" + ", ".join(f"'{x}'" for x in w) + "][acts * 2 + 1 + c_custkey % 2]" for i, (_, w) in enumerate(_RETRIEVE))
    return f"SELECT c_custkey, i::INT AS form, acts::INT AS acts, CASE i {arms} END AS outcome FROM customer, range(0, {len(_RETRIEVE)}) r(i), range(0, 2) s(acts)"


def _retrieve_asked(spark, d) -> DataFrame:
    """(query_id, text, route, intent, act, c_custkey, form) of every question, stored: many steps read it."""
    asked = _asked(spark, d, [(t, None) for t, _ in _RETRIEVE]).select((F.col("c_custkey") * 100 + F.col("form")).alias("query_id"), F.col("q").alias("text"))
    return stored(composed.said(asked)).withColumns({"c_custkey": F.floor(F.col("query_id") / 100), "form": (F.col("query_id") % 100).cast("int")})


def _retrieval(spark, q: DataFrame, acts: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Verdicts, documents, results and hits over a corpus of one act, or with ``acts`` of two; customers of even numbers have documents."""
    n = F.col("id").cast("string")
    one = spark.range(1, 901).select(F.concat(F.lit("BNS-"), n).alias("chunk_id"), F.lit("Bharatiya Nyaya Sanhita").alias("act"), F.lit("BNS").alias("act_short"), n.alias("section_number"),
                                     F.lit(None).cast("string").alias("subsection"), F.lit("text").alias("text"))
    chunks = one.union(one.limit(0) if not acts else spark.range(0, 1).select(F.lit("X-1"), F.lit("Test Code"), F.lit("X"), F.lit("999"), F.lit(None).cast("string"), F.lit("text")))
    asked = stored(composed.within_corpus(q, chunks).drop("text"))
    rank = lambda forms, at: q.where(F.col("form").isin(*forms)).select("query_id", F.lit("BNS-1").alias("chunk_id"), F.lit(at).alias("rank"))
    # Theft stands first in both lists; the weak question's only row is far down one of them, and but half relevant.
    similarity = q.where("form in (4, 8)").select("query_id", F.when(F.col("form") == 4, 0.9).otherwise(0.54).alias("similarity"))
    results, verdicts = composed.statute_evidence(asked, chunks, rank([4], 1).union(rank([8], 20)), rank([4], 1), similarity)
    own = F.col("c_custkey") % 2 == 0
    resolved = q.select("query_id", F.when(own, F.col("c_custkey")).alias("session_id"), F.when(own, "all").alias("outcome"))
    hits = q.where(own).select("query_id", F.explode(F.array(F.lit(0.3), F.lit(0.4))).alias("score")).withColumn("chunk_id", F.concat(F.lit("d"), F.col("score").cast("string")))
    return verdicts, composed.document_evidence(resolved, hits), results, hits


@query("retrieve_route", _retrieve_sql())
def retrieve_route(spark, d):
    """Every question to its outcome, with the reason of a refusal."""
    out, q = [], _retrieve_asked(spark, d)
    for acts in (0, 1):
        verdicts, docs, _, _ = _retrieval(spark, q, acts)
        got = composed.retrieve(verdicts, docs).select("query_id", F.concat_ws(":", "outcome", "reason").alias("outcome"))
        out.append(q.join(composed.per_question(got), "query_id").select("c_custkey", "form", F.lit(acts).alias("acts"), "outcome"))
    return out[0].union(out[1])


@query("retrieved_rows", f"""WITH r AS ({_retrieve_sql()}), o AS (SELECT *, split_part(outcome, ':', 1) AS o FROM r), s AS (SELECT *, CASE form WHEN 4 THEN 1.0::DOUBLE WHEN 8 THEN round((1.0::DOUBLE / 80) / (2.0::DOUBLE / 61) * 0.5, 6)
      WHEN 0 THEN 1.0::DOUBLE WHEN 6 THEN 1.0::DOUBLE WHEN 2 THEN CASE WHEN acts = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS c FROM o)
    SELECT c_custkey, form, acts, o AS outcome, CASE o WHEN 'documents' THEN 0.4::DOUBLE ELSE c END AS confidence, nullif(split_part(outcome, ':', 2), '') AS reason,
           CASE WHEN o NOT IN ('statute', 'merged') THEN '' WHEN form IN (0, 2, 6) THEN '1 BNS-' || (c_custkey % 900 + 1) || ' lookup' WHEN form = 4 THEN '1 BNS-1 hybrid' ELSE '1 BNS-1 dense' END AS results,
           CASE WHEN o IN ('documents', 'merged') THEN 'd0.4,d0.3' ELSE '' END AS hits FROM s""")
def retrieved_rows(spark, d):
    """Retrieval as a whole, one row per question: outcome, confidence with the relevance band, statute rows and session chunks."""
    out, q = [], _retrieve_asked(spark, d)
    for acts in (0, 1):
        verdicts, docs, results, hits = _retrieval(spark, q, acts)
        got = composed.retrieved(verdicts, docs, results, hits)
        rows = F.array_join(F.transform("results", lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["chunk_id"], x["source"])), ",")
        got = got.select("query_id", "outcome", F.round("confidence", 6).alias("confidence"), "reason", rows.alias("results"), F.array_join(F.col("document_hits.chunk_id"), ",").alias("hits"))
        out.append(q.join(composed.per_question(got), "query_id").select("c_custkey", "form", F.lit(acts).alias("acts"), "outcome", "confidence", "reason", "results", "hits"))
    return out[0].union(out[1])


_ORDER = ["foreign_statute", "ambiguous", "no_such_document", "no_session", "below_threshold", "no_match"]


@query("refusal_reasons", "SELECT o_orderkey, (['foreign_statute', 'ambiguous', 'no_such_document', 'no_session', 'below_threshold', 'no_match'])[least(o_orderkey % 6, o_custkey % 6) + 1] AS reason FROM orders")
def refusal_reasons(spark, d):
    pick = lambda c: F.get(F.array(*[F.lit(x) for x in _ORDER]), (F.col(c) % 6).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", composed.refusal_reason(pick("o_orderkey"), pick("o_custkey")).alias("reason"))


@query("cited_sources", """SELECT l_orderkey AS query_id, 'c' || l_partkey % 30 AS chunk_id, '[BNS s.' || l_partkey % 30 || ']' AS citation, 'doc#page=' || l_partkey % 30 AS source_uri, min(l_linenumber) AS rank
    FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_orderkey, l_partkey % 30""")
def cited_sources(spark, d):
    p = (F.col("l_partkey") % 30).cast("string")
    line = table(spark, d, "lineitem")
    results = line.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("c"), p).alias("chunk_id"), F.col("l_linenumber").alias("rank"))
    cited = line.where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("query_id"), F.lit("BNS").alias("act_short"), p.alias("section_number"))
    n = F.col("id").cast("string")
    chunks = spark.range(30).select(F.concat(F.lit("c"), n).alias("chunk_id"), F.lit("BNS").alias("act_short"), n.alias("section_number"), F.concat(F.lit("doc#page="), n).alias("source_uri"))
    return composed.sources(results, cited, chunks)


@query("answer_metrics", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE round(2.0::DOUBLE / 3, 9) END AS accuracy,
    CASE WHEN (o_orderkey % 2 = 0) = (o_custkey % 2 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS refusal FROM orders""")
def answer_metrics(spark, d):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    m = F.col("o_orderkey") % 4
    cited = F.when(m == 0, arr()).when(m == 1, arr("1", "2")).when(m == 2, arr("1", "9")).otherwise(arr("1", "2", "8"))
    right = evaluation.refusal_correctness(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(evaluation.citation_accuracy(cited, arr("1"), arr("2")), 9).alias("accuracy"), right.alias("refusal"))


_LINES = [
    ("harbour dues.6. In counting the days", "harbour dues.|6. In counting the days"), ("Broken seal272. Whoever does", "Broken seal.|272. Whoever does"), ("under rule 47 of the Order", "under rule 47 of the Order"),
    ("In 1955. Whoever", "In 1955. Whoever"), ("seals152. (1) Whoever", "seals.|152. (1) Whoever"), ("a. b7. Whoever", "a. b7. Whoever"), ("7. Whoever", "7. Whoever"),
]


@query("glued_lines", _forms(_LINES, "parts"))
def glued_lines(spark, d):
    return _asked(spark, d, _LINES).select("c_custkey", "form", F.array_join(text.split_glue(F.col("q")), "|").alias("parts"))


_TITLES = [("the  KING''s speech", "The King''S Speech"), ("bail-bond under 2nd act", "Bail-Bond Under 2Nd Act"), (" a ", "A"), ("élan", "Élan")]


@query("title_case", _forms(_TITLES, "title"))
def title_case(spark, d):
    return _asked(spark, d, [(t.replace("''", "'"), None) for t, _ in _TITLES]).select("c_custkey", "form", text.title_case(F.col("q")).alias("title"))


_IDS = [("abc_DEF-123", "true"), ("a/b", "false"), ("", "false"), ("a b", "false"), ("x" * 128, "true"), ("x" * 129, "false"), ("..", "false")]


@query("safe_ids", f"SELECT c_custkey, form, ok = 'true' AS safe FROM ({_forms(_IDS, 'ok')})")
def safe_ids(spark, d):
    return _asked(spark, d, _IDS).select("c_custkey", "form", text.safe_id(F.col("q")).alias("safe"))


@query("chunk_pages", """SELECT o_orderkey, (o_orderkey % 900 + 1)::INT AS page, s::INT AS seq, o_orderkey || '-p' || lpad((o_orderkey % 900 + 1)::VARCHAR, 4, '0') || '-' || lpad(s::VARCHAR, 3, '0') AS chunk_id,
    CASE o_orderkey % 3 WHEN 0 THEN repeat('a', 400) || chr(10) || chr(10) || 'b.' WHEN 1 THEN [repeat('a', 500) || chr(10) || chr(10) || repeat('b', 600), repeat('c', 300)][s + 1]
    ELSE [repeat('a', 700) || '. ' || repeat('b', 400) || '.', repeat('c', 1200), repeat('c', 100) || '.', 'end'][s + 1] END AS text
    FROM orders, range(0, 4) r(s) WHERE s < CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END""")
def chunk_pages(spark, d):
    rep = lambda c, n: F.repeat(F.lit(c), n)
    m = F.col("o_orderkey") % 3
    body = (
        F.when(m == 0, F.concat(rep("a", 400), F.lit("\n\nb."))).when(m == 1, F.concat_ws("\n\n", rep("a", 500), rep("b", 600), rep("c", 300)))
        .otherwise(F.concat(rep("a", 700), F.lit(". "), rep("b", 400), F.lit(". "), rep("c", 1300), F.lit(".\n\nend")))
    )
    pages = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 900 + 1).alias("page"), body.alias("text"))
    return structure.chunk_pages(pages, "o_orderkey", page="page")


@query("label_chunks", """SELECT l_orderkey, l_linenumber AS part, CASE WHEN l_linenumber % 2 = 0 THEN '(1)-(3)' ELSE '(2)' END AS subsection,
    'T' || CASE WHEN count(*) OVER w > 1 THEN ' (part ' || l_linenumber || ' of ' || count(*) OVER w || ')' ELSE '' END AS section_title, 'act.pdf#page=3-' || 3 + l_linenumber AS source_uri, l_returnflag = 'R' AS needs_review
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey)""")
def label_chunks(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("part")).agg(F.min("l_returnflag").alias("f"))
    arr = lambda *x: F.array(*map(F.lit, x))
    c = line.select("l_orderkey", "part", F.when(F.col("part") % 2 == 0, arr("(1)", "(2)", "(3)")).otherwise(arr("(2)")).alias("subsections"), F.lit("T").alias("section_title"), F.lit("act.pdf").alias("source_uri"),
                    F.lit(3).alias("page_start"), (F.col("part") + 3).alias("page_end"), (F.col("f") != "R").alias("title_confident"))
    return structure.label_chunks(c, ["l_orderkey"]).select("l_orderkey", "part", "subsection", "section_title", "source_uri", "needs_review")


@query("page_turns", """SELECT conv_id, turn, coalesce(lag(turn // 3) OVER w <> turn // 3, true) AS turns, lead(role) OVER w AS ahead FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def page_turns(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("line_no"), F.col("role").alias("line"))
    return structure.page_turns(lines, "conv_id").select("conv_id", "turn", "turns", "ahead")


@query("forms_read_by_ocr", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence, o_orderkey % 4 = 0 OR o_custkey % 5 = 0 AS needs_review FROM orders""")
def forms_read_by_ocr(spark, d):
    o = table(spark, d, "orders")
    forms = o.select("o_orderkey", F.lit(1).alias("form_number"), F.lit(2).alias("start_page"), F.lit(4).alias("end_page"), F.lit(0.9).alias("confidence"), (F.col("o_custkey") % 5 == 0).alias("needs_review"))
    pages = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, 4).otherwise(5).alias("page"), F.lit(True).alias("ocr"))
    return workflow.ocr_capped(forms, pages, ["o_orderkey"]).select("o_orderkey", "confidence", "needs_review")


@query("allowed_documents", "SELECT doc_id, doc_id || '-p0001-000' AS chunk_id FROM documents WHERE doc_id % 3 = 0")
def allowed_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-p0001-000")).alias("chunk_id"))
    return tables.of_documents(docs, docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("document_id")))


@query("same_dimension", "SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0")
def same_dimension(spark, d):
    v = table(spark, d, "embeddings")
    n = F.size("embedding")
    short = v.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", F.lit(1), n - 1)))
    return tables.of_dimension(short, v.select(n.alias("n")).first()["n"]).select("vec_id")


@query("reasoning_deltas", """SELECT conv_id, count(*) AS n, CASE conv_id % 3 WHEN 0 THEN 'before  after' WHEN 1 THEN 'a < b <thin air' ELSE 'shown ' END AS shown FROM conversations GROUP BY conv_id""")
def reasoning_deltas(spark, d):
    """A streamed answer cut anywhere gives the text that the whole would: cuts fall within the tags here."""
    whole = [("before <thi", "nk>secret</th", "ink> after"), ("a < b <th", "in a", "ir"), ("shown <reason", "ing>lost <", "/reasonin")]
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    parts = F.get(F.array(*[F.array(*map(F.lit, w)) for w in whole]), (F.col("conv_id") % 3).cast("int"))
    deltas = t.select("conv_id", "n", F.posexplode(parts).alias("seq", "delta"))
    shown = state.visible_deltas(deltas.select(F.col("conv_id").alias("stream"), "seq", "delta"))
    joined = shown.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"]), "").alias("shown"))
    return joined.join(t, joined["stream"] == t["conv_id"]).select("conv_id", "n", "shown")
