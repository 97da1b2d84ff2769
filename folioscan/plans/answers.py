"""Queries of routing, document references, titles, answer checks and evaluation runs with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import dialogue, text
from folioscan.operators import checking, evaluation, index, ranking, references, sessions, structure, titles
from folioscan.plans import documents as docs_plan
from folioscan.plans import retrieval as r
from folioscan.plans.retrieval import dealt, table
from folioscan.session import stored

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_ROUTES = [
    ("what does my notice say", "document"), ("section {}", "statute"), ("explain section {} in my notice", "combined"), ("how do I file my FIR", "statute"),
    ("the police lost my FIR", "statute"), ("what is the filing date in the petition", "document"), ("what is the notice period", "statute"), ("इस दस्तावेज़ में क्या है", "document"),
    ("what does BNS say", "statute"), ("compare this agreement with BNS {}", "combined"), ("who signed the second rent agreement", "document"),
]


def _cases(forms: list[tuple]) -> str:
    return "CASE i " + " ".join(f"WHEN {i} THEN " + ("NULL" if w is None else f"'{w}'") for i, (_, w) in enumerate(forms)) + " END"


def _asked(spark, d, forms: list[tuple]) -> DataFrame:
    """(c_custkey, form, q): every customer with every form, the customer's number in place of {}."""
    number = (F.col("c_custkey") % 900 + 1).cast("string")
    texts = [F.replace(F.lit(t), F.lit("{}"), number) for t, _ in forms]
    return dealt(spark, d, "customer").select("c_custkey", F.posexplode(F.array(*texts)).alias("form", "q"))


@query("route_intent", f"SELECT c_custkey, i::INT AS form, {_cases(_ROUTES)} AS route FROM customer, range(0, {len(_ROUTES)}) r(i)")
def route_intent(spark, d):
    return _asked(spark, d, _ROUTES).select("c_custkey", "form", dialogue.route(F.col("q")).alias("route"))


_TALK = [
    ("Hello!", "greeting"), ("Hello, who are you?", "identity"), ("what can you do", "capability"), ("How are you doing?", "how_are_you"), ("Thanks a lot.", "thanks"), ("hi section {}", None),
    ("good night", "farewell"), ("OK", "ack"), ("What is your purpose?", "identity"), ("help", "capability"), ("  Good   Morning ", "greeting_morning"), ("who are you and what is theft", None), ("?!", None), ("help me", None), ("How can you help me?", "capability"), ("please help us", None),
]


@query("small_talk", f"SELECT c_custkey, i::INT AS form, {_cases(_TALK)} AS kind FROM customer, range(0, {len(_TALK)}) r(i)")
def small_talk(spark, d):
    return _asked(spark, d, _TALK).select("c_custkey", "form", dialogue.small_talk(F.col("q")).alias("kind"))


_FREE = [
    ("notice period in the first document", "notice period in"), ("rent arrears in lease_rental.pdf", "rent arrears in"), ("What did the court hold?", "what did the court hold"), ("the latest file", ""),
]


@query("reference_free", f"SELECT c_custkey, i::INT AS form, {_cases(_FREE)} AS q FROM customer, range(0, {len(_FREE)}) r(i)")
def reference_free(spark, d):
    stems = dialogue.stem_tokens(F.lit("lease_rental.pdf"))
    return _asked(spark, d, _FREE).withColumn("q", dialogue.without_references(F.regexp_replace("q", "_", " "), stems))


_UPLOADS = """d AS (SELECT o_custkey AS s, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


def _uploads(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("document_id"))
    number = (F.col("document_id") + 100000).cast("string")
    name = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("rent-deed-"), number)).otherwise(F.concat(F.lit("notes"), number))
    return sessions.positions(o).withColumn("filename", F.concat(name, F.lit(".pdf")))


_POINTING = [
    "what does the first document say", "summarise the latest pdf", "compare both documents", "and the other document", "what does that agreement say", "open the fifth document", "previous upload",
    "punishment for theft", "what is in rent deed ",
]


@query("resolve_references", f"""WITH {_UPLOADS}, c AS (SELECT c_custkey AS s, coalesce(max(n), 0) AS n, max(id) AS mx FROM customer LEFT JOIN d ON s = c_custkey GROUP BY c_custkey),
    w AS (SELECT *, CASE i WHEN 0 THEN 1 WHEN 1 THEN n WHEN 3 THEN CASE WHEN n = 2 THEN 2 END WHEN 4 THEN 1 WHEN 5 THEN 5 WHEN 6 THEN greatest(n - 1, 1) END AS want FROM c, range(0, {len(_POINTING)}) r(i))
    SELECT w.s AS session_id, i::INT AS query_id, CASE WHEN id IS NOT NULL THEN 'documents' WHEN i IN (2, 7, 8) OR (i = 6 AND w.n = 0) THEN 'all' WHEN i = 3 THEN 'ambiguous' ELSE 'no_such_document' END AS outcome,
           id::VARCHAR AS document_id FROM w LEFT JOIN d ON d.s = w.s AND (d.p = want OR (i = 8 AND id = mx AND mx % 3 = 0))""")
def resolve_references(spark, d):
    uploads = _uploads(spark, d)
    known = uploads.groupBy(F.col("session_id").alias("c_custkey")).agg(F.max("document_id").alias("__m"), F.min_by("document_id", "position").alias("__f"))
    last = F.coalesce((F.col("__m") + 100000).cast("string"), F.lit(""))
    texts = F.array(*[F.concat(F.lit(t), last) if t.endswith(" ") else F.lit(t) for t in _POINTING])
    context = F.when(F.col("__f").isNotNull(), F.array(F.col("__f").cast("string")))
    asked = table(spark, d, "customer").join(known, "c_custkey", "left").select(F.col("c_custkey").alias("session_id"), context.alias("context"), F.posexplode(texts).alias("query_id", "text"))
    return references.resolve(asked, uploads)


@query("position_labels", f"""WITH {_UPLOADS} SELECT id AS document_id, CASE p WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' ELSE p || 'th' END || ' uploaded document'
    || CASE WHEN n > 1 AND p = n THEN ' (latest)' ELSE '' END AS label FROM d""")
def position_labels(spark, d):
    n = F.count("*").over(Window.partitionBy("session_id"))
    return _uploads(spark, d).withColumn("n", n).select("document_id", dialogue.position_label(F.col("position"), F.col("n")).alias("label"))


# --- titles, structure ---------------------------------------------------------------------------


def _tokens_sql(source: str, key: str, value: str) -> str:
    return f"SELECT DISTINCT {key}, CASE {r._SUFFIX} ELSE w END AS token FROM (SELECT {key}, unnest(regexp_extract_all(lower({value}), '[a-z]{{3,}}')) AS w FROM {source})"


@query("title_match", f"""WITH h AS ({_tokens_sql('documents', 'doc_id', 'text')}), o AS ({_tokens_sql('documents', 'doc_id', 'split_part(text, chr(10), 1)')}),
    wt AS (SELECT token, CASE WHEN count(*) / (SELECT count(*) FROM documents)::DOUBLE <= 0.05 THEN 1.0::DOUBLE WHEN count(*) / (SELECT count(*) FROM documents)::DOUBLE <= 0.15 THEN 0.3::DOUBLE ELSE 0.05::DOUBLE END AS weight
           FROM h GROUP BY token),
    q AS (SELECT item_id, token, coalesce(weight, 1.0::DOUBLE) AS weight FROM ({_tokens_sql('benchmark', 'item_id', 'text')}) LEFT JOIN wt USING (token)), qn AS (SELECT item_id, count(*) AS n, round(sum(weight), 9) AS w FROM q GROUP BY item_id),
    m AS (SELECT item_id, h.doc_id, count(*) AS m, count(o.token) AS mo, round(sum(weight), 9) AS mw, max(weight) AS best FROM q JOIN h ON h.token = q.token LEFT JOIN o ON o.doc_id = h.doc_id AND o.token = h.token GROUP BY ALL),
    s AS (SELECT item_id AS title_id, doc_id, round(m / n::DOUBLE, 6) AS coverage, round(mo / n::DOUBLE, 6) AS opening, round(mw / w, 6) AS strength, best >= 1.0 AS distinctive FROM m JOIN qn USING (item_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY coverage DESC, opening DESC, strength DESC, doc_id) AS place FROM s)
    SELECT * FROM k WHERE place <= 3""")
def title_match(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), "text")
    best = Window.partitionBy("title_id").orderBy(F.desc("coverage"), F.desc("opening"), F.desc("strength"), "doc_id")
    return titles.title_matches(items, table(spark, d, "documents")).withColumn("place", F.row_number().over(best).cast("long")).where("place <= 3")


@query("chrome_filter", rf"""WITH {docs_plan._CLEANED} SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN regexp_matches(line, '{text.CHROME}') THEN 1 ELSE 0 END)::BIGINT AS n_chrome,
    sum(CASE WHEN line = '' THEN 1 ELSE 0 END)::BIGINT AS n_blank FROM l1 GROUP BY doc_id""")
def chrome_filter(spark, d):
    lines = structure.explode_lines(table(spark, d, "documents")).withColumn("line", text.clean_line(F.col("line")))
    flag = lambda c: F.sum(c.cast("int"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), flag(text.is_chrome(F.col("line"))).alias("n_chrome"), flag(F.col("line") == "").alias("n_blank"))


@query("parse_act", f"""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no, {docs_plan._PARSE_LINE} AS line FROM lineitem),
    m AS (SELECT *, last_value(nullif(regexp_extract(line, '^CHAPTER\\s*([IVXLCDM]+)', 1), '') IGNORE NULLS) OVER w AS chapter, sum(CASE WHEN regexp_matches(line, '^\\d{{1,3}}\\.\\s*[A-Za-z(]') THEN 1 ELSE 0 END) OVER w AS g
          FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT doc_id, g::BIGINT AS ordinal, arg_min(chapter, line_no) AS chapter, try_cast(regexp_extract(min(CASE WHEN regexp_matches(line, '^\\d') THEN line END), '^(\\d+)', 1) AS INT) AS number,
           count(*) AS n_blocks, bool_or(line = 'Provided that') AS has_proviso, string_agg(line, chr(10) ORDER BY line_no) AS text FROM m WHERE g > 0 GROUP BY doc_id, g""")
def parse_act(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("line_no"), F.expr(docs_plan._PARSE_LINE).alias("line"))
    return structure.assemble_sections(structure.parse_lines(lines)).select("doc_id", "ordinal", "chapter", "number", "n_blocks", "has_proviso", "text")


@query("forms_validate", """WITH f AS (SELECT l_orderkey AS source_id, l_partkey % 20 AS n, l_linenumber * 3 AS a, l_linenumber * 3 + l_suppkey % 5 AS b FROM lineitem),
    g AS (SELECT *, a < lag(b) OVER (PARTITION BY source_id ORDER BY a, b, n) AS o, count(*) OVER (PARTITION BY source_id, n) > 1 AS t FROM f)
    SELECT source_id, count(*) AS n_forms, sum(CASE WHEN t THEN 1 ELSE 0 END)::BIGINT AS n_repeated, sum(CASE WHEN o THEN 1 ELSE 0 END)::BIGINT AS n_overlapping, max(b) > 20 AS beyond FROM g GROUP BY source_id""")
def forms_validate(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") % 20).alias("form_number"), (F.col("l_linenumber") * 3).alias("start_page"),
                                           (F.col("l_linenumber") * 3 + F.col("l_suppkey") % 5).alias("end_page"))
    return structure.validate_forms(f, ["source_id"], F.lit(20))


# --- answers ---------------------------------------------------------------------------------------

_N = "(o_orderkey % 400 + 1)"
_W = "The widget is sold [BNS s.{}]."
#: Texts by the order's remainder ({}: a section, {h}: a document's id), with each sentence's rule where both are known and where they aren't, and what stays of it.
_ANSWERS = [
    (_W, [("keep", "invalid", _W)]), ("The moon is round [BNS s.{}].", [("irrelevant", "invalid", None)]), ("The Indian Penal Code rules {}.", [("misattributed", "misattributed", None)]),
    ("The widget is sold [BNS sec.{}].", [("malformed", "malformed", None)]), ("Then section {} applies.", [("keep", "unknown_section", "Then section {} applies.")]),
    ("He is liable to punishment {}.", [("uncited_claim", "uncited_claim", None)]),
    ("Who sells a widget gets punishment for damages. " + _W, [("keep", "uncited_claim", "Who sells a widget gets punishment for damages."), ("keep", "invalid", _W)]),
    ("The widget is sold [BNS s.{}(1)].", [("keep", "invalid", "The widget is sold [BNS s.{}(1)].")]),
    ("Who sells a widget gets punishment for damages.\n\n" + _W, [("uncited_claim", "uncited_claim", None), ("keep", "invalid", _W)]),
    ("The tenant pays rent [{{h}} p.2].", [("keep", "invalid", "The tenant pays rent [Document {h} p.2].")]), ("The tenant pays rent [Document {h} p.9].", [("invalid", "invalid", None)]),
    ("I am here to help [bns S.{}].", [("self_reference", "invalid", "I am here to help [BNS s.{}].")]), ("[BNS s.{}]", [("no_content", "invalid", "")]),
    ("See these papers:\n* [Document {h} p.1]\n* [BNS s.{}]", [("keep", "invalid", "See these papers: * [Document {h} p.1] * [BNS s.{}]")]),
    ("धारा {} में सजा है [BNS s.{}]।", [("keep", "invalid", "धारा {} में सजा है [BNS s.{}]।")]), ("यह सजा है [BNS s.{}]।", [("irrelevant", "invalid", None)]),
    ("यह सजा है [Document {h}]।", [("keep", "invalid", "यह सजा है [Document {h}]।")]),
    ("Mr. A pays Rs. 500 for widget damages [BNS s.{}]. Section {} of BNS says so.", [("keep", "invalid", "Mr. A pays Rs. 500 for widget damages [BNS s.{}]."), ("keep", "unknown_section", "Section {} of BNS says so.")]),
    ("The widget is sold [BNS s.{}] [Document {h}].", [("keep", "invalid", _W)]), ("The Indian Penal Code is named on rent papers [Document {h} p.3].", [("keep", "invalid", "The Indian Penal Code is named on rent papers [Document {h} p.3].")]),
]


def _checked(spark, d) -> DataFrame:
    n = F.expr(_N).cast("string")
    known = lambda c: F.substring(F.md5(c.cast("string").cast("binary")), 1, 12)
    forms = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{}"), n), F.lit("{h}"), known(n)) for t, _ in _ANSWERS])
    answers = dealt(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.get(forms, (F.col("o_orderkey") % len(_ANSWERS)).cast("int")).alias("text"))
    body = F.concat(F.lit("Whoever sells a widget shall pay damages under rule (1) on "), "p_type")
    number = (F.col("p_partkey") % 400 + 1).cast("string")
    evidence = table(spark, d, "part").select(F.lit("BNS").alias("act_short"), number.alias("section_number"), F.lit(None).cast("string").alias("subsection"), body.alias("text"))
    files = table(spark, d, "part").select(known(number).alias("document_id"), F.lit(1).alias("page_start"), F.lit(3).alias("page_end"), F.concat(F.lit("The tenant pays rent to "), "p_brand").alias("text"))
    return checking.check_answers(answers, evidence, documents=files)


def _quoted(t: str | None) -> str:
    return "NULL" if t is None else "'" + t.replace("'", "''") + "'"


_CHECKED = f"""ev AS (SELECT DISTINCT p_partkey % 400 + 1 AS n FROM part), an AS (SELECT o_orderkey AS answer_id, o_orderkey % {len(_ANSWERS)} AS i, {_N} AS num, {_N} IN (SELECT n FROM ev) AS ok FROM orders),
    ru AS (SELECT an.*, seq, CASE WHEN ok THEN a ELSE b END AS rule, replace(replace(t, '{{}}', num::VARCHAR), '{{h}}', left(md5(num::VARCHAR), 12)) AS kept FROM an JOIN (VALUES """ + ", ".join(
    f"({i}, {j}, '{a}', '{b}', {_quoted(t)})" for i, (_, rules) in enumerate(_ANSWERS) for j, (a, b, t) in enumerate(rules)) + ") v(i, seq, a, b, t) USING (i))"


@query("citation_check", f"WITH {_CHECKED} SELECT answer_id, seq::INT AS seq, rule FROM ru")
def citation_check(spark, d):
    return _checked(spark, d).select("answer_id", "seq", "rule")


@query("answer_kept", f"""WITH {_CHECKED}, k AS (SELECT *, CASE WHEN rule IN ('keep', 'self_reference', 'no_content') THEN kept END AS stays FROM ru)
    SELECT answer_id, coalesce(string_agg(stays, ' ' ORDER BY seq), '') AS text, sum(CASE WHEN stays IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_removed FROM k GROUP BY answer_id""")
def answer_kept(spark, d):
    return checking.kept_text(_checked(spark, d))


@query("document_fallback", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 100 < 35 THEN CASE WHEN o_orderkey % 100 >= 10 AND o_custkey % 3 > 0 THEN 'merged' ELSE 'documents' END
    WHEN o_orderkey % 100 >= 10 THEN 'statute' ELSE 'refused' END AS outcome FROM orders""")
def document_fallback(spark, d):
    c = (F.col("o_orderkey") % 100) / 100.0
    return table(spark, d, "orders").select("o_orderkey", ranking.evidence_outcome(c >= 0.1, c, F.col("o_custkey") % 3, F.col("o_orderkey") % 4 == 0).alias("outcome"))


# --- fusion and evaluation -------------------------------------------------------------------------


@query("hybrid_provenance", r._RRF + """ SELECT query_id, k.doc_id, rank, CASE WHEN sparse_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'hybrid' WHEN lexical_rank IS NOT NULL THEN 'dense' ELSE 'sparse' END AS provenance,
    lang, length(text) AS n_chars FROM k JOIN documents USING (doc_id) WHERE rank <= 10""")
def hybrid_provenance(spark, d):
    """The fused list with what found each row, and the row itself; the session list stands for the dense one."""
    top = r._fused(spark, d).where("rank <= 10").select("query_id", "doc_id", "rank", ranking.provenance(F.col("lexical_rank"), F.col("sparse_rank")).alias("provenance"))
    rows = table(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))
    return top.join(rows, "doc_id")


@query("relevance_band", f"""WITH {r._COS}, k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c WHERE score > 0)
    SELECT query_id, vec_id, rank, greatest(0.0, least(1.0, round((score - 0.48) / 0.12, 6)))::DOUBLE AS band FROM k WHERE rank <= 10""")
def relevance_band(spark, d):
    band = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round((F.col("score") - 0.48) / 0.12, 6)))
    return r._cosine(spark, d, 10).where("score > 0").select("query_id", "vec_id", "rank", band.alias("band"))


@query("mrr", r._RRF + f""", {r._EXPECT}, rs AS (SELECT 'sparse' AS config, query_id, doc_id, rank FROM ({r._TOP.format('bm', 10)}) UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM k WHERE rank <= 10),
    e AS (SELECT config, query_id, doc_id, rank FROM (SELECT * FROM ex, (VALUES ('sparse'), ('hybrid')) v(config)) LEFT JOIN rs USING (config, query_id, doc_id)),
    p AS (SELECT config, query_id, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS rec, coalesce(1.0::DOUBLE / min(rank), 0.0) AS rr FROM e GROUP BY config, query_id)
    SELECT config, count(*) AS n_cases, round(avg(rec), 6) AS recall_at_10, round(avg(rr), 6) AS mrr FROM p GROUP BY config""")
def mrr(spark, d):
    """An evaluation run: the sparse list alone against the fused one, means over all cases."""
    docs = table(spark, d, "documents")
    asked = r._queries(spark, d)
    expected = asked.join(docs.select("doc_id"), F.col("doc_id") % 97 == F.col("query_id") % 97).select("query_id", "doc_id")
    sparse = stored(index.top_k(index.bm25(asked, docs), 20))
    runs = {"sparse": sparse.where("rank <= 10"), "hybrid": r._fused(spark, d, sparse).where("rank <= 10")}
    scored = [evaluation.recall_and_rank(expected, run).withColumn("config", F.lit(name)) for name, run in runs.items()]
    return reduce(DataFrame.unionByName, scored).groupBy("config").agg(
        F.count("*").alias("n_cases"), F.round(F.avg("recall_at_10"), 6).alias("recall_at_10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr")
    )
