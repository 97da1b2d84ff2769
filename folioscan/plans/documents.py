"""Text, structure, session, grounding, state and metrics queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.functions import legal, text
from folioscan.operators import evaluation, grounding, ranking, sessions, structure, workflow
from folioscan.plans.retrieval import dealt, table
from folioscan.sources import tables
from folioscan.streaming import state

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- text --------------------------------------------------------------------------------------

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(line,
  '\(\s+([a-zA-Z0-9]{1,3})\)', '(\1)', 'g'), '[–—]', '-', 'g'), '·', ''''), '\.?Sec\.\s*\d+\].*$', ''), '\d{1,3}\s+THE\s+GAZETTE.*$', ''),
  '\d{1,3}\s+THE$', ''), '\.\d{1,3}$', ''), '\.?Sec\.\s*$', '')"""
_LINES = "l0 AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
_CLEANED = rf"{_LINES}, l1 AS (SELECT doc_id, line_no, trim(regexp_replace({_CLEAN}, '[ \t]{{2,}}', ' ', 'g')) AS line FROM l0)"


@query("clean_lines", rf"""WITH {_CLEANED}, l2 AS (SELECT * FROM l1 WHERE line <> '' AND NOT regexp_matches(line, '{text.CHROME}')),
l3 AS (SELECT *, coalesce(ends_with(lag(line) OVER w, '-'), false) AND regexp_matches(line, '^\p{{Ll}}') AS wr FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
l4 AS (SELECT *, sum(CASE WHEN wr THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM l3)
SELECT doc_id, min(line_no)::INT AS line_no, string_agg(line, '' ORDER BY line_no) AS line FROM l4 GROUP BY doc_id, g""")
def clean_lines(spark, d):
    return structure.clean_page(structure.explode_lines(table(spark, d, "documents")))


@query("usable_text", r"""SELECT page_id, length(html) >= 8 AND length(regexp_replace(html, '[^ -~]', '', 'g')) >= 0.6 * length(html)
    AND length(replace(html, '.', '')) >= 8 AS usable FROM pages""")
def usable_text(spark, d):
    h = F.col("html")
    ok = (F.length(h) >= 8) & (F.length(F.regexp_replace(h, "[^ -~]", "")) >= 0.6 * F.length(h)) & (F.length(F.replace(h, F.lit("."), F.lit(""))) >= 8)
    return table(spark, d, "pages").select("page_id", ok.alias("usable"))


_SLUGWORDS = ", ".join(f"'{w}'" for w in text.SLUG_LOWER)


@query("slugify", rf"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9]+', '-', 'g'), '(^-+|-+$)', '', 'g') AS s FROM part),
    w AS (SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(s, '-'), lambda x: x <> ''), lambda x: CASE WHEN lower(x) IN ({_SLUGWORDS}) THEN lower(x)
      ELSE upper(x[1:1]) || lower(x[2:]) END), '-') AS s FROM s)
    SELECT p_partkey, CASE WHEN s = '' THEN 'Untitled' ELSE regexp_replace(left(s, 80), '(^-+|-+$)', '', 'g') END AS slug FROM w""")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("variant_pick", "SELECT c_custkey, ('0x' || substring(md5(c_name), 1, 8))::BIGINT % 5 AS variant FROM customer")
def variant_pick(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.variant(F.col("c_name"), 5).alias("variant"))


@query("strip_reasoning", r"""SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 3 = 0 THEN '<think>' || role || '</think>' || text WHEN turn % 3 = 1
    THEN text || '< Reasoning >' || role ELSE text END, '(?is)<\s*(think|thinking|reasoning)\s*>.*?(<\s*/\s*(think|thinking|reasoning)\s*>|$)', '', 'g')) AS answer FROM conversations""")
def strip_reasoning(spark, d):
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), "role", F.lit("</think>"), "text")).when(
        F.col("turn") % 3 == 1, F.concat("text", F.lit("< Reasoning >"), "role")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_reasoning(t).alias("answer"))


_PROMPT = "Answer only from the numbered passages below and cite every statement with the label of its passage in square brackets."


@query("prompt_echo", "SELECT conv_id, turn, " + " OR ".join(f"contains(t, '{_PROMPT[i:i + 60]}')" for i in range(0, len(_PROMPT) - 59, 10))
       + f" AS echoed FROM (SELECT conv_id, turn, text || substring('{_PROMPT}', (turn * 7 % 40 + 1)::INT, 68) AS t FROM conversations)")
def prompt_echo(spark, d):
    t = F.concat("text", F.substring(F.lit(_PROMPT), (F.col("turn") * 7 % 40 + 1).cast("int"), F.lit(68)))
    return table(spark, d, "conversations").select("conv_id", "turn", text.echoes(t, _PROMPT).alias("echoed"))


#: Samples in every script, read against each nation so that the query follows its table.
_SAMPLES = [
    "What does section 103 say?", "धारा १०३ क्या है", "कायदा काय आहे", "ধারা ১০৩ কী বলে", "ধাৰা ১০৩ ত কি আছে", "કલમ ૧૦૩ શું છે", "ਧਾਰਾ 103 ਕੀ ਹੈ",
    "ଧାରା ୧୦୩ କଣ", "பிரிவு 103 என்ன", "సెక్షన్ 103 ఏమిటి", "ಸೆಕ್ಷನ್ 103 ಏನು", "വകുപ്പ് 103 എന്ത്", "What does धारा 103 say?", "धा",
]
_SAMPLE_SQL = "s AS (SELECT n_nationkey, i, t FROM nation, (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(_SAMPLES)) + ") v(i, t))"


def _samples(spark, d):
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("t")) for i, s in enumerate(_SAMPLES)]))
    return table(spark, d, "nation").select("n_nationkey", rows.alias("s")).select("n_nationkey", "s.*")


def _counts_sql() -> str:
    return ", ".join(f"len(regexp_extract_all(t, '[{cls}]')) AS c{i}" for i, (_, cls, _) in enumerate(legal.SCRIPTS))


def _hits_sql(words: list[str]) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) / {len(w)}" for w in words)


@query("language_id", f"""WITH {_SAMPLE_SQL}, u AS (SELECT n_nationkey AS a, i::BIGINT AS b, t FROM s UNION ALL SELECT -1, doc_id, text FROM documents),
    c AS (SELECT *, {_counts_sql()}, len(regexp_extract_all(t, '[A-z]')) AS latin FROM u),
    g AS (SELECT *, greatest({', '.join(f'c{i}' for i in range(9))}) AS top FROM c)
    SELECT a, b, CASE WHEN top < 3 OR top < latin THEN 'en' {' '.join(
      f"WHEN c{i} = top THEN " + (f"CASE WHEN {_hits_sql(legal.MARATHI)} > {_hits_sql(legal.HINDI)} THEN 'mr' ELSE 'hi' END" if i == 0
      else "CASE WHEN regexp_matches(t, '[ৰৱ]') THEN 'as' ELSE 'bn' END" if i == 1 else f"'{lang}'") for i, (_, _, lang) in enumerate(legal.SCRIPTS))} END AS lang FROM g""")
def language_id(spark, d):
    s = _samples(spark, d).select(F.col("n_nationkey").alias("a"), F.col("i").cast("long").alias("b"), "t")
    docs = table(spark, d, "documents").select(F.lit(-1).alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("t"))
    return s.union(docs).select("a", "b", legal.language(F.col("t")).alias("lang"))


@query("digit_normalize", f"WITH {_SAMPLE_SQL} SELECT n_nationkey, i, translate(t, '{legal.INDIC_DIGITS}', '{'0123456789' * 4}') AS t FROM s")
def digit_normalize(spark, d):
    return _samples(spark, d).withColumn("t", legal.ascii_digits(F.col("t")))


#: Question forms with a number of the row in them.
_ASK = ["What does section {} say?", "BNS {}(2)", "{} BNSS", "within {} days", "case no. {}", "explain {}", "Rs {}", "sec. {} applies", "s. {}.5 lakh"]


@query("section_intent", """WITH q AS (SELECT c_custkey, c_custkey % 900 + 1 AS n, i FROM customer, range(0, 9) r(i))
    SELECT c_custkey, i::INT AS form, CASE WHEN i IN (0, 1, 2, 5, 7) THEN n::VARCHAR END AS section_number, CASE WHEN i = 1 THEN '2' END AS subsection,
           CASE WHEN i = 1 THEN 'BNS' WHEN i = 2 THEN 'BNSS' END AS act FROM q""")
def section_intent(spark, d):
    n = (F.col("c_custkey") % 900 + 1).cast("string")
    asks = F.posexplode(F.array(*[F.concat(*[x for p in zip(map(F.lit, a.split("{}")), [n, F.lit("")]) for x in p]) for a in _ASK]))
    q = dealt(spark, d, "customer").select("c_custkey", asks.alias("form", "q"))
    return q.select("c_custkey", "form", legal.section_intent(F.col("q")).alias("s"), legal.act_mention(F.col("q")).alias("act")).select("c_custkey", "form", "s.*", "act")


@query("detect_references",
       """SELECT o_orderkey, string_agg(r, '|' ORDER BY p) AS refs FROM (SELECT o_orderkey, r, min(p) AS p FROM (SELECT o_orderkey,
      unnest(['section ' || (o_orderkey % 300 + 1) || '(' || (o_custkey % 9 + 1) || ')', 'section 81', 'section 82', 'section 83', 'section 84',
              'section ' || (o_custkey % 200 + 1), 'section 388']) AS r, unnest([1, 2, 3, 4, 5, 6, 7]) AS p FROM orders) GROUP BY o_orderkey, r) GROUP BY o_orderkey""")
def detect_references(spark, d):
    t = F.format_string("see sections 81 to 84, Sections %d and 388 or sub-section (%d) of section %d.",
                        F.col("o_custkey") % 200 + 1, F.col("o_custkey") % 9 + 1, F.col("o_orderkey") % 300 + 1)
    return dealt(spark, d, "orders").select("o_orderkey", F.array_join(legal.references(t), "|").alias("refs"))


# --- structure ---------------------------------------------------------------------------------

_PARSE_LINE = "CASE WHEN l_linenumber = 1 THEN 'CHAPTER V' WHEN l_linenumber % 3 = 2 THEN (l_partkey % 300 + 1) || '. Whoever' WHEN l_linenumber % 3 = 0 THEN '(' || (l_suppkey % 20 + 1) || ') a rule' ELSE 'Provided that' END"


@query("parse_lines", f"""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no, {_PARSE_LINE} AS line FROM lineitem),
    m AS (SELECT *, nullif(regexp_extract(line, '^CHAPTER\\s*([IVXLCDM]+)', 1), '') AS c, try_cast(nullif(regexp_extract(line, '^(\\d{{1,3}})\\.\\s*[A-Za-z(]', 1), '') AS INT) AS n,
            nullif(regexp_extract(line, '^\\((\\d{{1,2}})\\)\\s+', 1), '') AS u FROM l),
    s AS (SELECT *, sum(CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM m)
    SELECT doc_id, line_no, last_value(c IGNORE NULLS) OVER w AS chapter, last_value(n IGNORE NULLS) OVER w AS section,
           last_value(u IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY line_no) AS subsection,
           CASE WHEN line = 'Provided that' THEN 'proviso' ELSE 'body' END AS kind FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def parse_lines(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("line_no"), F.expr(_PARSE_LINE).alias("line"))
    return structure.parse_lines(lines).drop("line", "clause")


@query("structure_validate", """WITH s AS (SELECT l_orderkey AS act_short, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS ordinal,
      CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END AS text FROM lineitem), t AS (SELECT *, number - lag(number) OVER (PARTITION BY act_short ORDER BY ordinal) AS st FROM s)
    SELECT act_short, count(*) AS n_sections, min(number) = 1 AS starts_at_one, coalesce(min(st) > 0, true) AS increasing, coalesce(max(st) = 1 AND min(st) = 1, true) AS contiguous,
           sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END)::BIGINT AS n_empty FROM t GROUP BY act_short""")
def structure_validate(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("act_short"), F.col("l_linenumber").alias("number"), F.row_number().over(order).alias("ordinal"),
                                           F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("text"))
    return structure.validate_structure(s)


@query("chunk_sections", rf"""WITH {_LINES}, b AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 5 = 4 THEN 'proviso' ELSE 'body' END AS kind, (line_no // 3 + 1)::VARCHAR AS sub FROM l0),
    t AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total, last_value(CASE WHEN kind = 'body' THEN sub END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS lab FROM b),
    c AS (SELECT *, coalesce(lab <> lag(lab) OVER (PARTITION BY doc_id ORDER BY line_no), lab IS NOT NULL) AND total > 4000 AS cut FROM t),
    g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM c)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp)::INT AS part, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest, min(lab) AS subsection, bool_or(kind = 'proviso') AS has_proviso
    FROM g GROUP BY doc_id, grp""")
def chunk_sections(spark, d):
    lines = structure.explode_lines(table(spark, d, "documents"))
    blocks = lines.select("doc_id", F.col("line_no").alias("ordinal"), F.col("line").alias("text"), F.when(F.col("line_no") % 5 == 4, "proviso").otherwise("body").alias("kind"),
                          F.floor(F.col("line_no") / 3 + 1).cast("string").alias("subsection"))
    return structure.chunk_sections(blocks, ["doc_id"]).select("doc_id", "part", F.md5("text").alias("digest"), "subsection", "has_proviso")


@query("forms_group", """WITH p AS (SELECT l_orderkey AS src, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS idx,
      CASE WHEN l_returnflag <> 'N' THEN l_partkey % 50 END AS num, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS title, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS conf,
      l_linenumber % 4 <> 0 AS has_text FROM lineitem),
    g AS (SELECT *, sum(CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY idx) AS grp FROM p),
    f AS (SELECT src, grp, max(num) AS num, max(title) AS t, min(idx) AS a, max(idx) AS b, max(CASE WHEN num IS NOT NULL THEN conf END) AS c, bool_or(NOT has_text AND num IS NULL) AS bl FROM g WHERE grp > 0 GROUP BY ALL)
    SELECT src, num AS form_number, coalesce(t, 'Form ' || num) AS title, a::INT AS start_page, b::INT AS end_page, CASE WHEN bl THEN least(c, 0.4::DOUBLE) ELSE c END AS confidence,
           c < 0.5 OR t IS NULL OR bl OR count(*) OVER (PARTITION BY src, num) > 1 AS needs_review FROM f""")
def forms_group(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    r = F.col("l_returnflag")
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.row_number().over(order).alias("idx"), F.when(r != "N", F.col("l_partkey") % 50).alias("form_number"),
        F.when(r == "R", F.col("l_linestatus")).alias("title"), F.when(r == "R", 1.0).otherwise(0.6).alias("confidence"), (F.col("l_linenumber") % 4 != 0).alias("has_text"))
    return structure.group_forms(pages, ["src"])


# --- lookups, sessions, grounding ---------------------------------------------------------------

_CHUNKS = "ch AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'BNS' ELSE 'BNSS' END AS act_short, (doc_id % 358 + 1)::VARCHAR AS section_number, CASE WHEN doc_id % 3 = 0 THEN '(1)' END AS subsection, text FROM documents)"


def _chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "BNS").otherwise("BNSS").alias("act_short"), (F.col("doc_id") % 358 + 1).cast("string").alias("section_number"),
                                               F.when(F.col("doc_id") % 3 == 0, "(1)").alias("subsection"), "text")


@query("section_lookup", f"WITH {_CHUNKS} SELECT item_id AS query_id, doc_id FROM benchmark JOIN ch ON section_number = (item_id % 358 + 1)::VARCHAR AND act_short = 'BNS'")
def section_lookup(spark, d):
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 358 + 1).cast("string").alias("section_number"))
    return wanted.join(_chunks(spark, d).where(ranking.matches(act_short="BNS", chapter=None)), "section_number").select("query_id", "doc_id")


@query("subsection_narrow", f"""WITH {_CHUNKS}, f AS (SELECT *, coalesce(subsection = '(1)' OR (subsection IS NULL AND contains(text, '(1)')), false) AS fits FROM ch),
    g AS (SELECT *, bool_or(fits) OVER (PARTITION BY act_short, section_number) AS hit FROM f) SELECT act_short, section_number, doc_id FROM g WHERE fits OR NOT hit""")
def subsection_narrow(spark, d):
    return ranking.narrow_subsection(_chunks(spark, d), F.lit("1"), ["act_short", "section_number"]).select("act_short", "section_number", "doc_id")


_ANSWER = "'The rule [BNS s. ' || (o_custkey % 400 + 1) || ' (1)] binds. See 【bnss S.' || (o_orderkey % 400 + 1) || '】 and [Document ' || left(md5(o_custkey::VARCHAR), 8) || ' p.' || (o_orderkey % 30 + 1) || '].'"


def _answers(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.expr(_ANSWER.replace("::VARCHAR", "").replace("md5(o_custkey)", "md5(cast(o_custkey as string))")).alias("text"))


_CITED = "ci AS (SELECT o_orderkey AS answer_id, unnest([0, 1]) AS pos, unnest(['BNS', 'BNSS']) AS act_short, unnest([(o_custkey % 400 + 1)::VARCHAR, (o_orderkey % 400 + 1)::VARCHAR]) AS section_number, unnest(['(1)', '']) AS subsections FROM orders)"


@query("extract_citations", f"WITH {_CITED} SELECT * FROM ci")
def extract_citations(spark, d):
    return grounding.explode_citations(_answers(spark, d))


@query("citation_semi", f"WITH {_CITED}, {_CHUNKS} SELECT * FROM ci WHERE EXISTS (SELECT 1 FROM ch WHERE ch.act_short = ci.act_short AND ch.section_number = ci.section_number)")
def citation_semi(spark, d):
    return grounding.in_evidence(grounding.explode_citations(_answers(spark, d)), _chunks(spark, d))


@query("citation_anti", f"WITH {_CITED}, {_CHUNKS} SELECT * FROM ci WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.act_short = ci.act_short AND ch.section_number = ci.section_number)")
def citation_anti(spark, d):
    return grounding.in_evidence(grounding.explode_citations(_answers(spark, d)), _chunks(spark, d), "left_anti")


@query("page_range_semi", """SELECT o_orderkey AS answer_id, left(md5(o_custkey::VARCHAR), 8) AS document_id, (o_orderkey % 30 + 1)::INT AS page FROM orders WHERE EXISTS (SELECT 1 FROM customer
    WHERE left(md5(c_custkey::VARCHAR), 8) = left(md5(o_custkey::VARCHAR), 8) AND c_custkey % 3 > 0 AND o_orderkey % 30 + 1 BETWEEN c_custkey % 20 AND c_custkey % 20 + 9)""")
def page_range_semi(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 8).alias("document_id"),
        (F.col("c_custkey") % 20).alias("page_start"), (F.col("c_custkey") % 20 + 9).alias("page_end"))
    return grounding.page_in_evidence(grounding.explode_document_citations(_answers(spark, d)), c).select("answer_id", "document_id", "page")


_GUARD_T = "Whoever does so is liable to a fine. The court decides [BNS s.{}]. Prison follows for an offence."


@query("citation_guard", f"""WITH {_CHUNKS}, a AS (SELECT o_orderkey AS answer_id, EXISTS (SELECT 1 FROM ch WHERE act_short = 'BNS' AND section_number = (o_custkey % 400 + 1)::VARCHAR) AS ok FROM orders)
    SELECT answer_id, i::INT AS seq, CASE i WHEN 1 THEN CASE WHEN ok THEN 'keep' ELSE 'invalid_citation' END WHEN 0 THEN CASE WHEN ok THEN 'keep' ELSE 'uncited_claim' END ELSE 'uncited_claim' END AS rule
    FROM a, range(0, 3) r(i)""")
def citation_guard(spark, d):
    a, b = _GUARD_T.split("{}")
    answers = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit(a), (F.col("o_custkey") % 400 + 1).cast("string"), F.lit(b)).alias("text"))
    return grounding.guard(answers, _chunks(spark, d)).select("answer_id", "seq", "rule")


@query("doc_position", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS position FROM orders")
def doc_position(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("document_id"))
    return sessions.positions(o).select(F.col("document_id").alias("o_orderkey"), "position")


@query("history_last_n", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3")
def history_last_n(spark, d):
    return sessions.last_turns(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query("context_docs", """SELECT conv_id, left(md5(arg_max(text, turn)), 8) AS doc FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def context_docs(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'")
    t = t.withColumn("text", F.concat(F.lit("As said [Document "), F.substring(F.md5(F.col("text").cast("binary")), 1, 8), F.lit(" p.2].")))
    last = t.groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    ids = F.slice(F.array_distinct(F.transform(legal.document_citations(F.col("t")), lambda x: x["document_id"])), 1, 4)
    return last.select("conv_id", F.array_join(ids, ",").alias("doc"))


@query("cache_delta", "SELECT doc_id AS chunk_id, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL AND NOT (doc_id % 3 <> 0 AND doc_id % 5 <> 0)")
def cache_delta(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    cached = docs.where("chunk_id % 3 <> 0").select("chunk_id", F.sha2(F.when(F.col("chunk_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    return sessions.cache_delta(docs, cached)


@query("missing_docs", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def missing_docs(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id")).distinct()
    return tables.without_documents(table(spark, d, "orders").withColumnRenamed("o_orderkey", "document_id"), gone).select(F.col("document_id").alias("o_orderkey"))


@query("dedup_fingerprint", "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def dedup_fingerprint(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("search_view", f"WITH {_CHUNKS} SELECT doc_id AS chunk_id, act_short, section_number, 'doc-' || doc_id || '#page=' || (doc_id % 40 + 1) || '-' || (doc_id % 40 + 2) AS source_uri, length(text) AS n_chars FROM ch")
def search_view(spark, d):
    page = F.col("doc_id") % 40
    uri = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("#page="), (page + 1).cast("string"), F.lit("-"), (page + 2).cast("string"))
    return _chunks(spark, d).select(F.col("doc_id").alias("chunk_id"), "act_short", "section_number", uri.alias("source_uri"), F.length("text").cast("long").alias("n_chars"))


@query("retrieved_sections", """SELECT l_orderkey AS query_id, l_partkey % 50 AS section, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL""")
def retrieved_sections(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 50).alias("section")).agg(F.min("l_linenumber").alias("rank"))


@query("upload_validation", r"""SELECT page_id, i::INT AS form, CASE i WHEN 0 THEN NULL WHEN 1 THEN 'INVALID_FILENAME' WHEN 2 THEN 'INVALID_FILENAME' WHEN 3 THEN 'EMPTY_FILE' WHEN 4 THEN 'UNSUPPORTED_TYPE' WHEN 5 THEN 'UNSUPPORTED_TYPE'
    WHEN 6 THEN 'INVALID_PDF' WHEN 7 THEN CASE WHEN octet_length(encode(html)) + 5 > 2000 THEN 'FILE_TOO_LARGE' END END AS error_code FROM pages, range(0, 8) r(i)""")
def upload_validation(spark, d):
    pdf, kind = F.lit("%PDF-1"), F.lit("application/pdf")
    forms = [
        (F.lit("a.PDF"), pdf, kind), (F.lpad(F.lit("a.pdf"), 256, "x"), pdf, kind), (F.lit("a\n.pdf"), pdf, kind), (F.lit("a.pdf"), F.lit(""), kind), (F.lit("a.pdf"), pdf, F.lit("text/html")),
        (F.lit("a.txt"), pdf, kind), (F.lit("a.pdf"), F.lit("<html>"), kind), (F.lit("a.pdf"), F.concat(F.lit("%PDF-"), "html"), kind),
    ]
    cases = F.array(*[F.struct(n.alias("n"), c.cast("binary").alias("c"), t.alias("t")) for n, c, t in forms])
    p = table(spark, d, "pages").select("page_id", F.posexplode(cases).alias("form", "u"))
    return p.select("page_id", "form", workflow.upload_error(F.col("u.n"), F.col("u.c"), F.col("u.t"), 2000).alias("error_code"))


@query("source_fingerprint", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def source_fingerprint(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@query("chunk_id_parse", "SELECT doc_id, 'doc' || doc_id AS document_id, (doc_id % 90 + 1)::INT AS page FROM documents")
def chunk_id_parse(spark, d):
    cid = F.format_string("doc%d-p%04d-%03d", "doc_id", F.col("doc_id") % 90 + 1, F.col("doc_id") % 7)
    get = lambda i: F.regexp_extract(cid, r"^(.*)-p(\d{4})", i)
    return table(spark, d, "documents").select("doc_id", get(1).alias("document_id"), get(2).cast("int").alias("page"))


@query("render_tokens", "SELECT conv_id, turn, len(string_split(text, ' '))::INT AS n, md5(array_to_string(string_split(text, ' '), '_')) AS digest FROM conversations")
def render_tokens(spark, d):
    t = F.split("text", " ", -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).alias("n"), F.md5(F.array_join(t, "_")).alias("digest"))


@query("evidence_prompt", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def evidence_prompt(spark, d):
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))), lambda x: x["t"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(blocks, "\n\n")).alias("digest"))


@query("provider_order", "SELECT s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 - 2 + 1000 * count(*) OVER (PARTITION BY s_nationkey)) % count(*) OVER (PARTITION BY s_nationkey) AS place FROM supplier")
def provider_order(spark, d):
    w = Window.partitionBy("s_nationkey")
    rn = F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", F.pmod((rn - 1 - 2).cast("long"), F.count("*").over(w)).alias("place"))


# --- metrics and state -------------------------------------------------------------------------


@query("percentile_nearest", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def percentile_nearest(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(evaluation.nearest_rank("value", 0.5).alias("p50"), evaluation.nearest_rank("value", 0.95).alias("p95"), F.count("*").alias("n"))


_BOUNDS = [0.5, 1, 5, 10, 25, 50, 75, 100, 250, 500]


@query("histogram_buckets", "WITH b AS (SELECT unnest([" + ", ".join(f"{float(x)}::DOUBLE" for x in _BOUNDS) + """]) AS le) SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, le,
    sum(CASE WHEN value <= le THEN 1 ELSE 0 END)::BIGINT AS bucket FROM events, b GROUP BY event_type, le""")
def histogram_buckets(spark, d):
    return evaluation.histogram(table(spark, d, "events"), ["event_type"], "value", _BOUNDS)


@query("prometheus_text", """SELECT 'requests_total{event_type="' || event_type || '",user="' || user_id || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id""")
def prometheus_text(spark, d):
    n = table(spark, d, "events").groupBy("event_type", F.col("user_id").alias("user")).agg(F.count("*").alias("n"))
    return tables.prometheus(n, "requests_total", ["event_type", "user"], "n")


@query("run_summary", """WITH c AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'doc-' WHEN event_id % 3 = 1 THEN 'combined-' ELSE 'statute-' END || event_id AS case_id, user_id % 10 = 9 AS bad FROM events)
    SELECT event_type AS config, count(*) AS cases, count(*) FILTER (bad) AS failed_cases, coalesce(string_agg(case_id, ',' ORDER BY case_id) FILTER (bad), '') AS failures,
    round(avg(event_id % 2) FILTER (NOT bad), 9) AS recall_at_5, round(avg(event_id % 4) FILTER (NOT bad), 9) AS recall_at_10, round(avg(1.0::DOUBLE / (1 + event_id % 5)) FILTER (NOT bad), 9) AS mrr,
    round(avg(CASE WHEN event_id % 2 = 0 THEN user_id % 3 END) FILTER (NOT bad), 9) AS citation_accuracy, round(avg(user_id % 2) FILTER (NOT bad), 9) AS refusal_correctness,
    round(avg((event_id % 7 = 0)::INT) FILTER (NOT bad AND event_id % 3 < 2), 9) AS document_hit_rate, quantile_disc(value, 0.5) FILTER (NOT bad) AS retrieval_latency_p50,
    quantile_disc(value, 0.95) FILTER (NOT bad) AS retrieval_latency_p95, quantile_disc(CASE WHEN event_type <> 'view' THEN value END, 0.5) FILTER (NOT bad) AS generation_latency_p50,
    quantile_disc(CASE WHEN event_type <> 'view' THEN value END, 0.95) FILTER (NOT bad) AS generation_latency_p95 FROM c GROUP BY event_type""")
def run_summary(spark, d):
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    kind = F.when(e % 3 == 0, "doc-").when(e % 3 == 1, "combined-").otherwise("statute-")
    cases = table(spark, d, "events").select(
        F.col("event_type").alias("config"), F.concat(kind, e.cast("string")).alias("case_id"), F.when(u % 10 == 9, "failed").alias("error"), (e % 2).cast("double").alias("recall_at_5"),
        (e % 4).cast("double").alias("recall_at_10"), (1.0 / (1 + e % 5)).alias("reciprocal_rank"), F.when(e % 2 == 0, (u % 3).cast("double")).alias("citation_accuracy"),
        (u % 2).cast("double").alias("refusal_correct"), (e % 7 == 0).alias("document_hit"), v.alias("retrieval_latency"), F.when(F.col("event_type") != "view", v).alias("generation_latency"),
    )
    return evaluation.run_summary(cases)


@query("cost_rollup", "SELECT role, sum(length(text))::BIGINT AS units, round(sum(length(text)) / 1000.0::DOUBLE * 0.002, 6) AS cost FROM conversations GROUP BY role")
def cost_rollup(spark, d):
    units = F.sum(F.length("text"))
    return table(spark, d, "conversations").groupBy("role").agg(units.alias("units"), F.round(units / 1000.0 * 0.002, 6).alias("cost"))


@query("feedback_votes", "SELECT user_id, event_type AS vote, count(*) AS n FROM events GROUP BY user_id, event_type")
def feedback_votes(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("vote")).agg(F.count("*").alias("n"))


@query("readiness", "SELECT user_id, bool_and(event_type <> 'error') AS ready FROM events GROUP BY user_id")
def readiness(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type") != "error").alias("ready"))


@query("job_latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def job_latest_status(spark, d):
    return state.latest_status(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("circuit_breaker", """WITH e AS (SELECT event_id, user_id, ts, (event_type = 'error')::INT AS bad FROM events), r AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
    f AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r)
    SELECT event_id, user_id, n::BIGINT AS failures, CASE WHEN n > 0 THEN least(60.0::DOUBLE * pow(2.0::DOUBLE, n - 1), 3600.0::DOUBLE) ELSE 0.0::DOUBLE END AS cooldown FROM f""")
def circuit_breaker(spark, d):
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return state.circuit_breaker(e, "user_id", "failed")


@query("rate_limit_fold")
def rate_limit_fold(spark, d):
    return state.rate_limit(table(spark, d, "events"), "user_id", limit=3, window=86400.0)


@query("sibling_lead", "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def sibling_lead(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Extension: tumbling windows over the request log."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n")
