"""Acts across languages, refusals, conversation titles, labels and their sources, title grades; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import language
from folioscan.operators import labels, titles, workflow
from folioscan.sources import exposition, tables
from folioscan.streaming import failover, state
from folioscan.plans.retrieval import dealt, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _quoted(t) -> str:
    return "NULL" if t is None else "'" + t.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(x if isinstance(x, str) and x.startswith("[]") else _quoted(x) if not isinstance(x, int) else str(x) for x in (i, *r)) + ")" for i, r in enumerate(rows)) + ")"


def _formed(spark, d, forms: list[tuple], names: list[str]) -> DataFrame:
    """(c_custkey, form, names): every customer with every form, the customer's number in place of {}."""
    number = F.col("c_custkey").cast("string")
    part = lambda t: F.lit(None).cast("string") if t is None else F.replace(F.lit(t), F.lit("{}"), number)
    rows = F.array(*[F.struct(F.lit(i).alias("form"), *[part(t).alias(n) for t, n in zip(f, names)]) for i, f in enumerate(forms)])
    return dealt(spark, d, "customer").select("c_custkey", F.inline(rows))


_IPC, _BNS, _BNSS, _CRPC = "Indian Penal Code", "Bharatiya Nyaya Sanhita", "Bharatiya Nagarik Suraksha Sanhita", "Code of Criminal Procedure"
#: Originals, translations, and what these come to.
_REPAIRS = [
    ("भारतीय न्याय संहिता की धारा {}", f"Section {{}} of the {_IPC}", f"Section {{}} of the {_BNS}"),
    ("BNS और दंड प्रक्रिया संहिता की धारा {}", "Section {} of the IPC and the BNSS", f"Section {{}} of the {_CRPC} and the {_BNS}"),
    ("भारतीय दण्ड संहिता {}", "Section {}  ", f"Section {{}} ({_IPC})"),
    ("BNS, BNSS {}", "The ipc says {}", f"The {_BNSS} says {{}} ({_BNS})"),
    ("the {} ipcs", f"The {_IPC} {{}}", f"The {_IPC} {{}}"),
    ("crpc {}", f"The crpc and the {_IPC} {{}}", f"The crpc and the {_IPC} {{}}"),
    ("कोई धारा {}", "Any section {} of the CrPC", "Any section {} of the CrPC"),
]


@query("act_repair", f"SELECT c_custkey, i::INT AS form, replace(w, '{{}}', c_custkey::VARCHAR) AS repaired FROM customer, {_values(_REPAIRS)} v(i, o, t, w)")
def act_repair(spark, d):
    return _formed(spark, d, _REPAIRS, ["o", "t", "w"]).select("c_custkey", "form", language.repair_acts(F.col("o"), F.col("t")).alias("repaired"))


_MENTIONS = [
    ("BNS, bnss and the {}", f"{_BNSS}|{_BNS}"), ("{}ipc ipcs crpc.", _CRPC), ("भारतीय न्याय संहिता भारतीय दंड संहिता {}", f"{_BNS}|{_IPC}"), ("{} of the act", ""), (None, ""),
]


@query("act_mentions", f"SELECT c_custkey, i::INT AS form, w AS acts FROM customer, {_values(_MENTIONS)} v(i, o, w)")
def act_mentions(spark, d):
    return _formed(spark, d, _MENTIONS, ["o", "w"]).select("c_custkey", "form", F.array_join(language.mentioned_acts(F.col("o")), "|").alias("acts"))


#: Preferences, detected languages, answers, and the language and refusal that these come to.
_CHOICES = [
    ("auto", "hi", "Answer {}.", "hi", None), ("ta", "en", f"So {{}}: {language.REFUSALS['en']}", "ta", "model_refusal"), ("xx", "mr", language.REFUSALS["bn"] + " ", "mr", "model_refusal"),
    (None, "en", " ", "en", "empty_answer"), ("as", "as", f"{language.REFUSALS['en']} Not {{}}.", "as", None),
]


@query("answer_language", f"""SELECT c_custkey, i::INT AS form, l AS language, r AS text, why AS refusal FROM customer, {_values(_CHOICES)} v(i, p, d, a, l, why)
    JOIN {_values([(k, t) for k, t in language.REFUSALS.items()])} t(j, k, r) ON k = l""")
def answer_language(spark, d):
    chosen = language.answer_language(F.col("p"), F.col("d"))
    refusal = workflow.refusal(F.lit(True), F.col("a"), F.lit(1), F.lit(False))
    return _formed(spark, d, _CHOICES, list("pdalw")).select("c_custkey", "form", chosen.alias("language"), language.refusal_text(chosen).alias("text"), refusal.alias("refusal"))


@query("conversation_titles", r"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
    c AS (SELECT conv_id, regexp_replace(trim(coalesce(t, ''), ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g') AS t FROM f)
    SELECT conv_id, CASE WHEN length(t) > 40 THEN left(t, 40) || '…' WHEN t = '' THEN 'New conversation' ELSE t END AS title FROM c""")
def conversation_titles(spark, d):
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", language.conversation_title(F.col("t")).alias("title"))


_CITING = "Both [BNS s.5(1)] and [Document d3 p.4] say so [bns s.7], see [Document d1] and [Document d3 p.4], not [Note 2] or [Document d9 p.1] [BNS s.5]."


@query("label_sources", f"""WITH s AS (SELECT l_orderkey AS answer_id, l_linenumber AS n, l_partkey % 10 AS sec, 'd' || (l_suppkey % 5) AS f, l_linenumber % 2 = 1 AS statute, l_quantity::BIGINT % 5 AS a FROM lineitem),
    l AS (SELECT answer_id, v.* FROM (SELECT DISTINCT answer_id FROM s), (VALUES (0, 'BNS s.5(1)', 5, NULL, NULL), (1, 'Document d3 p.4', NULL, 'd3', 4), (2, 'bns s.7', 7, NULL, NULL),
          (3, 'Document d1', NULL, 'd1', NULL), (4, 'Document d9 p.1', NULL, 'd9', 1), (5, 'BNS s.5', 5, NULL, NULL)) v(pos, label, sec, f, p))
    SELECT l.answer_id, pos::INT AS pos, label, arg_min(n, n + CASE WHEN statute OR coalesce(p BETWEEN a AND a + 2, false) THEN 0 ELSE 1000 END) AS source_no
    FROM l LEFT JOIN s ON s.answer_id = l.answer_id AND ((statute AND s.sec = l.sec) OR (NOT statute AND s.f = l.f)) GROUP BY ALL""")
def label_sources(spark, d):
    li = table(spark, d, "lineitem")
    statute = F.col("l_linenumber") % 2 == 1
    citation = F.when(statute, F.concat(F.lit("[BNS s."), (F.col("l_partkey") % 10).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[Document d"), (F.col("l_suppkey") % 5).cast("string"), F.lit("]")))
    start = F.col("l_quantity").cast("long") % 5
    sources = li.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("source_no"), citation.alias("citation"), F.when(statute, "statute").otherwise("user_document").alias("source_type"),
                        start.alias("page_start"), (start + 2).alias("page_end"))
    return labels.match_labels(li.select(F.col("l_orderkey").alias("answer_id")).distinct().withColumn("text", F.lit(_CITING)), sources)


@query("title_grades", """WITH p AS (SELECT p_brand, p_partkey % 6 AS i, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g')) AS w FROM part),
    g AS (SELECT p_brand, CASE i WHEN 0 THEN 'exact' WHEN 1 THEN 'near' WHEN 2 THEN CASE WHEN instr(w, ' ') = 0 THEN 'exact' WHEN 2 * length(split_part(w, ' ', 1)) / (length(w) + length(split_part(w, ' ', 1)))::DOUBLE >= 0.85 THEN 'near' ELSE 'partial' END
          WHEN 3 THEN 'wrong' ELSE 'missing' END AS grade FROM p) SELECT p_brand, grade, count(*) AS n FROM g GROUP BY ALL""")
def title_grades(spark, d):
    p = table(spark, d, "part")
    i, plain = F.col("p_partkey") % 6, titles.plain_title(F.col("p_name"))
    got = F.when(i == 0, F.concat(F.upper("p_name"), F.lit("."))).when(i == 1, F.concat(plain, F.lit("7"))).when(i == 2, F.get(F.split(plain, " "), 0)).when(i == 3, "zxq zxq 99999 zxq zxq zxq").when(i == 4, " ")
    graded = titles.grade_titles(p.select("p_partkey", "p_brand", got.alias("got"), F.col("p_name").alias("want")), ["p_brand", "p_partkey"])
    return graded.groupBy("p_brand", "grade").agg(F.count("*").alias("n"))


@query("forms_manifest", """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, l_partkey, l_suppkey FROM lineitem),
    f AS (SELECT l_orderkey, i AS form_number, CASE WHEN l_partkey % 3 = 0 THEN 'BOND and bail-bond' ELSE 'Summons to a WITNESS' END AS title, (i * 2)::INT AS a, l_suppkey % 4 = 0 AS ocr, l_partkey FROM l)
    SELECT l_orderkey, form_number, title, a + 100 AS source_page_start, a + 101 AS source_page_end, 'FORM-' || form_number || CASE WHEN l_partkey % 3 = 0 THEN '_Bond-and-Bail-Bond' ELSE '_Summons-to-a-Witness' END || '.pdf' AS output_filename,
           length('page ' || a || ';page ' || (a + 1) || ';')::INT AS byte_size, sha256('page ' || a || ';page ' || (a + 1) || ';') AS sha256, CASE WHEN ocr THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence, ocr AS needs_review FROM f""")
def forms_manifest(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, d, "lineitem").withColumn("i", F.row_number().over(order)).withColumn("a", F.col("i") * 2)
    title = F.when(F.col("l_partkey") % 3 == 0, "BOND and bail-bond").otherwise("Summons to a WITNESS")
    forms = li.select("l_orderkey", F.col("i").cast("long").alias("form_number"), title.alias("title"), F.col("a").alias("start_page"), (F.col("a") + 1).alias("end_page"), F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_review"))
    page = F.explode(F.array(F.col("a"), F.col("a") + 1))
    pages = li.select("l_orderkey", "a", (F.col("l_suppkey") % 4 == 0).alias("o"), page.alias("page"))
    pages = pages.select("l_orderkey", "page", (F.col("page") + 100).alias("printed_page"), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(";")).alias("content"), (F.col("o") & (F.col("page") > F.col("a"))).alias("ocr"))
    return workflow.forms_manifest(forms, pages, ["l_orderkey"])


_LE = [f"{b:g}" for b in exposition.BUCKETS]


@query("metrics_exposition", f"""WITH c AS (SELECT 'events_total{{event_type="' || event_type || '"}} ' || printf('%g', count(*)::DOUBLE) AS line FROM events GROUP BY event_type),
    g AS (SELECT 'last_value{{event_type="' || event_type || '"}} ' || printf('%g', arg_max(value, (ts, event_id))) AS line FROM events GROUP BY event_type),
    b AS (SELECT unnest([{", ".join(_LE)}]::DOUBLE[]) AS le, unnest([{", ".join(f"'{x}'" for x in _LE)}]) AS said),
    h AS (SELECT 'value_seconds_bucket{{event_type="' || event_type || '",le="' || said || '"}} ' || printf('%g', count(*) FILTER (value / 10 <= le)::DOUBLE) AS line FROM events, b GROUP BY event_type, le, said
          UNION ALL SELECT 'value_seconds_bucket{{event_type="' || event_type || '",le="+Inf"}} ' || printf('%g', count(value)::DOUBLE) FROM events GROUP BY event_type
          UNION ALL SELECT 'value_seconds_count{{event_type="' || event_type || '"}} ' || printf('%g', count(value)::DOUBLE) FROM events GROUP BY event_type
          UNION ALL SELECT 'value_seconds_sum{{event_type="' || event_type || '"}} ' || printf('%g', sum(value / 10)) FROM events GROUP BY event_type)
    SELECT line FROM c UNION ALL SELECT line FROM g UNION ALL SELECT line FROM h
    UNION ALL SELECT unnest(['# HELP events_total Events.', '# TYPE events_total counter', '# HELP last_value The last value.', '# TYPE last_value gauge', '# HELP value_seconds Values.', '# TYPE value_seconds histogram'])""")
def metrics_exposition(spark, d):
    e = table(spark, d, "events")
    counted = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    seconds = e.select("event_type", (F.col("value") / 10).alias("v"))
    return exposition.exposition([
        exposition.expose_histogram(seconds, "value_seconds", "Values.", ["event_type"], "v"), exposition.expose_values(counted, "events_total", "Events.", ["event_type"], "n"),
        exposition.expose_values(counted, "last_value", "The last value.", ["event_type"], "last", "gauge")])


@query("general_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%g', CASE l_partkey % 4 WHEN 0 THEN l_extendedprice * 1000.0::DOUBLE WHEN 1 THEN l_extendedprice / 1000000000.0::DOUBLE WHEN 2 THEN -l_extendedprice ELSE l_discount END) AS said FROM lineitem")
def general_numbers(spark, d):
    price, i = F.col("l_extendedprice"), F.col("l_partkey") % 4
    v = F.when(i == 0, price * 1000.0).when(i == 1, price / 1e9).when(i == 2, -price).otherwise(F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", exposition.general(v).alias("said"))


@query("forget_documents", """SELECT l_orderkey AS session_id, l_partkey || '-p' || l_linenumber AS chunk_id FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) WHERE l_partkey % 3 > 0""")
def forget_documents(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").cast("string").alias("document_id"), F.concat(F.col("l_partkey").cast("string"), F.lit("-p"), F.col("l_linenumber").cast("string")).alias("chunk_id"), "l_partkey").distinct()
    owned = li.where("l_partkey % 2 = 0").select("session_id", "document_id", "chunk_id")  # the map of the others is lost
    return tables.forget_documents(li.select("session_id", "chunk_id"), owned, li.where("l_partkey % 3 = 0").select("session_id", "document_id"))


_STATUS = ["QUEUED", "PARSING", "CHUNKING", "EMBEDDING", "INDEXING", "READY", "FAILED", "LOST"]


@query("status_errors", f"""WITH e AS (SELECT user_id, ts, event_id, event_id % 8 AS s FROM events), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e),
    x AS (SELECT *, CASE WHEN s = 7 THEN 'unknown' WHEN p IS NULL THEN CASE WHEN s > 0 THEN 'begins late' END WHEN p IN (5, 6) THEN 'after its end' WHEN s = 6 THEN NULL WHEN (CASE WHEN p = 7 THEN -1 ELSE p END) + 1 <> s THEN 'skips or repeats' END AS error FROM l)
    SELECT event_id, error FROM x WHERE error IS NOT NULL""")
def status_errors(spark, d):
    e = table(spark, d, "events").withColumn("status", F.get(F.array(*[F.lit(s) for s in _STATUS]), (F.col("event_id") % 8).cast("int")))
    return state.status_errors(e, "user_id", "status", ["ts", "event_id"]).select("event_id", "error")


def failover_replay(spark, d):
    """Every user's events as requests to three providers whose failures depend on the event; the fold has no SQL twin."""
    e = table(spark, d, "events")
    kinds = F.array(*[F.lit(k) for k in ("rate_limit", "timeout", "permanent", "transient", "odd")])
    answer = lambda j: F.struct(F.lit(f"p{j}").alias("provider"), F.when(F.pmod(F.xxhash64("event_id", F.lit(j)), F.lit(3)) == 0, F.get(kinds, (F.col("event_id") % 5).cast("int"))).alias("error"),
                                (F.col("event_id") % 50).cast("double").alias("seconds"), (F.col("event_id") % 2 == 0).alias("emitted"))
    requests = e.select(F.col("user_id").alias("pool"), F.col("event_id").alias("request_id"), "ts", (F.col("event_id") % 4 == 0).alias("stream"), F.array(*[answer(j) for j in range(3)]).alias("outcomes"))
    three = F.inline(F.array(*[F.struct(F.lit(f"p{j}").alias("id"), F.lit(j % 2).alias("priority"), F.lit(True).alias("enabled"), F.lit(j == 2).alias("is_default")) for j in range(3)]))
    providers = e.select(F.col("user_id").alias("pool")).distinct().select("pool", (F.col("pool") % 2 == 0).alias("round_robin"), three)
    return failover.replay(requests, providers)


QUERIES["failover_replay"] = failover_replay
