"""Forms lookup, naming, upload stages, refusals, failover order, session upserts and fused session search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.language import ends_in_refusal
from folioscan.functions.text import once, slug
from folioscan.session import stored

#: The stages of an upload, in order.
STAGES = ("QUEUED", "PARSING", "CHUNKING", "EMBEDDING", "INDEXING", "READY")
#: Cooldowns in seconds by kind of failure.
COOLDOWNS = {"rate_limit": 30.0, "timeout": 60.0, "permanent": 600.0, "transient": 60.0, "unknown": 60.0}
#: Parts of a key whose value is not to be shown.
SECRET_MARKS = ("api_key", "apikey", "password", "secret", "token", "credential")
#: What stands in place of a secret, and how an already masked text begins.
MASK, MASKED = "***redacted***", "**********"
#: A form's header, and lines that are running heads.
FORM_HEADER = r"(?i)^\s*FORM\s+No\.?\s*(\d+)\s*$"
RUNNING_HEAD = r"(?i)GAZETTE\s+OF\s+INDIA|EXTRAORDINARY|UPLOADED\s+BY|PUBLISHED\s+BY|^\(See\s+section"


def form_title(line: Column) -> Column:
    """Whether a line looks like a form's title: four characters or more, over 70 % letters and blanks, no dot leaders."""
    t = F.trim(F.regexp_replace(line, r"\s+", " "))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\s]", ""))
    return (F.length(t) >= 4) & ~line.rlike(FORM_HEADER) & ~t.rlike(RUNNING_HEAD) & ~F.contains(t, F.lit(".....")) & (letters > 0.7 * F.length(t))


def inspect_page(lines: Column) -> Column:
    """(form_number, title, confidence, has_text) of a page's lines.

    A header stands in the first six lines with text; in the first two it is certain, deeper 0.8; a page whose next
    three lines hold no title is worth 0.6 at most, an empty page nothing.
    """
    header = FORM_HEADER
    body = F.filter(lines, lambda x: F.trim(x) != "")
    window = F.slice(body, 1, 6)
    at = F.coalesce(F.array_position(F.transform(window, lambda x: x.rlike(header)), True), F.lit(0)).cast("int")
    number = F.when(at > 0, F.regexp_extract(F.get(window, at - 1), header, 1).cast("int"))
    after = F.filter(F.slice(body, at + 1, 3), form_title)
    title = F.when(at > 0, F.trim(F.regexp_replace(F.get(after, 0), r"\s+", " ")))
    sure = F.when(F.size(body) == 0, 0.0).when(at == 0, 1.0).otherwise(F.when(at <= 2, 1.0).otherwise(0.8))
    sure = F.when((at > 0) & title.isNull(), F.least(sure, F.lit(0.6))).otherwise(sure)
    return F.struct(number.alias("form_number"), title.alias("title"), sure.alias("confidence"), (F.size(body) > 0).alias("has_text"))


def search_forms(queries: DataFrame, forms: DataFrame, stopwords: tuple[str, ...] = ("the", "to", "of", "a", "an", "and", "or", "for", "in")) -> DataFrame:
    """(query_id, form_number, score): exact number, phrase, else all content words, with a bonus for their order.

    An empty question finds nothing. Questions meet forms only on keys that any match must share: the number, the
    phrase's first three characters (fewer where it is shorter), or the first content word.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*stopwords))
    key = lambda kind, value: F.concat(F.lit(kind), value)
    q = queries.select("query_id", F.lower(F.trim("query")).alias("__q"), words(F.col("query")).alias("__w")).where("__q <> ''")
    asked = F.array(key("n:", F.col("__q")), key("g:", F.substring("__q", 1, 3)), key("w:", F.get("__w", 0)))
    f = forms.select("form_number", F.lower(F.concat_ws(" ", "title", slug(F.col("title")))).alias("__h"), words(F.col("title")).alias("__t"))
    grams = lambda h: F.flatten(F.transform(F.sequence(F.lit(1), F.length(h)), lambda i: F.array(*[key("g:", F.substring(h, i, F.lit(n))) for n in (1, 2, 3)])))
    held = F.array_distinct(F.concat(F.array(key("n:", F.col("form_number").cast("string"))), F.when(F.length("__h") > 0, once(F.col("__h"), grams)).otherwise(F.array().cast("array<string>")),
                                     F.transform("__t", lambda w: key("w:", w))))
    # Stored, so that Spark knows how many keys are asked for; forms are only looked up by these, and their texts are sent no further than that.
    wanted = stored(q.select("*", F.explode(F.array_distinct(F.array_compact(asked))).alias("__k")))
    keys = f.select("*", F.explode(held).alias("__k")).join(wanted.select("__k").distinct(), "__k", "left_semi")
    met = wanted.join(keys, "__k").drop("__k")
    distinct = F.array_distinct("__w")
    # Each word is looked for after the one before it; -1 once one is missing there.
    rest = lambda at: F.slice(F.col("__t"), at + 1, F.size("__t"))
    step = lambda at, w: F.when(at < 0, at).when(F.array_contains(rest(F.greatest(at, F.lit(0))), w), at + F.array_position(rest(F.greatest(at, F.lit(0))), w).cast("int")).otherwise(-1)
    ordered = F.aggregate("__w", F.lit(0), step) >= 0
    score = (
        F.when(F.col("__q") == F.col("form_number").cast("string"), 1_000_000).when(F.contains("__h", "__q"), 500_000)
        .when((F.size(distinct) > 0) & (F.size(F.array_except(distinct, "__t")) == 0), F.size(distinct) * 100 + F.when(ordered, 50).otherwise(0))
    )
    scored = met.select("query_id", "form_number", score.cast("long").alias("score")).where("score is not null")
    return scored.groupBy("query_id", "form_number").agg(F.max("score").alias("score"))


def unique_names(rows: DataFrame, name: Column, order: list[str], extension: str = ".pdf") -> DataFrame:
    """Adds ``filename``: the first row of a name keeps it, later ones get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("filename", F.concat(name, F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(extension)))


def remaining_stages(status: Column) -> Column:
    """The stages still ahead; none after a failure."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    at = F.array_position(stages, status).cast("int")
    return F.when(at > 0, F.slice(stages, at + 1, len(STAGES))).otherwise(F.array().cast("array<string>"))


def retry_delay(attempt: Column, retry_after: Column, base: float = 0.5, most: float = 5.0) -> Column:
    """What the server asks for, else doubling from ``base``; ``most`` at most."""
    return F.least(F.coalesce(retry_after, F.lit(base) * F.pow(F.lit(2.0), attempt - 1)), F.lit(most))


def _secret(name: str) -> bool:
    return any(m in name.lower() for m in SECRET_MARKS)


def redacted(value: Column, kind: T.DataType) -> Column:
    """A value without the secrets in it: those of secret keys of maps and structs, at any depth, and texts already masked."""
    if isinstance(kind, T.MapType):
        inner = lambda k, v: redacted(v, kind.valueType)
        if isinstance(kind.valueType, T.StringType):
            inner = lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_MARKS)), MASK).otherwise(redacted(v, kind.valueType))
        return F.transform_values(value, inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [(F.lit(MASK) if _secret(f.name) else redacted(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.StringType):
        return F.when(F.startswith(value, F.lit(MASKED)), MASK).otherwise(value)
    return value


def redact(df: DataFrame) -> DataFrame:
    """All columns without secrets; a column of a secret name is masked as a whole."""
    return df.select(*[(F.lit(MASK) if _secret(f.name) else redacted(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])


def refusal(sufficient: Column, answer: Column, n_citations: Column, echoed: Column) -> Column:
    """Why an answer is refused; null if it stands. The first reason counts; ``model_refusal``: it is or ends in a refusal of some language."""
    return (
        F.when(~sufficient, "insufficient_evidence").when(echoed, "prompt_echo").when(F.trim(F.coalesce(answer, F.lit(""))) == "", "empty_answer")
        .when(ends_in_refusal(answer), "model_refusal").when(n_citations == 0, "no_citations")
    )


def failover_order(providers: DataFrame, now: Column, by: list[str]) -> DataFrame:
    """Adds ``place``: ready providers by priority, then cooling ones by how long ago they failed."""
    cooling = F.col("cooling_until") > now
    order = Window.partitionBy(*by).orderBy(cooling.cast("int"), F.when(cooling, F.col("failed_at")), "priority", "id")
    return providers.withColumn("place", F.row_number().over(order).cast("long"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key over both tables."""
    both = table.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__r"))
    return newest.select(*keys, "__r.*")


def session_fused(dense: DataFrame, lexical: DataFrame, by: list[str], key: str = "chunk_id", k: int = 60) -> DataFrame:
    """Fusion within the dense list's budget: as many rows as it has, or all where it is empty."""
    both = dense.select(*by, key, "rank", F.lit(1).alias("__d")).union(lexical.select(*by, key, "rank", F.lit(0).alias("__d")))
    fused = both.groupBy(*by, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.max("__d").alias("__d"))
    own = Window.partitionBy(*by)
    ranked = fused.withColumn("__n", F.sum("__d").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), key)).cast("long"))
    return ranked.where("__n = 0 or rank <= __n").select(*by, key, "score", "rank")


#: Bounds of an upload.
NAME_LENGTH = 255


def upload_error(filename: Column, content: Column, content_type: Column, max_bytes: int, types: tuple[str, ...] = ("application/pdf",)) -> Column:
    """The code of the first rule that an upload breaks, null if none: name, emptiness, size, type, extension, first bytes."""
    bad_name = filename.isNull() | (filename == "") | (F.length(filename) > NAME_LENGTH) | filename.rlike(r"[\x00-\x1f]")
    size = F.octet_length(content)
    return (
        F.when(bad_name, "INVALID_FILENAME").when(content.isNull() | (size == 0), "EMPTY_FILE").when(size > max_bytes, "FILE_TOO_LARGE")
        .when(~F.coalesce(content_type, F.lit("")).isin(*types), "UNSUPPORTED_TYPE").when(~F.lower(filename).endswith(".pdf"), "UNSUPPORTED_TYPE")
        .when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), "INVALID_PDF")
    )


def form_pages(pages: DataFrame, first: int, last: int) -> DataFrame:
    """The pages (page) of a range; the job fails where the source ends before it."""
    end = pages.agg(F.max("page").alias("__end"))
    guarded = F.when(F.col("__end") < last, F.raise_error(F.concat(F.lit("pages end at "), F.col("__end").cast("string")))).otherwise(F.col("page"))
    return pages.crossJoin(F.broadcast(end)).withColumn("page", guarded).drop("__end").where(F.col("page").between(first, last))


def ocr_capped(forms: DataFrame, pages: DataFrame, by: list[str], most: float = 0.6) -> DataFrame:
    """Forms with a page that was read by OCR: confidence ``most`` or less, and to be reviewed.

    ``pages`` has (by, page, ocr); a form spans start_page to end_page.
    """
    p = pages.where("ocr").select(*by, "page").distinct()
    hit = forms.select(*by, "form_number", F.explode(F.sequence("start_page", "end_page")).alias("page")).join(p, [*by, "page"]).select(*by, "form_number").distinct()
    out = forms.join(hit.withColumn("__ocr", F.lit(True)), [*by, "form_number"], "left").withColumn("__ocr", F.coalesce("__ocr", F.lit(False)))
    return out.withColumn("confidence", F.when(F.col("__ocr"), F.least("confidence", F.lit(most))).otherwise(F.col("confidence"))).withColumn(
        "needs_review", F.col("needs_review") | F.col("__ocr")
    ).drop("__ocr")


def forms_manifest(forms: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, form_number, title, source_page_start, source_page_end, output_filename, byte_size, sha256, confidence, needs_review): a manifest's rows.

    ``forms`` has (by, form_number, title, start_page, end_page, confidence, needs_review), ``pages`` (by, page, printed_page, content, ocr). A form's
    bytes are those of its pages in order; pages that were read by OCR cap its confidence. File names are made of number and title,
    later ones of equal names get -2, -3 and so on within their source, in the order of pages.
    """
    spans = forms.select(*by, "form_number", "start_page", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    own = spans.join(pages.select(*by, "page", "printed_page", "content"), [*by, "page"]).groupBy(*by, "form_number", "start_page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "content"))), lambda x: x["content"]), "").cast("binary").alias("__bytes"),
        F.min_by("printed_page", "page").alias("source_page_start"), F.max_by("printed_page", "page").alias("source_page_end"))
    capped = ocr_capped(forms, pages, by).join(own, [*by, "form_number", "start_page"], "left")
    named = capped.withColumn("__name", F.concat(F.lit("FORM-"), F.col("form_number").cast("string"), F.lit("_"), slug(F.col("title"))))
    n = F.row_number().over(Window.partitionBy(*by, "__name").orderBy("start_page"))
    filename = F.concat("__name", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".pdf"))
    return named.withColumn("output_filename", filename).select(
        *by, "form_number", "title", "source_page_start", "source_page_end", "output_filename", F.octet_length("__bytes").alias("byte_size"), F.sha2("__bytes", 256).alias("sha256"), "confidence", "needs_review")
