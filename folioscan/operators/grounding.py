"""Answers against evidence: citations as joins, sentence rules as flags, one ladder for the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.legal import citations, document_citations


def explode_citations(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, pos, act_short, section_number, subsections) of every statute citation."""
    return answers.select(key, F.posexplode(citations(F.col(text))).alias("pos", "c")).select(key, "pos", "c.*")


def explode_document_citations(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    return answers.select(key, F.posexplode(document_citations(F.col(text))).alias("pos", "c")).select(key, "pos", "c.*")


def in_evidence(cited: DataFrame, evidence: DataFrame, how: str = "left_semi") -> DataFrame:
    """Citations whose act and section the evidence has (or, ``left_anti``, has not)."""
    return cited.join(evidence.select("act_short", "section_number").distinct(), ["act_short", "section_number"], how)


def page_in_evidence(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document citations that a chunk's page range covers; without a page the document suffices."""
    c = chunks.select(F.col("document_id").alias("__d"), "page_start", "page_end")
    covers = F.col("page").isNull() | F.col("page").between(F.col("page_start"), F.col("page_end"))
    return cited.join(c, (F.col("document_id") == F.col("__d")) & covers, "left_semi")


def sentences(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, paragraph, seq, sentence): sentences end at a stop followed by white space."""
    p = answers.select(key, F.posexplode(F.split(text, r"\n+")).alias("paragraph", "__p"))
    return p.select(key, "paragraph", F.posexplode(F.split("__p", r"(?<=[.!?।॥])\s+")).alias("seq", "sentence")).where("trim(sentence) <> ''")


def guard(answers: DataFrame, evidence: DataFrame, key: str = "answer_id") -> DataFrame:
    """Sentences with the rule that decides them and whether they stay.

    A sentence goes if it cites a section that the evidence lacks, or if it states a legal consequence without a
    citation and the next sentence of its paragraph has no valid one either.
    """
    #: Words of a legal consequence.
    claim = r"(?i)\b(punish\w*|imprison\w*|fine[sd]?|liable|offence|penalty|sentence[sd]?)\b"
    s = sentences(answers, key)
    cited = explode_citations(s.withColumn("__k", F.struct(key, "paragraph", "seq")), "__k", "sentence")
    known = evidence.select("act_short", "section_number").distinct().withColumn("__ok", F.lit(1))
    judged = cited.join(known, ["act_short", "section_number"], "left").groupBy("__k").agg(
        F.count("*").alias("n_cited"), F.sum(F.when(F.col("__ok").isNull(), 1).otherwise(0)).alias("n_invalid")
    )
    flags = s.join(judged.select("__k.*", "n_cited", "n_invalid"), [key, "paragraph", "seq"], "left").fillna(0, ["n_cited", "n_invalid"])
    nxt = Window.partitionBy(key, "paragraph").orderBy("seq")
    grounded = F.coalesce(F.lead(((F.col("n_cited") > 0) & (F.col("n_invalid") == 0)).cast("int")).over(nxt), F.lit(0)) == 1
    rule = (
        F.when((F.col("n_cited") == 0) & F.col("sentence").rlike(claim) & ~grounded, "uncited_claim")
        .when(F.col("n_invalid") > 0, "invalid_citation").otherwise("keep")
    )
    return flags.withColumn("rule", rule).select(key, "paragraph", "seq", "sentence", "n_cited", "n_invalid", "rule")
