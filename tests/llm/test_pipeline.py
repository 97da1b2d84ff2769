"""The pipeline as a whole and stage by stage."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("score", F.lit(1)).withColumn("n_words", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0


def test_decisions_take_effect(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = ["the cat sat on the mat and looked at birds", "eine katze lag auf der matte und schlief lange", "a dog ran over hills to find its friends again"]
    rows = [(i, f"{p} number {i * 7919} {p[::-1]}", "en" if i % 3 != 1 else "de", "s") for i, p in enumerate(prose * 4)]
    rows += [(50, rows[0][1], "en", "s"), (51, passage, "en", "s"), (52, None, "en", "s"), (53, "123 456", "en", "s")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got and not got & {51, 52, 53}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, data, odd, odd_rows, empty, name):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, clashing names; empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, data)
    assert set(odd.columns) <= set(out.columns) and (name == "mix_sources" or out.columns == odd.columns)
    rows, texts = out.collect(), [(r[0], r[1]) for r in odd_rows]
    ids = [r.doc_id for r in rows]
    none = stage(spark, empty, data)
    assert none.count() == 0 and none.columns == out.columns
    if name == "language_id":
        assert all(any(c.isalpha() for c in r.text) for r in rows) and 7 in ids and ids.count(11) in (0, 2) and not {4, 5, 6, 8} & set(ids)
    elif name == "line_dedup":
        assert sorted(map(repr, ids)) == sorted(repr(i) for i, _ in texts)
        kept = [line for r in rows for line in (r.text or "").split("\n") if line.strip()]
        assert len(kept) == len(set(kept)) or {i for i, t in texts if (i, t) in [(r.doc_id, r.text) for r in rows]}
        assert all(r.text is None for r in rows if r.doc_id == 4)
    elif name == "simhash_dedup":
        assert 1 in ids and not {2, 11} & set(ids) and ids.count(None) == 2 and len({4, 5, 6} & set(ids)) == 1 and {7, 9} <= set(ids)
    elif name == "decontaminate":
        assert sorted(map(repr, ids)) == sorted(repr(i) for i, _ in texts)
    else:
        assert all((r.text or "").strip() for r in rows) and all(r["copy"] <= 3 for r in rows)


def test_language_of_signs_only_goes(spark, data):
    """A document whose text has letters of no language that was learned is not sure of any."""
    rng = random.Random(1)
    words = ["the cat sat on the mat and looked at birds in the old garden", "die katze lag auf der matte und schlief sehr lange dort"]
    rows = [(i, " ".join(rng.sample(words[i % 2].split(), 8)), "en" if i % 2 == 0 else "de", "s", 0) for i in range(60)] + [(100, "12 34 ++ ==", "en", "s", 0)]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), data)
    got = {r.doc_id for r in out.collect()}
    assert 100 not in got and len(got) >= 50


def test_line_stage_links_pairs_with_few_common_minima(spark, data):
    """Pairs of lines at a similarity of 0.8 that share a band, though 10 or 11 of their 18 minima differ: no such link is lost."""
    pairs = [
        ("dkoldjaipebiffakbmnakajglbncpaboiknhoifnebkpoedokcpdihininmklin", "jpglpem", "eigdjdc"),
        ("nmngjhkfgmckkmcdaaiekelgaljmhgpnnkmnnhkilcpidahgkhdhpgjkacaejbg", "cklailk", "ooangda"),
        ("mheeffhilbpinohkfdncmahoppdelbnpfoghialfpddalpmnmhclecdobgpmeba", "coobghf", "ihgicok"),
        ("enjefeohobokpinbkopmlahnebpinpmlpndpdbagbmccfdhbdncfaiegdjifofl", "gompihe", "nmldpdd"),
        ("ibgnakdjpemapbfeofkdgdkpgaknlmpapemcpleoplojnkplpgnncjnefmjgape", "balpdaa", "opbmlki"),
    ]
    rows = [(2 * k + i, stem + end, "en", "s", 70) for k, (stem, *ends) in enumerate(pairs) for i, end in enumerate(ends)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, data).collect()}
    assert got == {i: t if i % 2 == 0 else "" for i, t, *_ in rows}
