"""Byte-level BPE, ranked search and hard negatives: edge cases and brute-force twins."""

import random
import re
from collections import Counter
from hashlib import sha256
from math import floor, log

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from folioscan.llm import bpe, lexical, negatives, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


# --- 11 byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec(tokens):
    return bpe.Codec(bpe.serialise(tokens), PATTERN)


@pytest.fixture(scope="module")
def twin(tokens):
    return tiktoken.Encoding("twin", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe_over_whole_documents(spark, data, twin):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    hashed = lambda b: sha256(b).hexdigest()
    got = queries.op11_byte_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = twin.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashed(",".join(map(str, ids)).encode()), hashed(texts[r.doc_id].encode()))


def test_bpe_of_every_character(codec, twin):
    for begin in range(0, 0x30000, 512):
        text = "".join(f"a{chr(c)}b {chr(c)}\n 1{chr(c)}  " for c in range(begin, begin + 512) if not 0xD800 <= c < 0xE000)
        assert codec.encode(text).tolist() == twin.encode_ordinary(text)


def test_bpe_of_random_texts_and_a_short_memo(codec, twin, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    rng = random.Random(3)
    for n in (0, 1, 5, 300, 3000):
        text = "".join(rng.choice("aab cé\n\t'sß日本🙂́\x00  12  .") for _ in range(n))
        assert codec.encode(text).tolist() == twin.encode_ordinary(text)
    assert codec.encode("x" * 100_000).tolist() == twin.encode_ordinary("x" * 100_000)


def test_bpe_of_whole_tokens_that_no_merge_reaches(tmp_path):
    """A pre-token that is a token is that token, even where merges end elsewhere."""
    table = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc"]
    table[-1], odd = b"abx", b"xyz"
    tokens = [*table, odd]
    own = bpe.Codec(bpe.serialise(tokens), PATTERN)
    other = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for text in ("xyz", "abc", "abx xyz xyzz", "bcbcab"):
        assert own.encode(text).tolist() == other.encode_ordinary(text)


def test_bpe_rank_files(tmp_path, tokens):
    bad = tmp_path / "gap"
    bad.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(bad))
    bad.write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(bad))
    assert all(bpe.to_bytes(bpe.to_piece(t)) == t for t in tokens)


def test_bpe_odd(spark, odd, odd_rows, empty):
    got = bpe.encode(odd.withColumn("ids", F.lit("x")), PATH, PATTERN, ("doc_id", "ids", "score")).collect()
    assert len(got) == len(odd_rows) and all(isinstance(r.ids, list) for r in got)
    assert sorted(map(repr, (tuple(r.ids) for r in got if r.doc_id in (4, 5)))) == ["()", "()"]
    assert bpe.decode(bpe.encode(empty, PATH, PATTERN), PATH).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1, None]), (4, [10**6]), (5, [-1]), (6, [64, 65])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()}
    table = bpe.read_ranks(PATH)
    assert got == {1: b"", 2: b"", 3: None, 4: None, 5: None, 6: table[64] + table[65]}


# --- 12 ranked search


def ranked(docs, items, k=20):
    """The contract's formula, document by document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    texts = {}
    for item, text in dict.fromkeys(items):
        texts.setdefault(item, Counter()).update(words(text))
    for item, query in texts.items():
        scores = []
        for at, (i, bag) in enumerate(bags):
            m = 75 + 25 * bag.total() * n // total
            score = sum(q * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, q in query.items() if bag[t])
            if score > 0:
                scores.append((-score, i is None, i, at))
        out += [(item, r, i, -s) for r, (s, _, i, _) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("segment", "item_terms"), [(8192, 1 << 18), (7, 3), (64, 20)])
def test_search_against_the_formula(spark, segment, item_terms):
    rng = random.Random(segment)
    word = lambda: rng.choice(["a", "the", "B", "Ünter", "x1", "zebra", "日本", "q" + str(rng.randint(0, 30))])
    docs = [(rng.randint(0, 60), " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 400])))) for _ in range(90)]
    docs += [(100 + i, "zebra the") for i in range(30)] + [(None, "zebra the"), (None, None), (7, None), (8, "   ")]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 9, 60])))) for i in range(9)] + [(20, None), (21, ""), (22, "absent"), (None, "zebra"), (3, "the the THE zebra"), (3, "the the THE zebra")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = lexical.search(d, i, segment=segment, item_terms=item_terms).collect()
    assert sorted(repr(tuple(r)) for r in got) == ranked(docs, items)


def test_index_against_sums():
    rng = np.random.default_rng(5)
    for size in (1, 63, 64, 65, 500):
        t = rng.integers(0, 5, 300)
        at = rng.integers(0, size, 300)
        keep = np.unique(t * size + at, return_index=True)[1]
        t, at = t[keep], at[keep]
        impact = rng.integers(0, 1 << 34, len(t)) * rng.integers(0, 2, len(t))
        index = lexical.Index(size, t, at, impact)
        for query in ([(0, 1)], [(0, 5), (1, 1), (4, 1000)], [(9, 2)], [], [(i, 3) for i in range(5)]):
            want = np.zeros(size, np.int64)
            for name, qtf in query:
                np.add.at(want, at[t == name], qtf * impact[t == name])
            places = sorted(np.flatnonzero(want), key=lambda p: (-want[p], p))
            for k in (1, 20, 1000):
                got, score = index.top(index.add(query), k)
                assert got.tolist() == places[:k] and score.tolist() == want[places[:k]].tolist()


def test_search_odd(spark, odd, odd_rows, empty):
    items = spark.createDataFrame([(1, "x bcd", 2.0), (2, None, None)], "item_id int, text string, score double")
    got = lexical.search(odd, items).collect()
    assert sorted(repr(tuple(r)) for r in got) == ranked([r[:2] for r in odd_rows], [(1, "x bcd"), (2, None)])
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.where("false")).count() == 0
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot words here").otherwise(F.concat(F.lit("other words "), "id")).alias("text"))
    got = lexical.search(same, spark.createDataFrame([(1, "hot")], "item_id int, text string"), segment=128).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [i for i in range(60) if i % 3][:20] and len({r.score for r in got}) == 1


# --- 13 hard negatives


def mined(rows, anchors, n_positive=5, n_negative=10):
    whole = {(i, y, tuple(floor(256 * x) for x in v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and abs(x) < float("inf") for x in v)}
    out = []
    for a, y, v in whole:
        if anchors(a):
            score = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in whole if i != a and len(w) == len(v))
            for s, i, z in [x for x in score if x[2] == y][:n_positive]:
                inside = [x for x in score if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s]
                out += [(a, i, r, j, -s, -t) for r, (t, j, _) in enumerate(inside[:n_negative], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("block", "anchor_block"), [(8192, 2048), (37, 3)])
def test_negatives_against_all_pairs(spark, block, anchor_block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 9))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.4 * rng.normal(size=9)], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(300 + i, rows[0][1], i % 3) for i in range(150)]  # one vector many times
    rows += [(500, [0.0] * 9, 1), (510, [0.0] * 9, 2), (511, None, 1), (512, [1.0] * 9, None), (513, [float("nan")] * 9, 1), (514, [float("inf")] + [1.0] * 8, 1), (515, [None] * 9, 1), (None, [1.0] * 9, 1), (520, [1.0, 2.0], 1), (521, [1.0, 2.5], 2), (522, [1.0, 2.2], 1), (523, [], 1)]
    rows += [rows[10], (20, rows[5][1], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, block=block, anchor_block=anchor_block).collect()
    assert sorted(repr(tuple(r)) for r in got) == mined(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(3000, 33)) * 0.2).astype(np.int64)
    x[:50] = x[0]
    file = negatives.ApproximationFile(x)
    pruned = 0
    for q in x[::300]:
        least, most = file.bounds(q)
        score = x @ q
        assert (least <= score).all() and (score <= most).all()
        pruned += (most < np.partition(least, len(x) - 5)[len(x) - 5]).sum()
    assert pruned > 5 * len(x)
    big = negatives.ApproximationFile(x * 10**16)
    least, most = big.bounds(x[1] * 10**16)
    exact = (x.astype(object) * 10**16) @ (x[1].astype(object) * 10**16)
    assert all(a <= b <= c for a, b, c in zip(least, exact, most))


def test_negatives_odd(spark):
    kind = "vec_id long, embedding array<float>, label int, score double, rank string"
    assert negatives.mine(spark.createDataFrame([], kind), F.col("vec_id") % 10 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.5, "x"), (1, [1.0, 0.1], 1, 0.5, "x"), (2, [0.5, 0.5], 2, None, None)], kind)
    got = [tuple(r) for r in negatives.mine(few, F.col("vec_id") % 10 == 0).collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768)]
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1), (2, [5e299], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.mine(huge, F.col("vec_id") % 10 == 0).count() >= 0
