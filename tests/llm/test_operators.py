"""Edge cases and brute-force twins of the training-data operators."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscan.llm import brown, components, decontaminate, langid, licenses, line_builtin, line_numpy, line_rules, lines, mixture, neighbours, pii, quality, queries, simhash

TABLES = "documents embeddings benchmark labels".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("select doc_id, text, lang from documents").fetchall()


def rows_of(df, *names):
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, data, name):
    got = queries.QUERIES[name](spark, data)
    want = duck.execute(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    names = sorted(got.columns)
    assert rows_of(got, *names) == sorted(repr(tuple(r[n] for n in names)) for r in want)


# --- 1 mixture

def test_mixture_odd(odd, odd_rows, empty):
    got = mixture.mixture(odd).collect()
    assert len(got) == len(odd_rows)
    assert all(r.taken <= 3 * r.size and r.taken == r.repeats * r.size for r in got)
    assert all(r.size == 0 for r in got if r.doc_id in (4, 5, 6))
    assert mixture.mixture(empty).count() == 0 and mixture.mixed_rows(empty).count() == 0


def test_mixed_rows_keep_clashing_columns(odd):
    got = mixture.mixed_rows(odd)
    assert {"score", "held_out", "component_id", "line", "copy", "size"} <= set(got.columns)
    assert got.groupBy("doc_id").count().count() > 0


def test_water_fill(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 100, 2), ("c", 1000, 3)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixture.water_fill(s).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0}


def test_targets_are_met(spark, data):
    got = queries.op1_mix_sources(spark, data).groupBy("target", "source_size").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in got)


# --- 2 lines

@pytest.mark.parametrize("native", [True, False])
def test_lines(spark, native):
    rng = random.Random(1)
    w = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    base = w(40)
    near = base.copy()
    near[20] = "changed"
    texts = [(5, " ".join(base) + "\n\nonly here " + " ".join(w(5))), (2, " ".join(base) + "\n" + " ".join(base)), (9, " ".join(near)), (7, None), (8, ""), (2, "another text of two")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, n_chars int")
    got = {(r.doc_id, r.text): r.n_chars for r in lines.dedup_lines(docs, native).collect()}
    want = {texts[0][1].split("\n", 1)[1], "", None, "another text of two", " ".join(base)}
    assert {t for _, t in got} == want and got[(2, " ".join(base))] == len(" ".join(base))
    assert len(got) == len(docs.collect())


@pytest.mark.parametrize("native", [True, False])
def test_lines_odd(odd, odd_rows, empty, native):
    got = lines.dedup_report(odd, native)
    assert got.count() == len(odd_rows)
    out = lines.dedup_lines(odd, native)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    assert lines.dedup_report(empty, native).count() == 0


def full_drops(rows):
    """Dropped lines by comparing all pairs over shingles at every character."""
    seen = defaultdict(list)
    for i, t in rows:
        for j, line in enumerate((t or "").split("\n")):
            if line.strip():
                seen[line.strip()].append((i, j))
    names = list(seen)
    sets = [{n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in names]
    holders = defaultdict(list)
    edges = defaultdict(set)
    for k, s in enumerate(sets):
        for o, c in Counter(o for g in s for o in holders[g]).items():
            if c >= 0.8 * (len(s) + len(sets[o]) - c):
                edges[k].add(o)
                edges[o].add(k)
        for g in s:
            holders[g].append(k)
    drops, done = set(), set()
    for k in range(len(names)):
        if k not in done:
            group, todo = {k}, [k]
            while todo:
                new = edges[todo.pop()] - group
                group |= new
                todo += new
            done |= group
            drops |= set(sorted(x for m in group for x in seen[names[m]])[1:])
    return drops


@pytest.mark.parametrize("native", [True, False])
def test_lines_against_full_shingles(spark, data, documents, native):
    report = lines.dedup_report(spark.read.parquet(f"{data}/documents.parquet"), True) if native else queries.op2_line_dedup(spark, data)
    got = {(r.doc_id, j) for r in report.collect() for j in r.dropped}
    want = full_drops([(i, t) for i, t, _ in documents])
    assert not got - want and len(want - got) <= 0.02 * len(want)


@pytest.mark.parametrize("native", [True, False])
def test_lines_differ_beyond_a_words_start(spark, native):
    rng = random.Random(5)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    cjk = "".join(map(chr, range(0x4E00, 0x5200)))
    far = [f"https://example.org/{pick('abcdefghijklmnop', 40)}" for _ in range(20)]
    far += ["東京都千代田区丸の内" + pick(cjk, 40) for _ in range(20)]
    far += [" ".join(f"account_number_{pick('0123456789', 14)}" for _ in range(4)) for _ in range(20)]
    url, han, long = f"https://example.org/{pick('qrstuvw', 120)}", pick(cjk, 90), " ".join(pick("abcdefghij", 14) for _ in range(12))
    near = [url, url[:-1] + "x", han, "新" + han, long, long + "s"]
    docs = spark.createDataFrame(list(enumerate(far + near)), "doc_id long, text string")
    got = {r.doc_id for r in lines.dedup_report(docs, native).where("n_kept < n_lines").collect()}
    assert got == {i for i, _ in full_drops(enumerate(far + near))} == {len(far) + k for k in (1, 3, 5)}


@pytest.mark.parametrize("native", [True, False])
@pytest.mark.parametrize("alphabet", ["0124568 ,-", "abcdefgh ", "clopqr,. 9"])
def test_long_lines_of_few_letters(spark, native, alphabet):
    """Pairs of long lines at a similarity of 0.8 to 0.95: bands find nearly all, whatever letters the lines have."""
    rng = random.Random(9)
    pick = lambda n: "".join(rng.choice(alphabet) for _ in range(n)).strip(" ").ljust(n, "1")
    rows = []
    for k in range(60):
        line = list(pick(200))
        other = line.copy()
        for at in rng.sample(range(10, 190), 1 + k % 2):
            other[at] = "z"
        rows += [(2 * k, "".join(line)), (2 * k + 1, "".join(other))]
    want = {i for i, _ in full_drops(rows)}
    got = {r.doc_id for r in lines.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), native).where("n_kept < n_lines").collect()}
    assert got <= want and len(want) >= 50 and len(got) >= 0.95 * len(want)


def test_line_hashes_are_those_of_all_shingles():
    """Distinct hashes against sets of strings, minima against a minimum a line; parts that end within a line change nothing."""
    rng = np.random.default_rng(3)
    alphabet = list("ab c\u00e9\u4eca\U0001f600")
    texts = ["x", "", "short", "exactly8", "abcabcabcabc", "z" * 40] + ["".join(rng.choice(alphabet, rng.integers(1, 300))) for _ in range(40)]
    texts.append("".join(rng.choice(alphabet, 3 * line_numpy.PART + 5)))
    raw = [t.encode() for t in texts] + [b"\xff\xfe broken \xe4\xbb"]
    sets = list(line_numpy.line_hashes(raw))
    assert len(sets) == len(raw)
    shingles = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
    assert [len(s) for s in sets[:-1]] == [len(s) for s in shingles]
    for i, j in zip(rng.integers(0, len(texts), 300), rng.integers(0, len(texts), 300)):
        assert len(np.intersect1d(sets[i], sets[j])) == len(shingles[i] & shingles[j])
    masks = line_rules.MASKS[:5]
    want = [[int(((s >> np.uint64(32)) ^ np.uint64(m >> 32)).min()) for m in masks] for s in sets]
    assert line_numpy.minima(raw, masks).tolist() == want
    assert list(line_numpy.line_hashes([])) == [] and line_numpy.minima([], masks).shape == (0, 5)


@pytest.mark.parametrize("native", [True, False])
def test_lines_of_one_template(spark, native):
    rng = random.Random(6)
    w = lambda n: [" " + "".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(n)]
    frame = "".join(w(20))
    rows = []
    for k in range(400):
        own = w(9)
        rows.append((k, frame + "".join(own)))
        if k % 4 == 0:
            # The copy has one word more and stands anywhere in the order.
            own.insert(rng.randrange(9), w(1)[0])
            rows.append((1000 + k, frame + "".join(own)))
    want = full_drops(rows)
    assert {i for i, _ in want} == {1000 + k for k in range(0, 400, 4)}
    got = lines.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), native).where("n_kept < n_lines")
    assert {r.doc_id for r in got.collect()} == {i for i, _ in want}


def test_lines_that_share_a_band_all_meet(spark):
    """Lines close to 0.8 by their template alone: no similar pair of a band's group stays apart, in groups below and beyond ``WHOLE`` lines."""
    rng = random.Random(8)
    w = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    texts = []
    for n in (60, 300):
        frame = w(300)
        for k in range(n):
            own = w(40)
            texts += [frame + own] + [frame + own[:15] + w(25)] * (k % 3 == 0)
    table = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    groups = defaultdict(list)
    for r in line_builtin.band_rows(table).collect():
        groups[r.key].append(r.lid)
    assert max(map(len, groups.values())) > 128
    pairs = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = list(range(len(texts)))
    for a, b in lines.near_line_edges(table).collect():
        assert len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        root = [root[a] if r == root[b] else r for r in root]
    assert len(want) > 100 and not [(a, b) for a, b in want if root[a] != root[b]]


def test_marks_bound_the_difference(spark):
    """A line's marks, in one array, are the bits of its shingles' hashes; pairs that they rule out, and no others, have too many differing bits."""
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefg \u00e9\u4eca") for _ in range(160)).strip()
    texts = ["x", "exactly8", base] + [base[:at] + "Z" * (1 + at % 7) + base[at + 1 :] for at in range(0, 150, 10)]
    texts += ["".join(rng.choice("abcdefg ") for _ in range(160)).strip() for _ in range(10)]
    table = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    hashes = defaultdict(set)
    for r in line_builtin.hash_rows(table).collect():
        hashes[r.lid].add(r.x)
    bits = {k: {(x % 32, x >> 20 & 63) for x in own} for k, own in hashes.items()}
    marked = line_builtin.marks(table)
    got = {r.lid: r for r in marked.collect()}
    assert {k: {(w, b) for w, word in enumerate(r.marks) for b in range(64) if word >> b & 1} for k, r in got.items()} == bits
    assert {k: r.size for k, r in got.items()} == {k: max(1, len(t) - 7) for k, t in enumerate(texts)}
    pairs = [(a, b) for a in bits for b in bits if a < b]
    left = {tuple(r) for r in lines.possible_pairs(spark.createDataFrame(pairs, "a long, b long"), marked).collect()}
    assert left == {(a, b) for a, b in pairs if 1.8 * len(bits[a] ^ bits[b]) <= 0.2 * (got[a].size + got[b].size) + 1e-6}
    similar = {(a, b) for a, b in pairs if len(hashes[a] & hashes[b]) >= 0.8 * len(hashes[a] | hashes[b])}
    assert similar and similar <= left < set(pairs)


def test_lines_are_trimmed_at_both_ends(spark):
    """Blanks go at either end whatever else stands there; other white space stays, within a line blanks do too."""
    lines_ = ["plain", " a", "a ", "\tb", "b\t", "\x0bc\x0c", "d \r", " \t\r\x0b\x0c e  f \x0c\x0b", " ", "\t\r", "", "\u00a0g\u00a0", "\u4eca ", "h\u2003"]
    docs = spark.createDataFrame([(1, "\n".join(lines_)), (2, None), (None, " i\n")], "doc_id long, text string")
    got = {(r.doc, r.line_no): r.line for r in lines.occurrences(docs).collect()}
    want = {(1, k): t.strip(" \t\r\x0b\x0c") for k, t in enumerate(lines_)} | {((1 << 63) - 1, 0): "i"}
    assert got == {k: t for k, t in want.items() if t}


# --- 3 language

def test_language(spark, data, documents):
    got = {r.doc_id: r for r in queries.op3_language_id(spark, data).collect()}
    assert len(got) == len(documents)
    held = [(lang, got[i].lang_pred) for i, _, lang in documents if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in documents)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd(odd, odd_rows, empty):
    got = langid.identify(odd, F.lit(True), ("doc_id", "score")).drop("score").collect()
    assert len(got) == len(odd_rows) and {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 8)} == {"und"}
    assert langid.identify(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


# --- 4 language model

def test_class_model(spark, data, documents):
    got = {r.doc_id: r for r in queries.op4_class_lm(spark, data).collect()}
    c = Counter()
    for i, t, _ in documents:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update((t or "").encode().lower().split())
            c["END"] += 1
    n, v = sum(c.values()), len(c)
    for i, t, _ in documents:
        w = [*(t or "").encode().lower().split(), "END"]
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in c for x in w), n)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_most_frequent_words(spark):
    rng = random.Random(9)
    counts = {f"w{i}".encode(): min(rng.randint(1, 400), rng.randint(1, 400)) for i in range(300)}
    df = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    for size in (0, 1, 40, 299, 300, 1000):
        got = brown.most_frequent(df, size)
        cut = min((n for _, n in got), default=500)
        # All words from the cut-off on, as many as fit.
        assert got == sorted(((w, n) for w, n in counts.items() if n >= cut), key=lambda x: (-x[1], x[0]))
        below = max((n for n in counts.values() if n < cut), default=0)
        assert len(got) <= size and (not below or sum(n >= below for n in counts.values()) > size)


def test_exchange_step_against_full_likelihood():
    rng = np.random.default_rng(6)
    counts = rng.poisson(2.0, (9, 9))
    h = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    def likelihood(of):
        one = np.eye(5, dtype=int)[of]
        grid = one.T @ counts @ one
        return h(grid).sum() - 2 * h(np.bincount(of, counts.sum(0), 5)).sum()

    of = np.concatenate([np.arange(7) % 3, [3, 4]])
    for w in range(7):
        tries = [likelihood(np.concatenate([of[:w], [c], of[w + 1 :]])) for c in range(3)]
        of[w] = int(np.argmax(tries))
    assert likelihood(brown.exchange(counts, 2, 3, sweeps=1)) == pytest.approx(likelihood(of))


def test_class_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a d"), (3, None)], "doc_id long, text string")
    counts = brown.word_counts(docs)
    model = brown.build(docs, counts, head_size=3, assigned=2, clustered=2, classes=2)
    c = {bytes(r.word): r.n for r in counts.collect()}
    room = model.rare_room
    mass = sum(10 ** model.emit[i] * 10 ** model.move[-1, model.of[i]] for i in range(2))
    mass += 10 ** model.move[-1, -1]
    rare = [w for w in c if model.index.get(w, 9) >= 2]
    mass += 10 ** model.move[-1, -2] * (sum((c[w] + 0.5) / room for w in rare) + 0.5 / room)
    assert mass == pytest.approx(1)


def test_class_model_odd(odd, odd_rows, empty):
    assert brown.class_scores(odd, F.lit(True)).count() == len(odd_rows)
    got = brown.class_scores(odd, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert brown.class_scores(empty, F.lit(True)).count() == 0


# --- 5 personal data

def test_base_spans(documents):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def brute(t):
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if k == "ip" else 0,
                      "card": 16 <= len(d) <= 19 and pii.luhn(d.encode()), "phone": 8 <= len(d) <= 15}[k]
                if ok:
                    yield f"{k}:{m.start()}:{m.end()}"

    odd = ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "x@y", "+1 (2) 345-67890 é a@b.co", "4111-1111 1111 1111", "1.2.3.999", "é" * 300 + "@x.y", "a" * 5000 + "@x.y"]
    tagger = pii.Tagger(pii.CRF().fit(pii.labelled_table(80), steps=20))
    texts = [t or "" for _, t, _ in documents] + odd
    got = pii.scan([t.encode() for t in texts], tagger)
    assert got["base_sha256"] == [sha256(",".join(brute(t)).encode()).hexdigest() for t in texts]


def test_crf():
    tagger = pii.Tagger(pii.CRF().fit(pii.labelled_table()))
    t = 'ab é token = "0123456789abcdef0123456789abcdef" and me@x.org, plain words.'
    out = pii.scan([t.encode(), b""], tagger)
    b = t.index("0123")
    assert out["spans"] == [f"email:{t.index('me@')}:{t.index(', plain')},secret:{b}:{b + 32}", ""]


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    emit, moves = rng.normal(size=(4, 11)), rng.normal(size=(11, 11))
    got = pii.viterbi(emit.copy(), np.array([0, 3]), np.array([3, 1]), moves)
    best = max(np.ndindex(11, 11, 11), key=lambda s: emit[0, s[0]] + emit[1, s[1]] + emit[2, s[2]] + moves[s[0], s[1]] + moves[s[1], s[2]])
    assert tuple(got) == (*best, int(emit[3].argmax()))


def test_pii_odd(odd, odd_rows, empty):
    assert pii.find_pii(odd).count() == len(odd_rows) and pii.find_pii(empty).count() == 0


# --- 6 quality

def test_quality(spark, data, duck):
    got = {r.doc_id: r for r in queries.op6_quality(spark, data).collect()}
    labels = duck.execute("select doc_id, quality from labels").fetchall()
    held = [(q, got[i].predicted) for i, q in labels if i in got and got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_odd(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    assert quality.classify(odd, labels, F.lit(True)).count() == len(odd_rows)
    assert {r.score for r in quality.classify(odd, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.classify(empty, labels, F.lit(True)).count() == 0


def test_context_sums_against_brute_force():
    texts = ["a b c a, the é 12".encode(), b"", b"x", b"b a"]
    index = quality.index_vectors()
    want = np.zeros_like(index)
    for t in texts:
        ids = [zlib.crc32(w) % quality.ROWS for w in quality.PIECE.findall(t)]
        for i, a in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if i != j:
                    want[a] += index[ids[j]]
    assert np.array_equal(quality.context_sums(texts, quality.index_places()), want)


def test_quality_is_calibrated_on_skewed_labels():
    rng = np.random.default_rng(4)
    for share in (0.13, 0.8):
        y = (rng.random(6000) < share).astype(float)
        x = rng.normal(size=(6000, 20))
        x[:, 0] += 0.8 * y
        net = quality.Network().fit(x[:3000], y[:3000])
        p = net.scores(x[3000:])
        loss = -np.mean(np.where(y[3000:] == 1, np.log(p), np.log(1 - p)))
        real = y[3000:].mean()
        constant = -(real * math.log(share) + (1 - real) * math.log(1 - share))
        assert loss < constant and abs(p.mean() - share) < 0.04
        # A sample with as many rows of both labels gives the same shares by its weights.
        few = np.flatnonzero(y[:3000] == (share < 0.5))
        more = np.flatnonzero(y[:3000] != (share < 0.5))
        pick = np.concatenate([few, more[: len(few)]])
        stands = np.where(y[pick] == (share < 0.5), 1.0, len(more) / len(few))
        assert abs(quality.Network().fit(x[pick], y[pick], stands).scores(x[3000:]).mean() - share) < 0.06


# --- 7 licences

def test_licenses(spark, data, duck):
    got = queries.op7_license_scan(spark, data)
    want = duck.execute(queries.BASE_SQL["op7_license_scan"]).to_arrow_table().to_pylist()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert rows_of(got, *names) == sorted(repr(tuple(r[n] for n in names)) for r in want)


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    sequences = [[rng.randint(1, 3) for _ in range(12)] for _ in range(4)]
    automaton = licenses.Automaton(sequences)
    holds = lambda run: sum(1 << i for i, s in enumerate(sequences) if any(s[k : k + len(run)] == run for k in range(len(s))))
    for _ in range(200):
        text = [rng.randint(1, 4) for _ in range(15)]
        longest = [max((n for n in range(1, e + 1) if holds(text[e - n : e])), default=0) for e in range(len(text) + 1)]
        want = [(e, longest[e], holds(text[e - longest[e] : e])) for e in range(1, len(text) + 1) if longest[e] and (e == len(text) or longest[e + 1] <= longest[e])]
        assert automaton.matches(text) == want


def test_license_labels():
    s = licenses.Scanner()
    notice = "Permission is hereby granted, FREE of charge, to any person obtaining a copy of this software and associated documentation files"
    got = s.scan([notice.encode(), b"the software is free", b"", "MIT License é MIT\nlicense".encode()])
    assert got["labels"] == ["mit", "", "", "mit"] and got["n_base"].tolist() == [0, 0, 0, 2]
    assert got["first_word"] == [None, None, None, 0] and got["last_word"] == [None, None, None, 3]


def test_license_chains_cross_foreign_words():
    s = licenses.Scanner()
    grant = licenses.TEMPLATES[0][1].split()
    n = len(grant)
    foreign = ["zq1", "zq2", "zq3", "zq4", "zq5", "zq6", "zq7"]
    texts = [
        grant[:15] + foreign[:1] + grant[15:], grant[:10] + foreign[:6] + grant[10:20] + foreign[:1] + grant[20:], grant[:14] + foreign[:1] + grant[15:],
        grant[:14] + grant[15:], foreign * 9 + grant[:15] + foreign[:1] + grant[15:], grant[:15] + foreign + grant[15:], ("hereby granted free zq " * 12).split(),
    ]
    got = s.scan([" ".join(t).encode() for t in texts])
    assert got["labels"] == ["mit"] * 5 + ["", ""]
    # A chain that can't tell a label counts for nothing.
    assert [round(x * n) for x in got["score"]] == [n, n, n - 1, n - 1, n, 15, 0]
    assert s.scan([b"released under the bridge by night", b"released under the title Blue Moon"])["score"] == [0.0, 0.0]


def test_covered_stretches():
    rng = random.Random(2)
    for _ in range(200):
        held, plain = licenses.Covered(), []
        for _ in range(12):
            begin = rng.randint(0, 40)
            stop = begin + rng.randint(1, 9)
            assert held.meets(begin, stop) == any(b < stop and begin < e for b, e in plain)
            held.add(begin, stop)
            plain.append((begin, stop))


def test_longest_prefix():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    forest = neighbours.Forest(x)
    queries = np.concatenate([x[:5], rng.normal(size=(20, 8))])
    strings = forest.strings(queries / np.sqrt((queries * queries).sum(1))[:, None])
    text = lambda v: format(int(v), f"0{neighbours.BITS}b")
    shared = lambda a, b: next((i for i, (p, q) in enumerate(zip(text(a), text(b))) if p != q), neighbours.BITS)
    want = [max(shared(strings[t, j], v) for t in range(neighbours.TREES) for v in forest.sorted[t]) for j in range(len(queries))]
    assert forest.longest(strings).tolist() == want and want[:5] == [neighbours.BITS] * 5


def test_license_labels_are_told_apart():
    s = licenses.Scanner()
    notice = lambda kind: f"x This work is licensed under a Creative Commons Attribution{kind} 4.0 International License"
    texts = ["The film was released under the title Blue Moon", notice(""), notice("-NonCommercial"), notice("-ShareAlike"), "licensed under CC BY-NC 4.0",
             "and associated documentation " * 8, "Released under the MIT License", licenses.TEMPLATES[8][1].replace("GNU", "GNU Lesser").replace("program", "library")]
    got = s.scan([t.encode() for t in texts])
    assert got["labels"] == ["", "cc-by", "cc-by-nc", "cc-by-sa", "cc-by,cc-by-nc", "", "mit", "lgpl"]
    assert got["spans"][1] == "cc-by:1:14" and got["spans"][0] == "" and got["spans"][4] == "cc-by-nc:0:7"


def slow_spans(s, words):
    """Chains over all maximal common runs of a text and each template, without an automaton."""
    out = {}
    for t, x in enumerate(s.sequences):
        ends = {}
        for i in range(len(words)):
            for k in range(len(x)):
                n = 0
                while i + n < len(words) and k + n < len(x) and words[i + n] == x[k + n]:
                    n += 1
                if n >= licenses.MIN_RUN:
                    ends[i + n] = max(ends.get(i + n, 0), n)
        chain_ = None
        for end, n in sorted(ends.items()):
            if any(e > end and e - m <= end - n for e, m in ends.items()):
                continue
            begin = end - n
            if chain_ is None or begin - chain_[1] > licenses.GAP:
                chain_ = [begin, begin]
                out.setdefault(t, []).append(chain_)
            chain_[1] = end
    return {(t, b, e) for t, v in out.items() for b, e in v}


def test_license_chains_against_brute_force():
    rng = random.Random(8)
    templates = [("x", " ".join(rng.choice("abcdefgh") for _ in range(14))), ("y", " ".join(rng.choice("abcdefgh") for _ in range(9)))]
    for text_seed in range(150):
        s = licenses.Scanner(templates[text_seed % 2 :][:1], [])
        words = [rng.choice("abcdefghz") for _ in range(30)]
        for _ in range(3):
            i, k = rng.randrange(25), rng.randrange(6)
            words[i : i + 5] = templates[text_seed % 2][1].split()[k : k + 5]
        ids = [s.vocabulary.get(w.encode(), 0) for w in words]
        stretches, at = [], 0
        for i, w in enumerate([*ids, 0]):
            if w == 0:
                if i > at:
                    stretches.append((at, ids[at:i]))
                at = i + 1
        assert {x[:3] for x in s.spans(stretches)} == slow_spans(s, [w or -1 for w in ids])


def test_licenses_odd(odd, odd_rows, empty):
    assert licenses.scan_licenses(odd).count() == len(odd_rows) and licenses.scan_licenses(empty).count() == 0


# --- 8 SimHash

def slow_fingerprint(t):
    w = t.encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in names}


def test_simhash(spark, data, documents):
    fps = {i: slow_fingerprint(t or "") for i, t, _ in documents}
    comp = slow_components(set(fps.values()))
    least = defaultdict(lambda: 1 << 62)
    for i, f in fps.items():
        least[comp[f]] = min(least[comp[f]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, data).collect()}
    assert got == {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("limit", [40, 10_000])
def test_gray_links_with_pages(spark, limit):
    rng = random.Random(3)
    flip = lambda f, k: f ^ sum(1 << b for b in rng.sample(range(64), k))
    centre = rng.getrandbits(64)
    fps = {flip(centre, rng.randint(0, 9)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(30)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), limit)
    roots = {r.node % (1 << 64): r.root for r in components.components(edges).collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[roots.get(f, ("alone", f))].add(f)
    want = defaultdict(set)
    for f, r in slow_components(fps).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd(odd, odd_rows, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 11)} == {1} and {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 11)").count() == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_of_groups_that_share_an_id(spark):
    rng = random.Random(8)
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b = w(300), w(300)
    docs = spark.createDataFrame([(7, a), (9, a), (7, b), (12, b), (7, a), (13, w(300))], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).where("doc_id < 13").collect())
    assert got == sorted([(7, a), (7, b)])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


# --- 9 neighbours

def test_neighbours(spark, data, duck):
    got = defaultdict(list)
    for r in queries.op9_nearest(spark, data).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    e = duck.execute("select vec_id, embedding from embeddings").fetchall()
    x = {i: np.array(v, float) for i, v in e}
    hits = total = 0
    for q in (i for i in x if i % 50 == 0):
        exact = sorted((-float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))), i) for i, v in x.items() if i != q)[:5]
        hits += len({i for _, i in exact} & {i for i, _ in got[q]})
        total += 5
        assert all(s == pytest.approx(float(x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i])))) for i, s in got[q])
    assert hits / total >= 0.9


def test_neighbours_recall_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, block=400, query_block=10).collect():
        got[r.query_id].add(r.vec_id)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    assert np.mean([len(got[q] & set(np.argsort(-s[q])[:5].tolist())) / 5 for q in range(0, 1500, 50)]) >= 0.9


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]),
            (8, []), (9, [1.0, 2.0, 3.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (10, [0.0, 1.0])] + [(20 + i, [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (0, 4, 21), (0, 5, 22)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


# --- 10 decontamination

def slow_contamination(docs, items):
    out = {}
    for k, t in docs:
        w = decontaminate.tokens((t or "").encode())
        hit, found = set(), set()
        for item, it in items:
            v = decontaminate.tokens((it or "").encode())
            n = min(13, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        out[k] = (len(w), len(hit), len(found), decontaminate.items_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontaminate(spark, block):
    rng = random.Random(6)
    w = lambda n: " ".join(rng.choice(["alpha", "Beta", "the", "the", "of", "é", "x1"]) for _ in range(n))
    items = [(i, w(rng.choice([1, 2, 3, 5, 13, 14, 30]))) for i in range(12)] + [(3, w(20)), (50, None), (51, "..."), (None, "the of the")]
    texts = [w(rng.randint(0, 60)) + " " + rng.choice([items[3][1], items[5][1], ""]) for _ in range(40)] + [None, "", " , ", w(3000)]
    docs = list(enumerate(texts))
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b, block_bytes=block).collect()
    want = slow_contamination(docs, [x for x in items if x[0] is not None])
    assert len(got) == len(docs) + 1
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


def test_decontaminate_odd(spark, odd, odd_rows, empty):
    b = spark.createDataFrame([(1, "nothing like it")], "item_id long, text string")
    assert decontaminate.decontaminate(odd, b).count() == len(odd_rows)
    assert decontaminate.decontaminate(odd, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, b).count() == 0
