"""Quality classifier: random-indexing word vectors, pooled per document, and a calibrated network.

Pieces of text (runs of letters, digits or marks) have no vocabulary: the hash of a piece names one of ``ROWS`` rows,
and every row has a sparse ternary index vector that its number seeds. A row's context vector is the sum of the index vectors
of its pieces' neighbours over all documents: whole numbers, so it is exact whatever the partitioning. Rare words thus
count as they stand; words that share a row share its vector. A document is the mean and spread of its pieces'
context vectors, the mean of their index vectors, and the shares of kinds of bytes. A two-layer numpy network maps it to a logit,
whose temperature and bias are fitted on a third of the sample that training leaves out.

Labels are fitted on a bounded sample of about ``PER_CLASS`` rows of each label (documented bound), drawn by a hash of
the id. In training both labels weigh the same; in calibration each row weighs as many labelled rows as it stands for, so that
scores are probabilities of the labels' own shares. Counts, vectors and scores read all texts.

Cases: null and empty texts are pooled as zero and scored like any text; null labels and labels
without a document teach nothing; several labels of one id count once, by majority, ties to 1; with
no labels, or one class only, every score is that class's share (0.5 without any).
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import fold_texts, map_texts

PIECE = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
ROWS = 1 << 13
DIM = 64
NONZERO = 8
REACH = 2
PER_CLASS = 2500
HIDDEN = 24
#: Kinds of bytes: white space, lower and upper case, digits, marks, others.
_KIND = np.array([0 if c in b" \t\n\r\x0b\x0c" else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c < 128 else 5 for c in range(256)])
WIDTH = 3 * DIM + 7


def piece_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pieces of all texts, and the number of each text's pieces."""
    lists = [[crc32(w) for w in PIECE.findall(t)] for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())) % ROWS, lengths


def index_places() -> np.ndarray:
    """Dimensions of each row's index vector: half of them positive, then half negative."""
    return np.stack([np.random.default_rng(i).choice(DIM, NONZERO, replace=False) for i in range(ROWS)])


def index_vectors() -> np.ndarray:
    """The index vectors, one a row."""
    out = np.zeros((ROWS, DIM), np.float32)
    places = index_places()
    np.put_along_axis(out, places[:, : NONZERO // 2], 1, 1)
    np.put_along_axis(out, places[:, NONZERO // 2 :], -1, 1)
    return out


def context_sums(texts: list[bytes], places: np.ndarray) -> np.ndarray:
    """For each row the sum of its pieces' neighbours' index vectors."""
    ids, lengths = piece_rows(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    # The hash of a row and its neighbour is not stored: pairs become cells of (row, dimension) at once.
    out = np.zeros(ROWS * DIM)
    half = NONZERO // 2
    for gap in range(1, REACH + 1):
        same = owner[gap:] == owner[:-gap]
        x, y = ids[:-gap][same], ids[gap:][same]
        for a, b in ((x, y), (y, x)):
            cells = a[:, None] * DIM + places[b]
            out += np.bincount(cells[:, :half].ravel(), minlength=len(out))
            out -= np.bincount(cells[:, half:].ravel(), minlength=len(out))
    return out.reshape(ROWS, DIM)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all rows."""

    def setup():
        places = index_places()
        sums = np.zeros((ROWS, DIM))

        def take(texts, _):
            sums[:] += context_sums(texts, places)

        def drain():
            used = np.flatnonzero(sums.any(1))
            return {"row": used, "v": sums[used].astype(np.int64).tolist()}

        return take, drain

    parts = fold_texts(docs, [], setup, "row long, v array<long>")
    got = parts.groupBy("row").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(DIM)]).alias("v")).toArrow()
    out = np.zeros((ROWS, DIM))
    if got.num_rows:
        out[got.column("row").to_numpy()] = got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def pooled(texts: list[bytes], context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mean and spread of the context vectors of each text's pieces, mean of the index vectors, shares of kinds of bytes."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for at in range(0, len(texts), 64):
        ids, lengths = piece_rows(texts[at : at + 64])
        end = np.cumsum(lengths)
        for i, (b, e) in enumerate(zip(end - lengths, end), at):
            if e > b:
                # As weighted sums over distinct rows: memory follows the rows, not the text.
                used, times = np.unique(ids[b:e], return_counts=True)
                w, c = (times / (e - b)).astype(np.float32), context[used]
                mean = w @ c
                kinds = np.bincount(_KIND[np.frombuffer(texts[i], np.uint8)], minlength=6)
                out[i] = np.concatenate((mean, np.sqrt(np.maximum(w @ c**2 - mean**2, 0)), w @ index[used], kinds / kinds.sum(), [np.log1p(e - b)]))
    return out


class Network:
    """Two layers with tanh, standardised inputs, a temperature and a bias."""

    def __init__(self, share: float = 0.5):
        self.share, self.fitted = share, False

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-2) -> Network:
        """``weight``: how many labelled rows each row stands for."""
        rng = np.random.default_rng(3)
        weight = np.ones(len(y)) if weight is None else weight
        order = rng.permutation(len(x))
        cut = len(x) - len(x) // 3
        train, held = order[:cut], order[cut:]
        # Labels weigh the same in training: the rarer one's training rows are repeated, after the split.
        few = train[y[train] == (y[train].mean() < 0.5)]
        if len(few):
            train = np.concatenate([train, np.tile(few, max(1, round((len(train) - len(few)) / len(few))) - 1)])
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-4
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        step = 0
        for _ in range(epochs):
            shuffled = rng.permutation(train)
            for at in range(0, len(shuffled), 64):
                pick = shuffled[at : at + 64]
                h = np.tanh(z[pick] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[pick]) / len(pick)
                back = d[:, None] * p[2] * (1 - h * h)
                step += 1
                for k, g in enumerate([z[pick].T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True)]):
                    g = g + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.fitted = p, True
        self.temperature, self.bias = calibrate(self.logits(x[held]), y[held], weight[held])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.bias, -60, 60)))


def calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Temperature (0.25 to 64) and bias of least weighted log loss; each label keeps half a row's doubt."""
    if not len(y):
        return 1.0, 0.0
    # Targets short of 0 and 1 keep the bias finite where a few rows part perfectly.
    many = np.array([max(1, np.sum(y == k)) for k in (0, 1)])
    target = np.where(y == 1, (many[1] + 0.5) / (many[1] + 1), 0.5 / (many[0] + 1))
    w = weight / weight.sum()
    best = (np.inf, 1.0, 0.0)
    for t in np.exp(np.linspace(np.log(0.25), np.log(64), 80)):
        z, bias = logit / t, 0.0
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(z + bias, -60, 60)))
            bias -= float(np.clip((w * (q - target)).sum() / max(1e-9, (w * q * (1 - q)).sum()), -2, 2))
        loss = float((w * (np.logaddexp(0, z + bias) - target * (z + bias))).sum())
        best = min(best, (loss, float(t), bias))
    return best[1], best[2]


def labelled_sample(labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, y, stands) of about ``per_class`` rows of each label; stands: how many labelled rows one stands for."""
    known = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().toLocalIterator()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    share = lambda k: min(1, per_class / counts.get(k, 1))
    of = lambda x: F.when(F.col("y") == 1, F.lit(x(1))).otherwise(F.lit(x(0)))
    return known.where(draw < of(lambda k: int(share(k) * (1 << 30)))).withColumn("stands", of(lambda k: 1 / share(k)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, context: np.ndarray, index: np.ndarray, per_class: int = PER_CLASS) -> Network:
    """Fits the network on the pooled vectors of the sample; of several texts of one id that with the smallest hash teaches."""
    # The sample has 2 * per_class rows or so, whatever the tables' size: it may be broadcast.
    sample = labelled_sample(labels, learn, per_class)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = found.groupBy("doc_id", "y", "stands").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def setup():
        return lambda texts, _: {"x": pooled(texts, context, index).astype(np.float64).tolist()}

    rows = map_texts(texts, ["doc_id", "y", "stands"], setup, "x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return Network(float(y.mean()) if len(y) else 0.5)
    return Network().fit(np.array([r["x"] for r in rows]), y, np.array([r["stands"] for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every document with score and predicted."""
    context, index = context_vectors(docs), index_vectors()
    network = train(docs, labels, learn, context, index)

    def setup():
        def compute(texts, _):
            score = network.scores(pooled(texts, context, index))
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return compute

    return map_texts(docs, list(keep), setup, "score double, predicted int")
