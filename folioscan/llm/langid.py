"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths run over windows of ``WINDOW`` bytes, each filter is
max-pooled over its window and a softmax gives the window's languages. A text is cut into windows
that cover it wholly; its log probabilities are the mean over windows weighted by their bytes.

The network is fitted on a bounded sample: about ``PER_CLASS`` texts of each language (documented
bound), chosen by a hash of the id among rows that the caller lets it learn from, one window at a
hashed place of each. Everything else reads all texts.

Cases: a null text or one without any letter is ``und`` with score 0; null labels are never
learned from; repeated rows are predicted one by one; no labelled rows at all make every text
``und``; more than ``MAX_CLASSES`` labels are an error, as the label set is a parameter of the model.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import map_texts

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_CLASS = 700
MAX_CLASSES = 1000
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    """Whether a UTF-8 text has any letter."""
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def to_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (zero-padded), the text of each, and its bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // WINDOW))
    padded = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts))
    windows = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return windows, owner, np.clip(sizes[owner] - index * WINDOW, 1, WINDOW)


class ByteCNN:
    """Parameters and passes of the network."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"E": normal(256, EMBED)}
        for w in WIDTHS:
            self.p[f"W{w}"] = normal(w, EMBED, FILTERS)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["V"] = normal(FILTERS * len(WIDTHS), classes)
        self.p["c"] = np.zeros(classes, np.float32)

    def _conv(self, x: np.ndarray, w: int) -> np.ndarray:
        n = x.shape[1] - w + 1
        out = x[:, :n] @ self.p[f"W{w}"][0]
        for k in range(1, w):
            out += x[:, k : k + n] @ self.p[f"W{w}"][k]
        return out

    def forward(self, windows: np.ndarray, remember: bool = False):
        """Log probabilities; with ``remember`` also what the backward pass needs."""
        x = self.p["E"][windows]
        pools, places = [], []
        for w in WIDTHS:
            conv = self._conv(x, w)
            if remember:
                at = conv.argmax(1)
                places.append(at)
                pools.append(np.take_along_axis(conv, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
            else:
                pools.append(conv.max(1) + self.p[f"b{w}"])
        pooled = np.concatenate(pools, 1)
        hidden = np.maximum(pooled, 0)
        logits = hidden @ self.p["V"] + self.p["c"]
        logits -= logits.max(1, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return (logp, x, pooled, hidden, places) if remember else logp

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        logp, x, pooled, hidden, places = self.forward(windows, True)
        n = len(windows)
        d = np.exp(logp)
        d[np.arange(n), labels] -= 1
        d /= n
        g = {"V": hidden.T @ d, "c": d.sum(0), "E": np.zeros_like(self.p["E"])}
        back = (d @ self.p["V"].T) * (pooled > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = part.sum(0)
            g[f"W{w}"] = np.zeros_like(self.p[f"W{w}"])
            for k in range(w):
                at = places[i] + k
                g[f"W{w}"][k] = np.einsum("nfe,nf->ef", x[rows, at], part)
                np.add.at(g["E"], windows[rows, at].ravel(), (part[:, :, None] * self.p[f"W{w}"][k].T).reshape(-1, EMBED))
        return g

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 5e-3):
        """Adam over shuffled batches; the same input gives the same network."""
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                step += 1
                for k, g in self.gradients(windows[pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def labelled_sample(docs: DataFrame, learn: Column, per_class: int = PER_CLASS) -> tuple[list[str], list[tuple[str, bytes]]]:
    """The languages, and about ``per_class`` labelled windows of each."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_CLASSES + 1).toLocalIterator()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages are labelled")
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1, per_class / n) * (1 << 30))))])
    # A window at a hashed place of the text; 256 characters hold 256 bytes or more.
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), room.cast("long")).cast("int") + 1
    picked = known.where(draw < share[F.col("lang")]).select(
        "lang", F.substring("text", place, F.lit(WINDOW)).alias("part"), F.xxhash64("doc_id", "text").alias("h")
    )
    rows = sorted((r["h"], r["lang"], r["part"]) for r in picked.toLocalIterator())
    return sorted(counts), [(lang, part.encode()) for _, lang, part in rows if has_letter(part.encode())]


def train(docs: DataFrame, learn: Column, per_class: int = PER_CLASS) -> tuple[list[str], ByteCNN | None]:
    """Fits the network on the bounded sample."""
    languages, rows = labelled_sample(docs, learn, per_class)
    if not rows:
        return languages, None
    index = {k: i for i, k in enumerate(languages)}
    # Short texts are as likely as long ones, so half of the windows are cut at a varying length.
    parts = [p[:WINDOW] if i % 2 else p[: 16 + (i * 37) % (WINDOW - 16)] for i, (_, p) in enumerate(rows)]
    windows = np.stack([np.frombuffer(p.ljust(WINDOW, b"\0"), np.uint8) for p in parts])
    labels = np.array([index[k] for k, _ in rows])
    return languages, ByteCNN(len(languages)).fit(windows, labels)


def predict(texts: list[bytes], languages: list[str], model: ByteCNN | None) -> tuple[list[str], list[float]]:
    """Language and its probability for each whole text."""
    letters = [has_letter(t) for t in texts]
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    windows, owner, size = to_windows(texts)
    logp = np.concatenate([model.forward(windows[at : at + 128]) for at in range(0, len(windows), 128)])
    total = np.zeros((len(texts), len(languages)))
    np.add.at(total, owner, logp * size[:, None])
    weight = np.bincount(owner, size, len(texts))
    mean = total / weight[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return (
        [languages[b] if ok else "und" for b, ok in zip(best, letters)],
        [float(p[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters))],
    )


def identify(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), per_class: int = PER_CLASS) -> DataFrame:
    """``keep`` columns of every document with lang_pred and score."""
    languages, model = train(docs, learn, per_class)

    def setup():
        def compute(texts, _):
            lang, score = predict(texts, languages, model)
            return {"lang_pred": lang, "score": score}

        return compute

    return map_texts(docs, list(keep), setup, "lang_pred string, score double")
