"""Brown class-based bigrams: P(word | previous) = P(class | previous class) P(word | class).

Statistics cover all training documents and are gathered in four passes:

1. Counts of all words (combined in tasks, then by a shuffle on the word).
2. Bigrams of the ``CLUSTERED`` most frequent words, from which the exchange algorithm builds
   ``CLASSES`` classes: words move to the class that raises the class bigram likelihood most.
3. Neighbouring classes of the ``ASSIGNED`` most frequent words, each of which one exchange step
   assigns to its best class.
4. Class transitions, with every other word in one class for rare words and the end of a text in
   its own class.

Texts are scored with the ``HEAD`` most frequent words at hand (a bounded table); words beyond it
get their counts by a join on the word, which Spark may split where a word that only held-out texts have is frequent. Transitions
are interpolated with class frequencies; words of the rare class have add-half emissions with one
place for the unseen, so the probabilities of all words after any word sum to 1.

Cases: null and empty texts are their end token; repeated rows are scored one by one; without
training documents all words are unseen and the model equals the base; no documents, no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import fold_texts, map_texts, materialize

HEAD = 32768
ASSIGNED = 16384
CLUSTERED = 2048
CLASSES = 64
SWEEPS = 4
FLUSH = 200_000
SMOOTH = 20.0


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z, splits at ASCII white space."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all words of ``docs``, ends left out."""

    def setup():
        seen: Counter = Counter()

        def drain():
            rows = {"word": list(seen), "n": list(seen.values())}
            seen.clear()
            return rows

        def take(texts, _):
            for t in texts:
                seen.update(words(t))
            return drain() if len(seen) > FLUSH else None

        return take, drain

    return fold_texts(docs, [], setup, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _taken(groups: list[tuple[int, int]], room: int) -> tuple[list[int], int]:
    """Keys of the first (key, size) that together fit into ``room``, and the room left."""
    keys = []
    for key, size in groups:
        if size > room:
            break
        keys.append(key)
        room -= size
    return keys, room


def most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``size``: all whose count reaches a cut-off, with their counts.

    The cut-off comes from how many words have each count, so no task sorts the words. Ties at the
    cut-off that would pass ``size`` are left out together.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = lambda df, by: sorted(((r[0], r[1]) for r in df.groupBy(by).count().toLocalIterator()), reverse=True)
    levels = sizes(counts, level)
    whole, room = _taken(levels, size)
    least = level >= whole[-1] if whole else F.lit(False)
    if len(whole) < len(levels):
        # Within the first level that doesn't fit, single counts do.
        some, _ = _taken(sizes(counts.where(level == levels[len(whole)][0]), "n"), room)
        least = least | (F.col("n") >= some[-1]) if some else least
    rows = counts.where(least).toArrow().to_pylist()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def id_stream(texts: list[bytes], ids: dict[bytes, int], other: int, end: int) -> np.ndarray:
    """Ids of all words, ``end`` before the first text and after each."""
    get = ids.get
    return np.fromiter(chain([end], chain.from_iterable((*(get(w, other) for w in words(t)), end) for t in texts)), np.int64)


def _cells(docs: DataFrame, setup) -> tuple[np.ndarray, np.ndarray]:
    """Sums of cells that tasks emit as (key, n); the key space is bounded by the caller."""
    got = fold_texts(docs, [], setup, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return got.column("key").to_numpy(), got.column("n").to_numpy()


def bigrams(docs: DataFrame, ids: dict[bytes, int], size: int) -> np.ndarray:
    """Counts of neighbouring ids; ids beyond ``ids`` are size-2, ends size-1."""

    def setup():
        counts = np.zeros(size * size, np.int64)

        def take(texts, _):
            s = id_stream(texts, ids, size - 2, size - 1)
            counts[:] += np.bincount(s[:-1] * size + s[1:], minlength=size * size)

        def drain():
            at = np.flatnonzero(counts)
            return {"key": at, "n": counts[at]}

        return take, drain

    key, n = _cells(docs, setup)
    out = np.zeros(size * size, np.int64)
    out[key] = n
    return out.reshape(size, size)


def exchange(counts: np.ndarray, fixed: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each id: the last ``fixed`` ids keep classes of their own after the others' ``classes``.

    Maximises sum n(c,d) log n(c,d) - 2 sum n(c) log n(c), moving one word at a time.
    """
    n = counts.shape[0]
    free = n - fixed
    of = np.concatenate([np.arange(free) % classes, classes + np.arange(fixed)])
    total = classes + fixed
    one_hot = np.zeros((n, total), np.int64)
    one_hot[np.arange(n), of] = 1
    grid = one_hot.T @ counts @ one_hot
    size = np.bincount(of, counts.sum(0), total)
    h = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    eye = np.arange(total)
    for _ in range(sweeps):
        moved = 0
        for w in range(free):
            weight = counts[:, w].sum()
            if weight == 0:
                continue
            right = np.bincount(of, counts[w], total)
            left = np.bincount(of, counts[:, w], total)
            self_ = counts[w, w]
            a = of[w]
            right[a] -= self_
            left[a] -= self_
            # Take the word out of its class, then weigh every class.
            grid[a] -= right.astype(np.int64)
            grid[:, a] -= left.astype(np.int64)
            grid[a, a] -= self_
            size[a] -= weight
            # Gain of each class d: rows and columns of d change; the cell (d, d) changes by both and the word's own pairs.
            base = h(grid)
            rows = (h(grid + right[None, :]) - base).sum(1)
            cols = (h(grid + left[:, None]) - base).sum(0)
            corner = grid[eye, eye]
            fix = h(corner + right + left + self_) - h(corner) - (h(corner + right) - h(corner)) - (h(corner + left) - h(corner))
            gain = rows + cols + fix - 2 * (h(size + weight) - h(size))
            d = int(np.argmax(gain[:classes]))
            grid[d] += right.astype(np.int64)
            grid[:, d] += left.astype(np.int64)
            grid[d, d] += self_
            size[d] += weight
            of[w] = d
            moved += d != a
        if not moved:
            break
    return of


def assign(docs: DataFrame, ids: dict[bytes, int], class_of: np.ndarray, transitions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes of all words in ``ids``: those beyond ``class_of`` go to the class that suits their neighbours best."""
    known, total = len(class_of), transitions.shape[0]
    n = len(ids)
    if n <= known:
        return class_of
    table = np.concatenate([class_of, np.full(n - known, total - 2), [total - 2, total - 1]])

    def setup():
        left = np.zeros(n * total, np.int64)
        right = np.zeros(n * total, np.int64)

        def take(texts, _):
            s = id_stream(texts, ids, n, n + 1)
            c = table[s]
            inner = s < n
            left[:] += np.bincount(s[1:][inner[1:]] * total + c[:-1][inner[1:]], minlength=n * total)
            right[:] += np.bincount(s[:-1][inner[:-1]] * total + c[1:][inner[:-1]], minlength=n * total)

        def drain():
            both = np.concatenate([left, right])
            at = np.flatnonzero(both)
            return {"key": at, "n": both[at]}

        return take, drain

    key, many = _cells(docs, setup)
    both = np.zeros(2 * n * total)
    both[key] = many
    left, right = both.reshape(2, n, total)
    p = (transitions + 0.5) / (transitions + 0.5).sum(1, keepdims=True)
    classes = total - 2
    size = np.bincount(class_of, counts[:known], classes) + 1.0
    gain = left @ np.log(p)[:, :classes] + right @ np.log(p).T[:, :classes] - counts[:, None] * np.log(size)
    best = gain.argmax(1)
    best[:known] = class_of
    return best


class Model:
    """All that scoring a text needs but the counts of rare words."""

    def __init__(self, head: list[tuple[bytes, int]], classes: np.ndarray, transitions: np.ndarray, n_docs: int, n_words: int, distinct: int):
        self.index = {w: i for i, (w, _) in enumerate(head)}
        count = np.array([c for _, c in head] + [0, n_docs], float)
        rare, end = transitions.shape[0] - 2, transitions.shape[0] - 1
        of = np.concatenate([classes, np.full(len(head) - len(classes), rare), [rare, end]]).astype(np.int64)
        self.of, self.size = of, len(head)
        self.tokens, self.distinct = n_words + n_docs, distinct + (n_docs > 0)
        self.base_log = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))
        in_class = np.bincount(of, count, len(transitions))
        self.rare_words = n_words - count[: len(classes)].sum()
        self.rare_distinct = distinct - len(classes)
        emit = np.full(len(of), 0.0)
        closed = of < rare
        emit[closed] = np.log10(count[closed] / np.maximum(in_class[of[closed]], 1))
        is_rare = of == rare
        emit[is_rare] = np.log10((count[is_rare] + 0.5) / self.rare_room)
        self.emit = emit
        # Rare words' own counts come later; the table holds the transition part only.
        seen = transitions.sum(1, keepdims=True)
        overall = np.concatenate([in_class[:rare], [self.rare_words], [n_docs]]) + 0.5
        # A class that no word has can't be emitted from.
        overall[:rare][in_class[:rare] == 0] = 0
        overall /= overall.sum()
        self.move = np.log10(np.maximum((transitions + SMOOTH * overall) / (seen + SMOOTH), 1e-300))

    @property
    def rare_room(self) -> float:
        return self.rare_words + 0.5 * (self.rare_distinct + 1)

    def score(self, texts: list[bytes]) -> dict[str, list]:
        """Per text: tokens, known ones, base and model scores of the head, and the words beyond it."""
        get, other, end = self.index.get, self.size, self.size + 1
        lists = [words(t) for t in texts]
        ids = [[get(w, other) for w in x] for x in lists]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
        flat = np.fromiter(chain.from_iterable((*x, end) for x in ids), np.int64, int(lengths.sum()))
        before = np.concatenate(([end], flat[:-1]))
        at = np.cumsum(lengths) - lengths
        tail = flat == other
        base = np.where(tail, 0.0, self.base_log[flat])
        own = self.move[self.of[before], self.of[flat]] + np.where(tail, 0.0, self.emit[flat])
        add = lambda x: np.add.reduceat(x, at)
        known = add((~tail & ((flat != end) | (self.base_log[end] > np.log10(0.6 / (self.tokens + 0.5 * (self.distinct + 1)))))).astype(np.int64))
        rest = [[w for w, i in zip(x, y) if i == other] if other in y else [] for x, y in zip(lists, ids)]
        return {"n_tokens": lengths, "n_known": known, "base": add(base), "own": add(own), "rest": rest}


def build(docs: DataFrame, counts: DataFrame, head_size: int = HEAD, assigned: int = ASSIGNED, clustered: int = CLUSTERED, classes: int = CLASSES) -> Model:
    """The model of the training documents, whose word counts are given as a stored table."""
    n_docs = docs.count()
    distinct, n_words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    head = most_frequent(counts, head_size)
    clustered, assigned = min(clustered, len(head)), min(assigned, len(head))
    classes = max(1, min(classes, clustered))
    frequent = {w: i for i, (w, _) in enumerate(head[:clustered])}
    pairs = bigrams(docs, frequent, clustered + 2) if head else np.zeros((2, 2), np.int64)
    of = exchange(pairs, 2, classes)
    one_hot = np.zeros((len(of), classes + 2), np.int64)
    one_hot[np.arange(len(of)), of] = 1
    coarse = one_hot.T @ pairs @ one_hot
    ids = {w: i for i, (w, _) in enumerate(head[:assigned])}
    count = np.array([c for _, c in head[:assigned]], float)
    every = assign(docs, ids, of[:clustered], coarse, count) if head else np.zeros(0, np.int64)
    by_class = {w: int(every[i]) for w, i in ids.items()}
    final = bigrams(docs, by_class, classes + 2)
    # The end of a text precedes nothing but the next text's start, counted once per batch too often or too few.
    final[classes + 1, classes + 1] = max(0, n_docs - final[classes + 1, : classes + 1].sum())
    return Model(head, every, final, n_docs, n_words, distinct)


def class_scores(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), **sizes) -> DataFrame:
    """``keep`` columns (one of a computed name gives way) of every document with n_tokens, n_known, train_tokens, base_score, score."""
    training = docs.where(learn).select("text")
    counts = materialize(word_counts(training))
    model = build(training, counts, **sizes)
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in keep if c not in new]
    carried = docs.select(F.struct(*kept).alias("__kept"), "text")
    scored = map_texts(
        carried, ["__kept"], lambda: lambda texts, _: model.score(texts),
        "n_tokens long, n_known long, base double, own double, rest array<binary>",
    )
    scored = materialize(scored.withColumn("__row", F.monotonically_increasing_id()))
    tail = scored.where(F.size("rest") > 0).select("__row", F.explode("rest").alias("word"))
    room = F.lit(float(model.tokens + 0.5 * (model.distinct + 1)))
    n = F.coalesce("n", F.lit(0))
    sums = tail.join(counts, "word", "left").groupBy("__row").agg(
        F.sum((n > 0).cast("long")).alias("known"),
        F.sum(F.log10((n + 0.5) / room)).alias("b"),
        F.sum(F.log10((n + 0.5) / F.lit(float(model.rare_room)))).alias("o"),
    )
    return scored.drop("rest").join(sums, "__row", "left").select(
        "__kept.*", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("own") + F.coalesce("o", F.lit(0.0))).alias("score"),
    )
