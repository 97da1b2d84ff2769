"""Line signatures and exact similarity by numpy in Arrow batches: all shingles sign a line, however long it is.

A task holds an Arrow batch of lines and, for hashes, at most about twice ``PART`` characters at a time; only verification
holds two lines' hashes whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.line_rules import BANDS, MASKS, ROWS, SHINGLE
from folioscan.shipping import ship

#: Characters whose hashes are made at a time.
PART = 1 << 15
_ALL = (1 << 64) - 1


def _stirred(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others; ``x`` is overwritten."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(text: str) -> np.ndarray:
    """The 64-bit hash of every run of ``SHINGLE`` (eight) characters of ``text``, which has at least so many, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - SHINGLE + 1
    # A code point has 21 bits: a number holds three of them, stirred in whole. Eight are three, three and two.
    two = c[:-1] << np.uint64(21)
    two |= c[1:]
    three = two[:-1] << np.uint64(21)
    three |= c[2:]
    three = _stirred(three)
    h = three[:n] * np.uint64(0x9FB21C651E98DF25)
    h += three[3 : n + 3]
    h ^= two[6 : n + 6] * np.uint64(0xC3A5C85C97CB3127)
    return _stirred(h)


def _parts(line: bytes) -> Iterator[str]:
    """A line's parts, which overlap so that each shingle is in one; line feeds, which no line holds, fill up a short line."""
    text = line.decode("utf-8", "surrogateescape").ljust(SHINGLE, "\n")
    for at in range(0, len(text) - SHINGLE + 1, PART):
        yield text[at : at + PART + SHINGLE - 1]


def hashed(lines: Sequence[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(owners, hashes, starts) of parts of lines, in order: the line of each part, all shingles' hashes, and where each part's begin."""

    def fold(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(part) for part in parts])
        h, inside, ends = window_hashes("".join(parts)), np.ones(sizes.sum() - SHINGLE + 1, bool), np.cumsum(sizes)[:-1]
        for k in range(1, SHINGLE):  # runs that reach over a part's end
            inside[ends - k] = False
        counts = sizes - SHINGLE + 1
        return h[inside], np.cumsum(counts) - counts

    parts, owners, held = [], [], 0
    for i, line in enumerate(lines):
        for part in _parts(line):
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= PART:
                yield owners, *fold(parts)
                parts, owners, held = [], [], 0
    if parts:
        yield owners, *fold(parts)


def minima(lines: Sequence[bytes], masks: Sequence[int]) -> np.ndarray:
    """For each line a row of the minima of its shingles' hashes, their upper 32 bits XORed with each of the masks'."""
    out = np.full((len(lines), len(masks)), _ALL >> 32, np.uint32)
    for owners, h, starts in hashed(lines):
        h = (h >> np.uint64(32)).astype(np.uint32)
        for j, mask in enumerate(masks):
            np.minimum.at(out[:, j], owners, np.minimum.reduceat(h ^ np.uint32(mask >> 32), starts))
    return out


def line_hashes(lines: Sequence[bytes]) -> Iterator[np.ndarray]:
    """For each line the distinct hashes of its shingles, sorted."""

    def distinct(parts: list[np.ndarray]) -> np.ndarray:
        x = np.sort(np.concatenate(parts))
        return x[np.concatenate(([True], x[1:] != x[:-1]))]

    held, of = [], 0
    for owners, h, starts in hashed(lines):
        for owner, part in zip(owners, np.split(h, starts[1:])):
            if owner != of:
                yield distinct(held)
                held, of = [], owner
            held.append(part)
    if held:
        yield distinct(held)


def band_keys(m: np.ndarray, picks: Sequence[Sequence[int]]) -> np.ndarray:
    """For each row of minima the hash of each band's number and minima."""
    keys = np.empty((len(m), len(picks)), np.uint64)
    for b, pick in enumerate(picks):
        h = np.full(len(m), b + 1, np.uint64)
        for column in pick:
            h = _stirred((h << np.uint64(32)) + (h >> np.uint64(32)) + m[:, column])
        keys[:, b] = h
    return keys


def band_rows(lines: DataFrame) -> DataFrame:
    """(lid, key, o), a row for each line and band: the band's hash, and what orders its group.

    The next band's first minimum orders a group: 24 bits of it suffice and compress well.
    """
    ship(lines.sparkSession)
    picks = [range(b * ROWS, (b + 1) * ROWS) for b in range(BANDS)]

    def run(batches):
        for batch in batches:
            m = minima(batch.column("line").to_pylist(), MASKS)
            lid = batch.column("lid").to_numpy()
            for b, key in enumerate(band_keys(m, picks).view(np.int64).T):
                order = (m[:, (b + 1) % BANDS * ROWS] >> np.uint32(8)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lid, np.ascontiguousarray(key), order)], ["lid", "key", "o"])

    return lines.select("lid", F.col("line").cast("binary").alias("line")).mapInArrow(run, "lid long, key long, o int")


def similar(both: DataFrame, least: float) -> DataFrame:
    """(a, b) of those rows (a, b, ta, tb) whose lines' shingle sets have a Jaccard similarity of ``least`` or more."""
    ship(both.sparkSession)

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < least * max(len(x), len(y)):
            return False
        both = np.sort(np.concatenate((x, y)))
        common = np.count_nonzero(both[1:] == both[:-1])
        return common >= least * (len(both) - common)

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())
            sets = line_hashes([line for pair in pairs for line in pair])
            yes = [alike(x, next(sets)) for x in sets]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return both.select("a", "b", *[F.col(t).cast("binary").alias(t) for t in ("ta", "tb")]).mapInArrow(run, "a long, b long")
