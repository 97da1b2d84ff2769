"""Byte-level BPE: a rank file served by a sentencepiece model, and its inverse.

A rank file lists tokens (byte strings) with their merge ranks. From it a sentencepiece BPE model is
serialised directly: every byte stands as the character 256 places above it, a token is the piece of its
bytes' characters, its id is its rank and its score the negative rank, and normalisation is the identity. So
sentencepiece merges the pair of the lowest rank first, the leftmost of equals, as rank files are meant.
Each match of a pattern (a pre-token) is encoded separately; a pre-token that is a token itself is that token.
Decoding maps ids back to their pieces and characters back to bytes.

Texts go through Arrow batches in the task that reads them, so nothing is shuffled and a lost executor costs
its tasks only. A task holds the vocabulary, one batch, about ``CHUNK`` pre-tokens and a memo of at most
``MEMO`` characters of pre-tokens; what falls out of the memo is encoded again.

Cases: a null text is an empty one and has no ids; bytes that are not UTF-8 are read as U+FFFD; repeated
rows are rows of their own; kept columns named ``ids`` or ``decoded`` give way to the computed ones; an
empty table gives an empty one. Null ids decode to no bytes; a row with an id outside the vocabulary, or a null
one, decodes to null.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from itertools import batched, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from folioscan.llm.common import map_texts
from folioscan.shipping import ship

MEMO = 1 << 21
CHUNK = 1 << 16
SHIFT = 256
_UP = {b: b + SHIFT for b in range(256)}
_DOWN = {b + SHIFT: b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which must run from 0 without a gap."""
    rows = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    ranks = {int(rank): base64.b64decode(token) for token, rank in rows}
    tokens = [ranks[i] for i in range(len(ranks)) if i in ranks]
    if not len(tokens) == len(rows) == len(set(tokens)):
        raise ValueError("ranks must run from 0 without a gap, tokens must not repeat")
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"{len(missing)} bytes have no token")
    return tokens


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_UP)


def to_bytes(piece: str) -> bytes:
    return piece.translate(_DOWN).encode("latin-1")


def serialise(tokens: Sequence[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the tokens' places; the unknown piece it must have comes last."""
    kinds = pb.ModelProto.SentencePiece
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=to_piece(token), score=-float(rank), type=kinds.NORMAL)
    model.pieces.add(piece="unknown", score=0.0, type=kinds.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """A serialised model at work in a task.

    The memo gives each pre-token a number, and for each number the place and count of its ids in one flat array,
    so the ids of many pre-tokens are gathered at once.
    """

    def __init__(self, model: bytes, pattern: str):
        self.processor = SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size() - 1)]
        self.ids = {piece: i for i, piece in enumerate(pieces)}
        self.bytes = [to_bytes(p) for p in pieces]
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.held = self.used = 0
        self.start, self.count, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    def learn(self, fresh: list[str]) -> None:
        """Adds pre-tokens to the memo; arrays grow by doubling."""
        pieces = [to_piece(t.encode()) for t in fresh]
        rest = [i for i, p in enumerate(pieces) if p not in self.ids]
        found = [[self.ids.get(p, -1)] for p in pieces]
        for i, ids in zip(rest, self.processor.encode([pieces[i] for i in rest], out_type=int, num_threads=1)):
            found[i] = ids
        n, counts = len(self.memo), np.fromiter(map(len, found), np.int64, len(found))
        ends = self.used + np.cumsum(counts)
        room = lambda a, size: a if size <= len(a) else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)])
        self.start, self.count, self.flat = room(self.start, n + len(fresh)), room(self.count, n + len(fresh)), room(self.flat, int(ends[-1]))
        self.start[n : n + len(fresh)], self.count[n : n + len(fresh)] = ends - counts, counts
        self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32)
        self.memo.update(zip(fresh, range(n, n + len(fresh))))
        self.used, self.held = int(ends[-1]), self.held + sum(map(len, fresh))

    def _gathered(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has."""
        distinct = set(tokens)
        if fresh := [t for t in distinct if t not in self.memo]:
            if self.held > MEMO:
                self.forget()
                fresh = list(distinct)
            self.learn(fresh)
        numbers = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        count = self.count[numbers]
        before = np.cumsum(count) - count
        at = np.repeat(self.start[numbers] - before, count) + np.arange(int(count.sum()))
        return self.flat[at], count

    def _portions(self, texts: list[str]):
        """(pre-tokens, how many of them each text has) of ``CHUNK`` pre-tokens or somewhat more; a long text comes in several."""
        tokens, ends = [], []
        for i, text in enumerate(texts):
            if len(text) <= CHUNK:
                tokens += self.pattern.findall(text)
                ends.append((i, len(tokens)))
            else:
                for some in batched(map(regex.Match.group, self.pattern.finditer(text)), CHUNK):
                    tokens += some
                    ends.append((i, len(tokens)))
                    yield tokens, ends
                    tokens, ends = [], []
            if len(tokens) >= CHUNK:
                yield tokens, ends
                tokens, ends = [], []
        if ends:
            yield tokens, ends

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after the other, and how many each text has."""
        parts, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for tokens, ends in self._portions(texts):
            ids, count = self._gathered(tokens)
            parts.append(ids)
            upto = np.concatenate([[0], np.cumsum(count)])
            at = np.array([0, *(e for _, e in ends)])
            np.add.at(sizes, [i for i, _ in ends], np.diff(upto[at]))
        return np.concatenate(parts), sizes

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes that ids stand for; null if one of them is null or none of the vocabulary's."""
        listed = ids.tolist()
        if listed and (None in listed or min(listed) < 0 or max(listed) >= len(self.bytes)):
            return None
        return b"".join(map(self.bytes.__getitem__, listed))


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(texts: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """``keep`` and ``ids array<int>`` of every row's text, by the rank file at ``path``, which the driver reads.

    With ``decoded`` also the bytes that these ids decode to: a round trip in the same Python process, where ``decode`` of
    the result would hold the vocabulary in a second one.
    """
    model = serialise(read_ranks(path))

    def setup():
        codec = Codec(model, pattern)

        def compute(rows, part):
            ids, sizes = codec.encode_all([t.decode("utf-8", "replace") for t in rows])
            out = {"ids": _lists(ids, sizes)}
            if decoded:
                ends = np.cumsum(sizes)
                out["decoded"] = [codec.decode(ids[b - n : b]) for b, n in zip(ends, sizes)]
            return out

        return compute

    return map_texts(texts, keep, setup, "ids array<int>, decoded binary" if decoded else "ids array<int>", rows=64, text=text)


def decode(rows: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and ``decoded binary``: the bytes that each row's ids stand for."""
    ship(rows.sparkSession)
    model = serialise(read_ranks(path))
    names = [k for k in keep if k != "decoded"]
    out = T.StructType([rows.schema[k] for k in names] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, codec = to_arrow_schema(out), Codec(model, "")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [codec.decode(np.asarray(x if x is not None else [], object)) for x in part.column("__ids").to_pylist()]
                arrays = [part.column(n).cast(arrow.field(n).type) for n in names] + [pa.array(found, arrow.field("decoded").type)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.select(*names, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(run, out)
