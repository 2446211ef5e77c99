"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gathered, lists, text_or_empty
from ._merge import MergeTable

#: Entries that a worker's memo of pre-tokens may hold before it is emptied.
MEMO = 150_000


class Vocabulary:
    """Tokens and ranks of a tiktoken rank file; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def table(self) -> MergeTable:
        """Every split of a token into two tokens; only encoding needs it."""
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank, rank)
        return MergeTable(pairs)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (none of them empty) as little-endian 32-bit integers."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        return self.table.merge(self.single[np.frombuffer(b"".join(pieces), np.uint8)], sizes)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after the other, and each id's number of bytes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        return self.bytes[np.repeat(self.starts[ids], lengths) + within], lengths


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """This worker's vocabulary of a file; it outlives tasks."""
    return Vocabulary(path)


class Encoder:
    """Encodes texts match by match of a pattern; merged pre-tokens are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, memo: int = MEMO):
        self.vocabulary, self.limit = vocabulary, memo
        self.pattern = regex.compile(pattern)
        self.pieces = self.pattern.findall
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: Iterator[str], keep: bool = False) -> None:
        """Put all pieces into the memo; those that are not in it are merged together.  keep: don't empty a full memo first."""
        if len(self.memo) > self.limit and not keep:
            self.memo = {}
        new = set(pieces).difference(self.memo)
        ranks, rest = self.vocabulary.ranks, []
        for piece in new:
            whole = ranks.get(piece.encode())
            if whole is None:
                rest.append(piece)
            else:
                self.memo[piece] = whole.to_bytes(4, "little")
        self.memo.update(zip(rest, self.vocabulary.merge([p.encode() for p in rest]), strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's number of ids."""
        split = [self.pieces(t) for t in texts]
        self.learn(chain.from_iterable(split))
        known = self.memo.__getitem__
        ids = [b"".join(map(known, s)) for s in split]
        return np.frombuffer(b"".join(ids), "<i4"), np.array([len(x) // 4 for x in ids], np.int64)


_held: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder; it outlives tasks, so that later ones find its memo filled."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Encoder(vocabulary(path), pattern)
    return _held[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, by the rank file at ``path``.

    Each match of ``pattern`` is encoded by itself and no special tokens are
    recognised.  A null or empty text has no ids; rows stay one for one, in
    whatever number they repeat; an empty table gives an empty result.  The
    memo of a worker is bounded; a text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in gathered(batches, "text", 4 << 20):
            ids, lengths = code(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, lengths, pa.int32())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and data (binary), the bytes that ids stand for.

    Null ids count as none.  An id outside the vocabulary fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                column = part.column("ids")
                flat = column.flatten().to_numpy(zero_copy_only=False)
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                data, lengths = known.decode(flat)
                sums = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(sums.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(flat, counts, pa.int32()), raw], ["doc_id", "ids", "data"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, data binary")
