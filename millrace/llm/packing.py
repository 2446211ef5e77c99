"""Packing by powers of two: every document is cut into pieces of binary lengths, and no sequence crosses documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gathered, text_or_empty, trim
from ._merge import MergeTable

#: Entries that a worker's memos of chunks and of pieces may hold before they are emptied.
MEMO, MERGED = 500_000, 150_000
#: The characters that the tokenizer file treats as white space.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: White space that is not ASCII, or signs next to it that other splitters take for white space.
RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Signs from which on the file's pattern is applied by the tokenizer itself.
WIDE = re.compile("[\u0250-\U0010ffff]")
MARKS = ".,;:!?|"


class ChunkEncoder:
    """Encodes texts as the tokenizer of a file does that drops white space and lower-cases.

    For such a tokenizer a text's ids are those of its chunks between white
    space, in order.  Known chunks are looked up.  New ones go through the
    file's own normalizer and pattern, and their pieces are merged together.
    The strings of the file's added tokens are single ids, as the library has
    them by default, and what lies between them is encoded by itself.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable({(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)})
        signs = _byte_signs()
        self.inner = np.array([ids[c] for c in signs], np.int32)
        self.last = np.array([ids[c + suffix] for c in signs], np.int32)
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.byte = {c: b for b, c in enumerate(signs)}
        self.pattern = regex.compile(split["pattern"]["Regex"]).findall
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that need normal text, borders or white space are not supported")
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.cut_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.memo: dict[str, bytes] = {"": b""}
        self.merged: dict[bytes, bytes] = {}
        self.limit = memo

    def pieces(self, chunk: str) -> list[bytes]:
        """The pieces of a lower-case chunk; a word with one mark after it needs no pattern."""
        if chunk.isalpha():
            return [chunk.encode()]
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1].encode(), chunk[-1].encode()]
        return [p.encode() for p in self.pattern(chunk)]

    def wide_pieces(self, chunk: str) -> list[bytes]:
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in self.cut(self.normalize(chunk))]

    def learn(self, chunks: list[str], wide: bool) -> None:
        split = [self.wide_pieces(c) if WIDE.search(c) else self.pieces(c.lower()) for c in chunks] if wide else list(map(self.pieces, chunks))
        if len(self.merged) > min(MERGED, self.limit):
            self.merged = {}
        raw = list(set(chain.from_iterable(split)).difference(self.merged))
        sizes = np.array([len(p) for p in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        token = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        token[ends] = self.last[flat[ends]]
        known = self.merged
        known.update(zip(raw, self.table.merge(token, sizes), strict=True))
        self.memo.update(zip(chunks, (known[s[0]] if len(s) == 1 else b"".join(map(known.__getitem__, s)) for s in split), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        apart = {k: (self.cut_added.split(t), self.cut_added.findall(t)) for k, t in enumerate(texts) if self.cut_added.search(t)}
        if not apart:
            return self.plain(texts)
        flat = [s for k, t in enumerate(texts) for s in (apart[k][0] if k in apart else [t])]
        coded = iter(self.plain(flat))
        out = []
        for k in range(len(texts)):
            ids = next(coded)
            for mark in apart[k][1] if k in apart else ():
                ids += self.added[mark] + next(coded)
            out.append(ids)
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """The same for texts without added tokens."""
        # signs of old, common scripts are normal as they are, have the same classes in every Unicode version and lower-case one by one
        apart = [bool(WIDE.search(t)) for t in texts]
        lowered = (t if w else t.lower() for t, w in zip(texts, apart, strict=True))
        plain = pa.array([" ".join(SPACE.split(t)) if RARE.search(t) else t for t in lowered], pa.string())
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.memo) > self.limit:
            self.memo = {"": b""} | {c: self.memo[c] for c in set(chunks).intersection(self.memo)}
        found = list(map(self.memo.get, chunks))
        if missing := [k for k, f in enumerate(found) if f is None]:
            new = [chunks[k] for k in missing]
            self.learn(new, any(apart))
            for k, ids in zip(missing, map(self.memo.__getitem__, new), strict=True):
                found[k] = ids
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids, at = np.frombuffer(b"".join(found), "<i4"), coded.indices.to_numpy()
        lengths = sizes[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[at] - (ends - lengths)
        flat = np.repeat(shift.astype(np.int32), lengths)
        flat += np.arange(len(flat), dtype=np.int32)
        raw = ids[flat].tobytes()
        words = np.cumsum(split.value_lengths().to_numpy())
        cuts = (4 * np.concatenate([[0], ends])[words]).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies: its own if it has one, else the next beyond 255."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


_held: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, memo: int = MEMO) -> ChunkEncoder:
    """This worker's encoder; it outlives tasks, so that later ones find its memo filled."""
    if (path, memo) not in _held:
        _held[path, memo] = ChunkEncoder(path, memo)
        trim()
    return _held[path, memo]


def binary_lengths(n: int, most: int) -> list[int]:
    """n as a sum of powers of two: full pieces of ``most``, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str, end_id: int = 2, most: int = 4096, memo: int = MEMO, batch_bytes: int = 6 << 20) -> DataFrame:
    """Tokenized documents in binary-length pieces: doc_id, piece_no, start, length, ids, doc_tokens.

    ids holds little-endian unsigned 32-bit token ids; each document ends with
    ``end_id``.  ``most`` must be a power of two.  A worker's memo holds about
    ``memo`` entries and it encodes ``batch_bytes`` of text at once: less of
    either takes less memory and more time.  A null text counts as
    empty, so it gives the single piece [end_id].
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, memo)
        end = end_id.to_bytes(4, "little")
        for batch in gathered(batches, "text", batch_bytes):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                raw = ids + end
                at, n = 0, len(raw) // 4
                for k, length in enumerate(binary_lengths(n, most)):
                    rows.append((doc_id, k, at, length, raw[4 * at : 4 * (at + length)], n))
                    at += length
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece_no int, start long, length long, ids binary, doc_tokens long")


#: Low bits of a sequence id that hold the logarithm of its length: the bucket of its equals.
LEVEL_BITS = 5


def place(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to pieces, whatever else their rows carry (but for columns of these names, which are replaced).

    Each piece is a sequence of its own of a power-of-two length, so nothing
    is padded and offset is 0.  The low bits of sequence_id are the logarithm
    of the length, so that sequences of equal length make up one bucket and
    no other does; the bits above number the rows.  Rows stay where they are,
    none is counted or sorted, and rows that repeat get ids of their own.

    Row numbers follow partitions and the order in them: pieces must come
    from a table, a checkpoint or a scan, which give a lost partition again
    in the same order.
    """
    names = [F.col(f"`{n}`") for n in pieces.columns if n not in ("sequence_id", "offset")]
    level = F.log2(F.col("length").cast("double")).cast("long")
    return pieces.select(*names, (F.shiftleft(F.monotonically_increasing_id(), LEVEL_BITS) + level).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, path: str, end_id: int = 2, most: int = 4096, **encoding) -> DataFrame:
    """Packs all documents: a row per piece with doc_id, piece_no, start, length, ids, doc_tokens, sequence_id, offset.

    Null texts count as empty (one piece with ``end_id``); repeated rows are
    packed each for itself; an empty table gives an empty result; a text of
    any length is cut, never shortened; other columns of docs are not read,
    whatever they are called; docs must be a table or a checkpoint, see
    place().
    """
    return place(pieces(docs, path, end_id, most, **encoding))
