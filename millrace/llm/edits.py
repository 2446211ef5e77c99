"""Edit-aware token counts: segment trees over pre-tokens, recounted only where edits touch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gathered, lists, text_or_empty
from .bpe import Encoder, encoder

#: Code points before an edit whose pre-token must be matched again: a match of the pattern looks at two beyond its end at most.
CONTEXT = 2
#: Pre-tokens that a leaf holds before the tree is built anew.
CROWDED = 256


class TokenTree:
    """A document's pre-tokens as leaves, with sums of code points and tokens above them.

    Nodes are numbered as in a heap: node k has children 2k and 2k + 1 and
    the leaves begin at ``size``.  A leaf begins with one pre-token; an edit
    puts what it made into the first leaf it touched and empties the others,
    so the sums of log(size) nodes change for each of them.
    """

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        """chars and tokens: how many code points of the text, and how many tokens, each pre-token has."""
        self.build(text, chars, tokens)

    def build(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        n = len(chars)
        self.size = 1 << max(n - 1, 0).bit_length()
        self.text, self.count = text, n
        self.bounds = np.zeros(n + 1, np.int64)
        np.cumsum(chars, out=self.bounds[1:])
        if int(self.bounds[-1]) != len(text):
            raise ValueError("the leaves are not those of the text")
        self.changed: dict[int, tuple[list[str], list[int]]] = {}  # leaves that no longer hold their one pre-token
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + n] = chars
        self.tokens[self.size : self.size + n] = tokens
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                np.add(sums[level : 2 * level : 2], sums[level + 1 : 2 * level : 2], out=sums[level // 2 : level])
            level //= 2

    def leaf(self, k: int) -> list[str]:
        """The pre-tokens of a leaf."""
        held = self.changed.get(k)
        return held[0] if held is not None else [self.text[self.bounds[k] : self.bounds[k + 1]]] if k < self.count else []

    def _spliced(self, untouched, made) -> list:
        """What lies between the changed leaves and what they hold, in order."""
        out, at = [], 0
        for k in sorted(self.changed):
            out += [untouched(at, k), made(k)]
            at = min(k + 1, self.count)
        return [*out, untouched(at, self.count)]

    def whole(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text, and the code points and tokens of all its pre-tokens in order."""
        own_chars, own_tokens = (sums[self.size : self.size + self.count] for sums in (self.chars, self.tokens))
        if not self.changed:
            return self.text, own_chars.copy(), own_tokens.copy()
        text = "".join(self._spliced(lambda a, b: self.text[self.bounds[a] : self.bounds[max(a, b)]], lambda k: "".join(self.changed[k][0])))
        chars = np.concatenate(self._spliced(lambda a, b: own_chars[a:b], lambda k: np.fromiter(map(len, self.changed[k][0]), np.int64)))
        tokens = np.concatenate(self._spliced(lambda a, b: own_tokens[a:b], lambda k: np.array(self.changed[k][1], np.int64)))
        return text, chars, tokens

    @property
    def n_pieces(self) -> int:
        return self.count + sum(len(own) - (k < self.count) for k, (own, _) in self.changed.items())

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at`` and the code points before that leaf; the last filled leaf if there are no more."""
        node, before, sums = 1, 0, self.chars
        while node < self.size:
            node *= 2
            here = int(sums[node])
            if at - before >= here and (sums[node + 1] or at - before > here):
                before += here
                node += 1
        return node - self.size, before

    def plan(self, pattern, start: int, end: int, text: str) -> tuple[int, int, list[str], int, int]:
        """What replacing code points [start, end) by ``text`` changes.

        Matching begins anew at the pre-token that holds the code point two
        before the edit and goes on until a new boundary beyond the edit
        falls on an old one, from where on all matches are as before.
        Returns first leaf, last leaf, the pieces that they then hold, and
        how many of these were kept before and after the new ones.
        """
        total = int(self.chars[1])
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        leaf, before = self.find(max(start - CONTEXT, 0))
        head, at = [], before
        inside = iter(self.leaf(leaf))
        rest: list[str] = []
        for piece in inside:
            if at + len(piece) > max(start - CONTEXT, 0):
                rest = [piece, *inside]
                break
            head.append(piece)
            at += len(piece)
        last, ahead = leaf, 4
        while True:
            while last + 1 < self.count and (at + sum(map(len, rest)) < end or ahead > 0):
                last += 1
                if more := self.leaf(last):
                    rest += more
                    ahead -= 1
            whole = last + 1 >= self.count
            old = "".join(rest)
            new = old[: start - at] + text + old[end - at :]
            shift = len(text) - (end - start)
            bounds, b = {}, at
            for k, piece in enumerate(rest):
                if b >= end:
                    bounds[b + shift - at] = k
                b += len(piece)
            if whole:
                bounds[len(new)] = len(rest)
            made, place = [], 0
            while place < len(new):
                if place in bounds and place >= start - at + len(text):
                    return leaf, last, head + made + rest[bounds[place] :], len(head), len(rest) - bounds[place]
                match = pattern.match(new, place)
                stop = match.end() if match else place + 1
                if not whole and stop + CONTEXT > len(new):
                    break
                if match:
                    made.append(match.group())
                place = stop
            else:
                if whole:
                    return leaf, last, head + made, len(head), 0
            ahead = 2 * max(len(rest), 4)

    def put(self, leaf: int, last: int, pieces: list[str], tokens: list[int]) -> None:
        """Let the first of the leaves hold the pieces and empty the others; sums follow up to the root."""
        for k in range(leaf, last + 1):
            own, counts = (pieces, tokens) if k == leaf else ([], [])
            if not own and not self.leaf(k):
                continue
            self.changed[k] = (own, counts)
            more = sum(map(len, own)) - int(self.chars[k + self.size]), sum(counts) - int(self.tokens[k + self.size])
            path = k + self.size >> np.arange(self.size.bit_length())
            self.chars[path] += more[0]
            self.tokens[path] += more[1]
        if len(pieces) > CROWDED:
            self.build(*self.whole())


def leaves_of(code: Encoder, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: the code points and the tokens of its pre-tokens."""
    split = [code.pieces(t) for t in texts]
    code.learn(chain.from_iterable(split))
    known = code.memo.__getitem__
    return [(np.fromiter(map(len, s), np.int64, len(s)), np.fromiter(map(len, map(known, s)), np.int64, len(s)) // 4) for s in split]


def recount(code: Encoder, trees: list[TokenTree], edits: list[list[dict]]) -> list[tuple[int, int, int]]:
    """Makes each tree's edits in order; returns tokens before, edits made and pre-tokens matched again.

    All trees' nth edits are planned together, so that new pre-tokens are
    merged together.  What an edit doesn't touch is neither matched nor encoded.
    """
    before = [int(t.tokens[1]) for t in trees]
    again = [0] * len(trees)
    pattern = code.pattern
    for turn in range(max(map(len, edits), default=0)):
        plans = [(d, trees[d].plan(pattern, e[turn]["start"] or 0, e[turn]["end"] or 0, e[turn]["text"] or "")) for d, e in enumerate(edits) if turn < len(e) and e[turn] is not None]
        code.learn((p for _, (_, _, pieces, _, _) in plans for p in pieces), keep=turn > 0)
        for d, (leaf, last, pieces, kept, after) in plans:
            trees[d].put(leaf, last, pieces, [len(code.memo[p]) // 4 for p in pieces])
            again[d] += len(pieces) - kept - after
    return [(b, len(e), n) for b, e, n in zip(before, edits, again, strict=True)]


STATE = "doc_id long, text string, piece_chars array<int>, piece_tokens array<int>"
COUNTED = ("n_tokens_before", "n_edits", "n_recounted", "n_pieces", "n_tokens")


def _arrays(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.array([len(x) for x in parts], np.int64)
    return lists(np.concatenate(parts).astype(np.int32) if len(parts) else np.zeros(0, np.int32), sizes, pa.int32())


def count(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The leaves of every whole text, to be stored: doc_id, text, piece_chars and piece_tokens.

    n_tokens of a text is the sum of piece_tokens.  A null text counts as
    empty and has no leaves; rows that repeat are counted each for itself; a
    text of any length is counted whole; an empty table gives an empty
    result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in gathered(batches, "text", 4 << 20):
            found = leaves_of(code, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), _arrays([c for c, _ in found]), _arrays([t for _, t in found])], ["doc_id", "text", "piece_chars", "piece_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, STATE)


def edit(state: DataFrame, path: str, pattern: str, edits_column: str = "edits") -> DataFrame:
    """Token counts after edits of counted texts, from their stored leaves: the state after them and COUNTED.

    state has doc_id, text, piece_chars and piece_tokens, as count() or an
    earlier edit() gave them (rows whose leaves are null, or a table without
    these two columns, are counted here first), and each row's edits, an array of (start, end,
    text), made in order: code points [start, end) of the text as the edits
    before left it are replaced.  Trees are built from the leaves; only what
    an edit touches, and the code points around it that a match may look at,
    is matched and encoded.  Returns doc_id, text, piece_chars and
    piece_tokens after all edits, n_tokens_before, n_edits, n_recounted
    (pre-tokens matched again), n_pieces and n_tokens.

    A null text counts as empty; null edits are none, and a null place in one
    is 0, a null text empty; places beyond the text mean its end; rows that
    repeat are edited each for itself; leaves that don't add up to the text
    fail the job; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in gathered(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            columns = [batch.column(c) for c in ("piece_chars", "piece_tokens")]
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
            ends = np.cumsum(columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            leaves = [(flat[0][a:b], flat[1][a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            uncounted = [d for d, missing in enumerate(columns[0].is_null().to_pylist()) if missing]
            for d, own in zip(uncounted, leaves_of(code, [texts[d] for d in uncounted]), strict=True):
                leaves[d] = own
            trees = [TokenTree(text, *own) for text, own in zip(texts, leaves, strict=True)]
            del texts, leaves, flat
            numbers = recount(code, trees, [e or [] for e in batch.column("edits").to_pylist()])
            after = [t.whole() for t in trees]
            counts = [(*x, t.n_pieces, int(t.tokens[1])) for x, t in zip(numbers, trees, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _, _ in after], pa.string()), _arrays([c for _, c, _ in after]), _arrays([t for _, _, t in after]), *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True))],
                ["doc_id", "text", "piece_chars", "piece_tokens", *COUNTED],
            )

    kind = "array<struct<start:int,end:int,text:string>>"
    leaves = [(F.col(c) if c in state.columns else F.lit(None)).cast("array<int>").alias(c) for c in ("piece_chars", "piece_tokens")]
    rows = state.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *leaves, F.col(edits_column).cast(kind).alias("edits"))
    return rows.mapInArrow(run, f"{STATE}, " + ", ".join(f"{n} long" for n in COUNTED))


def revised(docs: DataFrame) -> DataFrame:
    """docs with edits, a fixed revision: a cut a third in, an insertion in the middle, a new beginning and a new end."""
    n = F.length(text_or_empty())
    third, half = (n / 3).cast("int"), (n / 2).cast("int")
    edit_ = lambda start, end, text: F.struct(start.alias("start"), end.alias("end"), F.lit(text).alias("text"))
    far = F.lit(2**31 - 1)
    return docs.withColumn("edits", F.array(edit_(third, third + 7, ""), edit_(half, half, " we've revised"), edit_(F.lit(0), F.lit(1), "It's "), edit_(far, far, "\n\nEnd 2026.")))
