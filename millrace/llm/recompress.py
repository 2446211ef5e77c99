"""Deduplication of word sequences by recompression: equal windows meet at symbols that are named alike everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, gathered, prepare, trim
from ._symbols import Sums, names_of, window_phrases, words_of
from .pfp import _FIELDS, MARK, MEET, PART, PHRASE, WINDOW, _by_doc, _by_part, _bytes_of, _groups, _meeting, _near, _number, _packed, _repacked, _rows, _salts, _share, _unpacked, _windows, _windows_meet

#: Words that are parsed at once, for each of which parsing takes about 300 bytes, and texts that are.
STRETCH, TEXTS = 1 << 18, 50_000
#: Copies of a phrase in one batch from which on its first place is kept in mind, and phrases that are, by a task.
HOT, MINDED = 8, 100_000


class _Texts:
    """A batch of texts: its documents, with equal ones told once, and the names of its words."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.data, starts, sizes = _bytes_of(batch)
        self.ids, self.tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
        # the rank of each text among the batch's documents, by id and tag
        order = np.lexsort((self.tags, self.ids))
        new = _groups(self.ids[order], self.tags[order])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new) - 1
        self.begin, self.end, self.counts = words_of(self.data, starts, sizes)
        self.starts = np.cumsum(self.counts) - self.counts

    def names(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(names_of(self.data, self.begin[a:b], self.end[a:b], k) for k in (0, 1))

    def stretches(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of texts that are parsed together: text, first word in it and words, of about a stretch in all.

        A long text comes in several parts; each reaches as far as the windows
        that begin in it, and what is found of a window depends on its own
        words only, so the cuts don't show but for phrases that they part.
        """
        held, size = [], 0
        for t in np.flatnonzero(self.counts >= window).tolist():
            for a in range(0, int(self.counts[t]) - window + 1, STRETCH):
                n = min(STRETCH + window - 1, int(self.counts[t]) - a)
                held.append((t, a, n))
                size += n
                if size >= STRETCH:
                    yield tuple(np.array(x, np.int64) for x in zip(*held, strict=True))
                    held, size = [], 0
        if held:
            yield tuple(np.array(x, np.int64) for x in zip(*held, strict=True))

    def phrases(self, window: int) -> tuple[np.ndarray, ...]:
        """window_phrases() of all texts: text, first window, windows, key and ident."""
        out = []
        for text, at, n in self.stretches(window):
            own = [self.names(a, b) for a, b in zip((self.starts[text] + at).tolist(), (self.starts[text] + at + n).tolist(), strict=True)] if len(text) == 1 else None
            if own is None:
                # neighbours in the batch lie side by side, but for texts that are too short: names of the whole range, cut
                low, high = int(self.starts[text[0]] + at[0]), int(self.starts[text[-1]] + at[-1] + n[-1])
                names = self.names(low, high)
                pick = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[text] + at - low, n)
                own = [tuple(x[pick] for x in names)]
            owner, first, many, key, ident = window_phrases(*own[0], n, window)
            out.append((text[owner], at[owner] + first, many, key, ident))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.astype(np.uint64), none.astype(np.uint64))


def _later(same: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of sorted groups come later than the first of their group, and which are at its place once more."""
    lead = np.flatnonzero(same)[np.cumsum(same) - 1]
    equal = np.ones(len(same), bool)
    for x in place:
        equal &= x == x[lead]
    return ~equal, equal & ~same


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for share, whole in enumerate(gathered(batches, "text", PART)):
        for at in range(0, whole.num_rows, TEXTS):
            yield share, whole.slice(at, TEXTS)


class _Minded:
    """The first places that a task knows of what is very frequent, so that it tells the same only once."""

    def __init__(self) -> None:
        self.first: dict[int, tuple[int, int, int]] = {}

    def later(self, ident: np.ndarray, many: np.ndarray, ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of these, each the first of its kind in a batch that has it ``many`` times, come later than one of an earlier batch."""
        known = np.zeros(len(ident), bool)
        if self.first:
            for k in np.flatnonzero(np.isin(ident, np.fromiter(self.first, np.uint64, len(self.first)))).tolist():
                known[k] = self._meet(k, ident, ids, tags, at)
        for k in np.flatnonzero((many >= HOT) & ~known).tolist():
            if len(self.first) < MINDED:
                self._meet(k, ident, ids, tags, at)
        return known

    def _meet(self, k: int, ident: np.ndarray, ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> bool:
        place, mark = (int(ids[k]), int(tags[k]), int(at[k])), int(ident[k])
        held = self.first.get(mark)
        if held is not None and held < place:
            return True
        self.first[mark] = place
        return False


def _parse(window: int, parts: int, salts: int):
    """Phrases of each batch: those that it has earlier are known, a key with several phrases in it leaves them open, one phrase of each key goes to the key's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minded = _Minded()
        for share, batch in _slices(batches):
            texts = _Texts(batch)
            ids, tags = texts.ids, texts.tags
            doc, first, n, key, ident = texts.phrases(window)
            if not len(doc):
                continue
            order = np.lexsort((first, texts.rank[doc], ident, key))
            doc, first, n, key, ident = (x[order] for x in (doc, first, n, key, ident))
            same = _groups(key, ident)
            later, again = _later(same, texts.rank[doc], first)
            if later.any():
                yield _by_doc("known", doc[later], ids, tags, first[later], n[later])
            many = np.diff(np.flatnonzero(same), append=len(same))
            doc, first, n, key, ident = (x[same] for x in (doc, first, n, key, ident))
            known = minded.later(key ^ ident, many, ids[doc], tags[doc], first)
            if known.any():
                yield _by_doc("known", doc[known], ids, tags, first[known], n[known])
                doc, first, n, key, ident = (x[~known] for x in (doc, first, n, key, ident))
                if not len(doc):
                    continue
            begins = _groups(key)
            several = (np.diff(np.flatnonzero(begins), append=len(key)) > 1)[np.cumsum(begins) - 1]
            if several.any():
                yield _by_doc("open", doc[several], ids, tags, first[several], n[several])
            told = ~several | begins
            sent = np.zeros(int(told.sum()), PHRASE)
            sent["key"] = (key[told] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            sent["ident"] = ident[told]
            by_id = np.argsort(ids, kind="stable")  # documents in order of id, so that ids pack well
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            sent["doc"], sent["pos"] = place[doc[told]], first[told]
            sent["n"] = np.where(several[told], n[told] | MARK, n[told])
            yield from _packed("phrase", _share((key[told] % np.uint64(parts)).astype(np.int64), salts, share), sent, ids[by_id], tags[by_id])

    return run


def _meet(last: bool):
    """The phrases of each key: those that stand earlier too are known, and where a key has several phrases they are open.

    A share of a part settles what it can and hands on one phrase of each
    key, marked if the key has several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, part, blobs in _by_part(batches, "phrase"):
            if rest is not None:
                yield rest
                continue
            entries, doc, ids, tags = _unpacked(blobs, PHRASE)
            blobs.clear()
            key, pos = _number(entries["key"]), entries["pos"].astype(np.int64)
            order = np.lexsort((pos, tags[doc], ids[doc], entries["ident"], key))
            doc, key, pos, entries = doc[order], key[order], pos[order], entries[order]
            n = entries["n"]
            same, begins = _groups(key, entries["ident"]), _groups(key)
            known, _ = _later(same, ids[doc], tags[doc], pos)
            at, group = np.flatnonzero(begins), np.cumsum(begins) - 1
            shared = ((np.add.reduceat(same.astype(np.int64), at) > 1) | np.logical_or.reduceat(n >= MARK, at))[group]
            open_ = ~known & (n < MARK) & shared  # marked ones are open where they come from
            if known.any():
                yield _by_doc("known", doc[known], ids, tags, pos[known], (n[known] & (MARK - 1)).astype(np.int64))
            if open_.any():
                yield _by_doc("open", doc[open_], ids, tags, pos[open_], n[open_].astype(np.int64))
            if not last:
                on = entries[begins].copy()
                on["n"] = np.where(shared[begins], on["n"] | MARK, on["n"])
                yield from _repacked("phrase", part, on, doc[begins], ids, tags)
            del entries, doc, ids, tags, key, pos, n, same, begins, known, group, shared, open_
            trim()

    return run


def _open(window: int, parts: int, salts: int):
    """Open phrases again: each of their windows goes to the part of its hash, one of equal ones from a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minded = _Minded()
        for share, batch in _slices(batches):
            texts = _Texts(batch)
            ids, tags = texts.ids, texts.tags
            lists = [np.frombuffer(b"".join(x), "<i4").reshape(-1, 2) for x in batch.column("open").to_pylist()]
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            first, n = np.concatenate(lists).T.astype(np.int64)
            cuts = np.flatnonzero(np.diff(texts.starts[doc] // STRETCH, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
                which, pos = _windows(first[a:b], n[a:b])
                owner = doc[a:b][which]
                at = texts.starts[owner] + pos
                low, high = int(at.min()), int(at.max()) + window
                names, other = texts.names(low, high)
                x, y = Sums(names).of(at - low, at - low + window, 35), Sums(other).of(at - low, at - low + window, 36)
                order = np.lexsort((pos, texts.rank[owner], y, x))
                x, y, owner, pos = x[order], y[order], owner[order], pos[order]
                same = _groups(x, y)
                later, _ = _later(same, texts.rank[owner], pos)
                if later.any():
                    yield _by_doc("known", owner[later], ids, tags, pos[later], np.ones(int(later.sum()), np.int64))
                many = np.diff(np.flatnonzero(same), append=len(same))
                x, y, owner, pos = x[same], y[same], owner[same], pos[same]
                known = minded.later(x ^ y, many, ids[owner], tags[owner], pos)
                if known.any():
                    yield _by_doc("known", owner[known], ids, tags, pos[known], np.ones(int(known.sum()), np.int64))
                entries = np.zeros(int((~known).sum()), WINDOW)
                for name, values in (("a", x), ("b", y), ("doc", owner), ("pos", pos)):
                    entries[name] = values[~known]
                yield from _packed("window", _share((entries["a"] % np.uint64(parts)).astype(np.int64), salts, share), entries, ids, tags)

    return run


def _resolve(last: bool):
    return _windows_meet(last, lambda same, *place: _later(same, *place)[0])


def repeated_words(docs: DataFrame, window: int = 20, meet: int = MEET) -> DataFrame:
    """doc_id, tag and spans: the words that ``window`` words in a row cover which also start earlier.

    Earlier is in a smaller document, or further ahead in the same one.
    spans is an array of (start, end), ascending, maximal, counted in words;
    documents without any have no row.

    1. Texts that equal a smaller document's are one span and take no further
       part.
    2. The words of a text are recompressed: rounds name runs and pairs of
       symbols, by hashes of what is named, so that all tasks give the same
       names without a dictionary.  What is left of the boundaries between
       symbols after the rounds that a window can determine are its anchors
       (see boundaries() and window_phrases()); equal windows have equal
       anchors, and the windows of one anchor are a phrase.
    3. Phrases meet by the hash of their anchor's surroundings: a phrase that
       stands earlier is known to repeat, one whose surroundings no other
       phrase has is done, and the others are open.
    4. The windows of open phrases are read once more and meet by their own
       128-bit hashes.

    Phrases are told apart by 104 bits of hashes.  What a batch has often goes
    on once, and once from a task that has it often; what very many batches
    have meets in two steps, ``meet`` batches at a time first (see pfp's
    _meeting()), of which each hands on one entry, so that no task gets much
    of a phrase, of surroundings or of a window that most documents share.
    """
    spark = prepare(docs.sparkSession)
    rows = _rows(docs)
    hashed = rows.select("doc_id", "tag", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), F.octet_length("text").cast("long").alias("size")).checkpoint()
    firsts = hashed.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("same", "first").checkpoint()
    copies = hashed.join(_near(firsts, F.lit(64)), "same").where("doc_id > first").select("doc_id", "tag").distinct().checkpoint()
    total = hashed.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 << 20)))

    own = rows.join(_near(copies), ["doc_id", "tag"], "left_anti")
    salts = _salts(total, meet)
    dealt = own.mapInArrow(_parse(window, parts, salts), _FIELDS).withColumn("part", F.when(F.col("kind") == "phrase", F.col("part")).otherwise(F.xxhash64("doc_id")))
    met = _meeting(dealt, parts, salts, _meet).checkpoint()

    still = met.where("kind = 'open'").groupBy("doc_id", "tag").agg(F.collect_list("data").alias("open")).checkpoint()
    opened = own.join(_near(still, 64 + F.aggregate("open", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))), ["doc_id", "tag"]).select("doc_id", "tag", "text", "open").mapInArrow(_open(window, parts, salts), _FIELDS)
    opened = opened.withColumn("part", F.when(F.col("kind") == "window", F.col("part")).otherwise(F.xxhash64("doc_id")))
    resolved = _meeting(opened, parts, salts, _resolve)

    known = met.where("kind = 'known'").select("doc_id", "tag", "data").union(resolved.select("doc_id", "tag", "data"))
    gathered_ = known.groupBy("doc_id", "tag").agg(F.collect_list("data").alias("data"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for parts_ in batch.column("data").to_pylist():
                first, n = np.frombuffer(b"".join(parts_), "<i4").reshape(-1, 2).T.astype(np.int64)
                order = np.argsort(first)
                start, end = first[order], np.maximum.accumulate((first + n + window - 1)[order])
                new = np.concatenate([[True], start[1:] > end[:-1]])
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
                spans.append([{"start": a, "end": b} for a, b in zip(start[new].tolist(), end[last].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(spans, kind)], ["doc_id", "tag", "spans"])

    found = gathered_.mapInArrow(merge, "doc_id long, tag long, spans array<struct<start:long,end:long>>")
    whole = copies.select("doc_id", "tag", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1 << 40).alias("end"))).alias("spans"))
    return found.union(whole)


def without_repeats(docs: DataFrame, window: int = 20, words_column: str = "n_words", spans_column: str = "spans", kept_column: str = "kept") -> DataFrame:
    """The documents, with all their columns, and n_words (long), spans of words and kept (the words outside them, joined by one space).

    Columns of docs that have the names of these three are replaced.  A null
    text has no words and counts as empty, and so does white space; a row
    with null doc_id stays whole and is compared with nothing; equal rows are
    one document; different texts of one doc_id are documents in order of a
    checksum of them; matches never cross documents; a text of any length is
    compared whole, stretch by stretch, and must fit in a worker; an empty
    table gives an empty result.
    """
    spans = repeated_words(docs, window).checkpoint()
    names = [n for n in docs.columns if n.lower() not in (words_column.lower(), spans_column.lower(), kept_column.lower())]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = docs.select(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)), F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("tag"), text.alias("text"))
    joined = body.join(_near(spans, 64 + F.size("spans") * 32), ["doc_id", "tag"], "left")
    none = F.expr("array()").cast("array<struct<start:long,end:long>>")
    words = joined.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words").cast("long")
    cut = F.transform(F.coalesce("spans", none), lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], n).alias("end")))
    # a copy of a text that has no window keeps its words
    words = words.withColumn("cut", F.when(n >= window, cut).otherwise(none))
    zero = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    between = F.zip_with(F.concat(F.array(zero), "cut"), F.concat("cut", F.array(F.struct(n.alias("start"), n.alias("end")))), lambda a, b: F.slice("words", (a["end"] + 1).cast("int"), (b["start"] - a["end"]).cast("int")))
    return words.select(*(F.col(f"c{k}").alias(name) for k, name in enumerate(names)), n.alias(words_column), F.col("cut").alias(spans_column), F.array_join(F.flatten(between), " ").alias(kept_column))
