"""Substring deduplication by prefix-free parsing and suffix arrays of the phrase dictionary."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import gathered, trim
from ._phrases import phrases

#: Phrases of one trigger that a batch sends on at most; beyond that, and where more than MANY meet, single windows are compared.
SENT, MANY = 64, 256
#: Rows and bytes up to which a side of a join is sent to every executor.
SMALL, SMALL_BYTES = 1_000_000, 128 << 20
MARK = 128
#: Bytes of text whose phrases are compared in a task at once, and those that are parsed at once, for each of which
#: parsing takes about 150 bytes.
PART, STRETCH = 2 << 20, 1 << 18
PHRASE = np.dtype([("key", "u1", 5), ("ident", "<u8"), ("doc", "<u2"), ("pos", "<u4"), ("n", "u1")])


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a checksum of the text that tells rows of one doc_id apart) and text of the rows with both."""
    text = F.col("text").cast("string")
    return docs.where(F.col("doc_id").isNotNull() & text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("tag"), text.alias("text"))


def _near(df: DataFrame, width: Column | None = None) -> DataFrame:
    """df, to be sent to every executor if it has few rows and, by the bytes that ``width`` gives a row, is small; else Spark joins it by shuffling."""
    facts = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width if width is not None else F.lit(32)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if facts["rows"] <= SMALL and facts["bytes"] <= SMALL_BYTES else df


def _bytes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, where each starts and its size."""
    column = batch.column("text")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def _stretches(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of entries that hold about a stretch of bytes each."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // STRETCH, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True)) if cuts else []


def _phrases_of(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """phrases() of a batch, stretch by stretch.

    A text that is longer than a stretch is parsed in several.  The phrase at
    their border then comes in two parts, which is right as well: parts that
    match no other document's phrase are compared by windows.
    """
    data, starts, sizes = _bytes_of(batch)
    doc, at, end = [], [], []
    for d in np.flatnonzero(sizes >= window).tolist():
        for a in range(0, int(sizes[d]) - window + 1, STRETCH):
            doc.append(d)
            at.append(a)
            end.append(min(a + STRETCH + window - 1, int(sizes[d])))
    doc, at, end = (np.array(x, np.int64) for x in (doc, at, end))
    out = []
    for a, b in _stretches(end - at):
        n = end[a:b] - at[a:b]
        body = np.concatenate([data[starts[d] + x : starts[d] + y] for d, x, y in zip(doc[a:b].tolist(), at[a:b].tolist(), end[a:b].tolist(), strict=True)])
        owner, first, many, key, ident = phrases(body, np.cumsum(n) - n, n, window)
        out.append((doc[a:b][owner], first + at[a:b][owner], many, key, ident))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.astype(np.uint64), none.astype(np.uint64))


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns begin a group of equal ones."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _by_doc(kind: str, docs: np.ndarray, ids: np.ndarray, tags: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per document with its stretches (first window, number of windows) as 32-bit integers."""
    order = np.lexsort((first, docs))
    docs, pairs = docs[order], np.stack([first[order], n[order]], axis=1).astype("<i4")
    begin = np.flatnonzero(_groups(docs))
    raw = pairs.tobytes()
    ends = [*begin[1:].tolist(), len(docs)]
    own = docs[begin]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(begin)), pa.array(np.zeros(len(begin), np.int64)), pa.array(ids[own]), pa.array(tags[own]), pa.array([raw[8 * a : 8 * b] for a, b in zip(begin.tolist(), ends, strict=True)], pa.binary())],
        schema=_SCHEMA,
    )


_SCHEMA = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("data", pa.binary())])
_FIELDS = "kind string, part long, doc_id long, tag long, data binary"


def _columns(entries: np.ndarray, docs: np.ndarray) -> bytes:
    """Entries in order of their documents, column by column: what names places packs well, hashes don't."""
    bytes_of = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    places = bytes_of(np.diff(docs, prepend=0).astype("<u2")) + b"".join(bytes_of(entries[c]) for c in entries.dtype.names if c in PLACES)
    packed = zlib.compress(places, 1)
    return np.array([len(entries), len(packed)], "<u4").tobytes() + packed + b"".join(entries[c].tobytes() for c in entries.dtype.names if c not in (*PLACES, "doc"))


def _entries(raw: bytes, kind: np.dtype) -> np.ndarray:
    """The entries that _columns() has told."""
    n, size = np.frombuffer(raw, "<u4", 2).tolist()
    places, at, hashes = zlib.decompress(raw[8 : 8 + size]), 2 * n, 8 + size
    out = np.empty(n, kind)
    of_bytes = lambda x, width: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, n).T)
    out["doc"] = np.cumsum(of_bytes(places[:at], 2).view("<u2")[:, 0])
    for c in kind.names:
        if c in PLACES:
            width = kind[c].itemsize
            out[c] = of_bytes(places[at : at + width * n], width).view(kind[c])[:, 0]
            at += width * n
        elif c != "doc":
            width = kind[c].itemsize
            raw_c = raw[hashes : hashes + width * n]
            out[c] = np.frombuffer(raw_c, kind[c].base, n * (width // kind[c].base.itemsize)).reshape(n, *kind[c].shape)
            hashes += width * n
    return out


#: Columns of entries that say where something is.
PLACES = ("pos", "n")


def _packed(kind: str, part: np.ndarray, entries: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries as one blob for each part that they are dealt to, with the documents that they name."""
    order = np.lexsort((entries["doc"], part))
    part, entries = part[order], entries[order]
    begin = np.flatnonzero(_groups(part)).tolist()
    out = []
    for a, b in zip(begin, [*begin[1:], len(part)], strict=True):
        mine = entries[a:b]
        own, docs = np.unique(mine["doc"], return_inverse=True)
        table = zlib.compress(np.diff(ids[own], prepend=0).astype("<i8").tobytes(), 1)
        head = np.array([len(own), len(table)], "<u4").tobytes()
        out.append((int(part[a]), head + table + tags[own].astype("<u4").tobytes() + _columns(mine, docs)))
    if out:
        n = len(out)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([p for p, _ in out], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([d for _, d in out], pa.binary())], schema=_SCHEMA)


#: Documents that a blob may name: entries hold their number in it.
NAMED = 50_000


def _repacked(kind: str, part: int, entries: np.ndarray, doc: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries that go on to another part, with the documents that they name."""
    order = np.lexsort((tags[doc], ids[doc]))
    entries, doc = entries[order].copy(), doc[order]
    number = np.cumsum(_groups(ids[doc], tags[doc])) - 1
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, NAMED):
        low, high = np.searchsorted(number, [a, a + NAMED])
        own, mine = doc[low:high], entries[low:high]
        first = np.flatnonzero(np.diff(number[low:high], prepend=-1))
        mine["doc"] = number[low:high] - a
        yield from _packed(kind, np.full(len(mine), part, np.int64), mine, ids[own][first], tags[own][first])


def _unpacked(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all blobs, the index of each one's document, and the documents' ids and tags."""
    entries, docs, ids, tags, known = [], [], [], [], 0
    for blob in blobs:
        n, size = np.frombuffer(blob, "<u4", 2).tolist()
        ids.append(np.cumsum(np.frombuffer(zlib.decompress(blob[8 : 8 + size]), "<i8")))
        tags.append(np.frombuffer(blob, "<u4", n, 8 + size).astype(np.int64))
        entries.append(_entries(blob[8 + size + 4 * n :], kind))
        docs.append(entries[-1]["doc"].astype(np.int64) + known)
        known += n
    return tuple(np.concatenate(x) for x in (entries, docs, ids, tags))


def _number(raw: np.ndarray) -> np.ndarray:
    """Little-endian integers of a few bytes each."""
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8")[:, 0]


def _parse(window: int, parts: int, salts: int):
    """Phrases of each batch: what repeats within the batch is resolved there, one of every phrase goes to the part of its trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, whole in enumerate(gathered(batches, "text", PART)):
            for at in range(0, whole.num_rows, 50_000):
                batch = whole.slice(at, 50_000)
                doc, first, n, key, ident = _phrases_of(batch, window)
                if not len(doc):
                    continue
                ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
                rank = np.unique(ids, return_inverse=True)[1]
                order = np.lexsort((rank[doc], ident, key))
                doc, first, n, key, ident = (x[order] for x in (doc, first, n, key, ident))
                same = _groups(key, ident)
                least = rank[doc[same]][np.cumsum(same) - 1]
                known = rank[doc] > least
                if known.any():
                    yield _by_doc("known", doc[known], ids, tags, first[known], n[known])
                doc, first, n, key, ident = (x[~known] for x in (doc, first, n, key, ident))
                begins = _groups(key)
                kinds = np.cumsum(_groups(key, ident))
                ordinal = kinds - kinds[begins][np.cumsum(begins) - 1]
                last = np.concatenate([np.flatnonzero(begins)[1:], [len(key)]]) - 1
                many = (ordinal[last] >= SENT)[np.cumsum(begins) - 1]
                over = ordinal >= SENT
                if over.any():
                    yield _by_doc("open", doc[over], ids, tags, first[over], n[over] | MARK)
                sent = np.zeros(int((~over).sum()), PHRASE)
                kept = ~over
                sent["key"] = (key[kept] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                sent["ident"] = ident[kept]
                by_id = np.argsort(ids, kind="stable")  # documents in order of id, so that ids pack well
                place = np.empty(len(ids), np.int64)
                place[by_id] = np.arange(len(ids))
                sent["doc"], sent["pos"] = place[doc[kept]], first[kept]
                sent["n"] = np.where(many[kept], n[kept] | MARK, n[kept])
                yield from _packed("phrase", _share((key[kept] % np.uint64(parts)).astype(np.int64), salts, share), sent, ids[by_id], tags[by_id])

    return run


#: Batches whose phrases meet in one task.  Of a hot trigger each sends SENT phrases at most, so that a task gets a million
#: entries of it, or about 20 MB.  Beyond that phrases are dealt twice, at twice the shuffle.
MEET = 16_000


def _salts(total: int, meet: int) -> int:
    """How many tasks share a part's phrases before they meet: one for every ``meet`` batches."""
    return max(1, -(-total // (PART * meet)))


def _meeting(dealt: DataFrame, parts: int, salts: int, step) -> DataFrame:
    """Runs step(last) on what is dealt to the parts; with salts, on shares of each part first, which hand on what their own can't settle.

    A batch is dealt to part * salts + salt.  So a trigger, a phrase or a
    window that very many batches have is first reduced share by share.
    """
    if salts > 1:
        dealt = dealt.repartition(parts, "part").mapInArrow(step(False), _FIELDS)
        dealt = dealt.withColumn("part", F.when(F.col("kind").isin("phrase", "window"), F.floor(F.col("part") / salts)).otherwise(F.col("part")))
    return dealt.repartition(parts, "part").mapInArrow(step(True), _FIELDS)


def _share(parts: np.ndarray, salts: int, batch: int) -> np.ndarray:
    """Where a batch's entries for these parts go: all to the batch's share of each."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return parts * salts + (batch + (context.partitionId() * 7919 if context else 0)) % salts


def _by_part(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.RecordBatch | None, int, list[bytes]]]:
    """What a task has got: rows of other kinds as they come, then each part's blobs of this one."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        mine = pa.array([k == kind for k in batch.column("kind").to_pylist()], pa.bool_())
        own = batch.filter(mine)
        for part, data in zip(own.column("part").to_pylist(), own.column("data").to_pylist(), strict=True):
            blobs.setdefault(part, []).append(data)
        rest = batch.filter(pa.compute.invert(mine))
        if rest.num_rows:
            yield rest, 0, []
    for part in list(blobs):
        yield None, part, blobs.pop(part)
    trim()


def _meet(last: bool):
    """The dictionary of a part: phrases that a smaller document holds are known, those whose trigger others share in part stay open.

    A share of a part settles what it can: copies are known, and a trigger
    with very many phrases opens them, as windows, and hands on one of them,
    marked, so that the rest of the corpus learns of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, part, blobs in _by_part(batches, "phrase"):
            if rest is not None:
                yield rest
                continue
            entries, doc, ids, tags = _unpacked(blobs, PHRASE)
            blobs.clear()
            key, ident, pos, many = _number(entries["key"]), entries["ident"], entries["pos"], entries["n"]
            order = np.lexsort((ids[doc], ident, key))
            doc, key, ident, pos, many, entries = doc[order], key[order], ident[order], pos[order], many[order], entries[order]
            own = ids[doc]
            del order
            same, begins = _groups(key, ident), _groups(key)
            known = own > own[same][np.cumsum(same) - 1]
            at = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1
            several = (np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at))[group]
            kinds = np.add.reduceat(same.astype(np.int64), at)[group]
            marked = np.logical_or.reduceat(many >= MARK, at)[group]
            hot = marked | (kinds > MANY)
            open_ = ~known & (hot | several & (kinds > 1)) if last else ~known & hot
            n = (many & (MARK - 1)).astype(np.int64)
            if known.any():
                yield _by_doc("known", doc[known], ids, tags, pos[known], n[known])
            if open_.any():
                yield _by_doc("open", doc[open_], ids, tags, pos[open_], np.where(hot[open_], n[open_] | MARK, n[open_]))
            if not last:
                on = ~known & (~hot | begins)
                entries = entries[on].copy()
                entries["n"] = np.where(hot[on], n[on] | MARK, n[on])
                yield from _repacked("phrase", part, entries, doc[on], ids, tags)
            del entries, doc, ids, tags, key, ident, pos, many, own, same, begins, known, group, several, kinds, marked, hot, open_, n
            trim()

    return run


WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<u2"), ("pos", "<u4")])


def _words(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The windows that begin at the given bytes as rows of big-endian 64-bit words, so that they sort like the bytes."""
    width = -(-window // 8)
    raw = np.zeros((len(at), 8 * width), np.uint8)
    raw[:, :window] = np.lib.stride_tricks.sliding_window_view(data, window)[at]
    return raw.view(">u8").astype(np.uint64)


def _digest(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from ._shingles import mix

    a = np.zeros(len(words), np.uint64)
    b = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        a, b = mix(a ^ mix(words[:, k], 2 * k + 1), 91), mix(b ^ mix(words[:, k], 2 * k + 2), 92)
    return a, b


def _windows(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of the phrases: the phrase that it is in, and where it starts."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[which]


def _windows_meet(last: bool, later):
    """The windows of each hash: those that stand earlier too, as later() tells from sorted groups, are known; a share of a part hands on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, part, blobs in _by_part(batches, "window"):
            if rest is not None:
                yield rest
                continue
            entries, doc, ids, tags = _unpacked(blobs, WINDOW)
            blobs.clear()
            order = np.lexsort((entries["pos"], tags[doc], ids[doc], entries["b"], entries["a"]))
            entries, doc = entries[order], doc[order]
            same, pos = _groups(entries["a"], entries["b"]), entries["pos"].astype(np.int64)
            known = later(same, ids[doc], tags[doc], pos)
            if known.any():
                yield _by_doc("known", doc[known], ids, tags, pos[known], np.ones(int(known.sum()), np.int64))
            if not last:
                yield from _repacked("window", part, entries[same], doc[same], ids, tags)

    return run


def _in_smaller(same: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows of sorted groups are in a larger document than the first of their group."""
    return ids > ids[same][np.cumsum(same) - 1]


def _open(window: int, parts: int, salts: int):
    """Open phrases again: their texts go to the part of their trigger; of hot triggers, their windows go to the parts of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, whole in enumerate(gathered(batches, "text", PART)):
            for at in range(0, whole.num_rows, 50_000):
                batch = whole.slice(at, 50_000)
                batch = batch.take(pa.compute.sort_indices(batch.column("doc_id")))
                data, starts, _ = _bytes_of(batch)
                ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
                lists = [np.frombuffer(b"".join(x), "<i4").reshape(-1, 2) for x in batch.column("open").to_pylist()]
                doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                first, n = np.concatenate(lists).T.astype(np.int64)
                hot = n >= MARK
                n &= MARK - 1
                cold = np.flatnonzero(~hot)
                for a, b in _stretches(n[cold] + window - 1):
                    yield _texts_of(cold[a:b], data, starts, ids, tags, doc, first, n, window, parts)
                if hot.any():
                    which, pos = _windows(first[hot], n[hot])
                    d = doc[hot][which]
                    for a in range(0, len(d), 100_000):
                        yield from _resolve_windows(data, starts, ids, tags, d[a : a + 100_000], pos[a : a + 100_000], window, parts, salts, share)

    return run


def _texts_of(cold, data, starts, ids, tags, doc, first, n, window, parts) -> pa.RecordBatch:
    """Texts of phrases, those of one part together, each with its document, first window and number of windows."""
    sizes = n[cold] + window - 1
    begin = np.cumsum(sizes) - sizes
    body = data[np.arange(int(sizes.sum())) - np.repeat(begin, sizes) + np.repeat(starts[doc[cold]] + first[cold], sizes)]
    _, _, _, key, _ = phrases(body, begin, sizes, window)
    part = (key % np.uint64(parts)).astype(np.int64)
    out, raw = [], body.tobytes()
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(_groups(part[order])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        mine = order[a:b]
        d = doc[cold[mine]]
        head = zlib.compress(np.stack([ids[d], tags[d], first[cold[mine]], n[cold[mine]]]).astype("<i8").tobytes(), 1)
        texts = b"".join(raw[begin[k] : begin[k] + sizes[k]] for k in mine.tolist())
        out.append((int(part[order[a]]), np.array([8 + len(head), len(mine)], "<i8").tobytes() + head + texts))
    m = len(out)
    return pa.RecordBatch.from_arrays([pa.array(["texts"] * m), pa.array([p for p, _ in out], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([x for _, x in out], pa.binary())], schema=_SCHEMA)


def _resolve_windows(data, starts, ids, tags, d, pos, window, parts, salts, share) -> Iterator[pa.RecordBatch]:
    """Windows of hot triggers: what a smaller document of the batch holds is known, one of each goes on by its digest."""
    a, b = _digest(_words(data, starts[d] + pos, window))
    order = np.lexsort((ids[d], b, a))
    a, b, d, pos = a[order], b[order], d[order], pos[order]
    same = _groups(a, b)
    own = ids[d]
    known = own > own[same][np.cumsum(same) - 1]
    if known.any():
        yield _by_doc("known", d[known], ids, tags, pos[known], np.ones(int(known.sum()), np.int64))
    entries = np.zeros(int((~known).sum()), WINDOW)
    for name, x in (("a", a), ("b", b), ("doc", d), ("pos", pos)):
        entries[name] = x[~known]
    yield from _packed("window", _share((a[~known] % np.uint64(parts)).astype(np.int64), salts, share), entries, ids, tags)


def _suffix_ranks(data: np.ndarray, window: int) -> np.ndarray:
    """The rank of the suffix at each byte among all suffixes, by its first ``window`` bytes: equal ranks, equal windows.

    Prefix doubling: two ranks at half the depth make one, the last two
    overlapping.  Near the end of the data ranks have no meaning.
    """
    depth = min(8, window)
    lead = np.zeros((len(data), 8), np.uint8)
    for k in range(depth):
        lead[: len(data) - k, k] = data[k:]
    rank = lead.view(">u8")[:, 0].astype(np.uint64)
    del lead
    while True:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        if depth == window:
            return rank
        step = min(depth, window - depth)
        both = rank << np.uint64(32)
        both[: len(rank) - step] |= rank[step:]
        rank, depth = both, depth + step


def _merged(texts: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """The dictionary of a part in the order of its suffixes, and the parse merged into it: who holds each window first.

    Equal phrases are one entry of the dictionary, with its occurrences in
    the parse.  Suffixes of entries whose first ``window`` bytes are equal
    are a run of the suffix array; the occurrences of their entries are the
    run's places in the corpus, of which those in the smallest document keep
    their bytes.
    """
    heads, bodies = [], []
    for blob in texts:
        size, n = int(np.frombuffer(blob, "<i8", 1)[0]), int(np.frombuffer(blob, "<i8", 1, 8)[0])
        heads.append(np.frombuffer(zlib.decompress(blob[16 : 8 + size]), "<i8").reshape(4, n))
        bodies.append(blob[8 + size :])
    ids, tags, first, n = np.concatenate(heads, axis=1)
    raw = b"".join(bodies)
    ends = np.cumsum(n + window - 1).tolist()
    del texts, heads, bodies
    entries: dict[bytes, int] = {}
    entry = np.array([entries.setdefault(raw[a:b], len(entries)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64)
    del raw
    data = np.frombuffer(b"".join(entries), np.uint8)
    sizes = np.fromiter(map(len, entries), np.int64, len(entries))
    del entries
    # where each window of the dictionary begins, and the run of the suffix array that it is in
    which, at = _windows(np.cumsum(sizes) - sizes, sizes - window + 1)
    run = np.unique(_suffix_ranks(data, window)[at], return_inverse=True)[1]
    del at, data
    # the smallest document of each entry, then of each run
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, ids)
    holder = np.full(int(run.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(holder, run, least[which])
    holder = holder[run]
    begin = np.cumsum(sizes - window + 1) - (sizes - window + 1)
    # documents by id and tag, so that stretches of one document come together again
    uniq, back = np.unique(np.stack([ids, tags], axis=1), axis=0, return_inverse=True)
    back = back.ravel()
    shared = np.flatnonzero(ids > np.minimum.reduceat(holder, begin)[entry])  # occurrences with a window that a smaller document holds
    for a in range(0, len(shared), 50_000):
        mine = shared[a : a + 50_000]
        occurrence, place = _windows(begin[entry[mine]], n[mine])
        known = ids[mine][occurrence] > holder[place]
        occurrence, place = mine[occurrence[known]], place[known]
        pos = place - begin[entry[occurrence]] + first[occurrence]
        yield _by_doc("known", back[occurrence], uniq[:, 0], uniq[:, 1], pos, np.ones(len(pos), np.int64))


def _sort(window: int):
    """The suffix array of each part's dictionary, to the depth of a window, merged with the parse; windows of hot triggers by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, blobs = [], []
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for kind, data in zip(kinds, batch.column("data"), strict=True):
                if kind != "known":
                    (texts if kind == "texts" else blobs).append(data.as_py())
            rest = batch.filter(pa.array([k == "known" for k in kinds], pa.bool_()))
            if rest.num_rows:
                yield rest
        if texts:
            yield from _merged(texts, window)
        if blobs:
            entries, doc, ids, tags = _unpacked(blobs, WINDOW)
            order = np.lexsort((ids[doc], entries["b"], entries["a"]))
            same = _groups(entries["a"][order], entries["b"][order])
            doc, pos = doc[order], entries["pos"][order].astype(np.int64)
            known = ids[doc] > ids[doc][same][np.cumsum(same) - 1]
            if known.any():
                yield _by_doc("known", doc[known], ids, tags, pos[known], np.ones(int(known.sum()), np.int64))
        trim()

    return run


def repeated_spans(docs: DataFrame, window: int = 50, meet: int = MEET) -> DataFrame:
    """doc_id, tag and spans: the stretches of bytes that repeat smaller documents.

    A byte is in a span if a ``window``-byte string covers it that also
    starts in a document with a smaller doc_id.  spans is an array of
    (start, end), ascending, maximal, as bytes of the UTF-8 text; documents
    without any have no row.

    1. Texts that equal a smaller document's are spans as a whole and take no
       further part.
    2. Rolling-hash triggers cut the other texts into phrases, and every
       window belongs to one phrase (see phrases()).  The parse stays where
       the texts are; the dictionary, one entry for each distinct phrase of a
       batch, is dealt out by trigger.  Phrases that a smaller document holds
       are known to repeat; a trigger that only one document or one phrase
       has is done.
    3. The texts of the phrases that share a trigger with different phrases
       are dealt out by trigger once more.  A part's distinct phrases are
       sorted into a suffix array, whose order matters to the depth of a
       window only, and the occurrences of its phrases in the parse are
       merged into it, smallest document first (see _merged()).  Triggers
       with very many phrases are hot: their windows are dealt out by digest
       instead, one of each from a batch.
    4. The parse turns known phrases and windows back into spans.

    Phrases are told apart by 104 bits of hashes, hot windows by 128.  A
    trigger or a phrase that very many batches have meets in two steps (see
    _meeting()): ``meet`` batches at a time first, of which each hands on a
    phrase once, and of a hot trigger one phrase.
    """
    rows = _rows(docs)
    hashed = rows.select("doc_id", "tag", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), F.octet_length("text").cast("long").alias("size")).checkpoint()
    firsts = hashed.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("same", "first").checkpoint()
    copies = hashed.join(_near(firsts, F.lit(64)), "same").where("doc_id > first").select("doc_id", "tag", "size").checkpoint()
    spark = docs.sparkSession
    total = hashed.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 << 20)))

    own = rows.join(_near(copies.select("doc_id", "tag").distinct()), ["doc_id", "tag"], "left_anti")
    salts = _salts(total, meet)
    dealt = own.mapInArrow(_parse(window, parts, salts), _FIELDS).withColumn("part", F.when(F.col("kind") == "phrase", F.col("part")).otherwise(F.xxhash64("doc_id")))
    met = _meeting(dealt, parts, salts, _meet).checkpoint()

    still = met.where("kind = 'open'").groupBy("doc_id", "tag").agg(F.collect_list("data").alias("open")).checkpoint()
    opened = own.join(_near(still, 64 + F.aggregate("open", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))), ["doc_id", "tag"]).select("doc_id", "tag", "text", "open").mapInArrow(_open(window, 2 * parts, salts), _FIELDS)
    opened = opened.withColumn("part", F.when(F.col("kind") != "known", F.col("part")).otherwise(F.xxhash64("doc_id")))
    if salts > 1:  # windows meet by shares first; texts are dealt to whole parts
        opened = opened.repartition(2 * parts, "part", "kind").mapInArrow(_windows_meet(False, _in_smaller), _FIELDS)
        opened = opened.withColumn("part", F.when(F.col("kind") == "window", F.floor(F.col("part") / salts)).otherwise(F.col("part")))
    sorted_ = opened.repartition(2 * parts, "part").mapInArrow(_sort(window), _FIELDS)

    whole = copies.where(F.col("size") >= window).select("doc_id", "tag", F.col("size").alias("size"))
    known = met.where("kind = 'known'").select("doc_id", "tag", "data").union(sorted_.select("doc_id", "tag", "data"))
    merged = known.groupBy("doc_id", "tag").agg(F.collect_list("data").alias("data"))

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

    found = merged.mapInArrow(merge, "doc_id long, tag long, spans array<struct<start:long,end:long>>")
    all_ = whole.select("doc_id", "tag", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))).alias("spans")).distinct()
    return found.union(all_)


def _whole_characters(text: Column, spans: Column) -> Column:
    """Spans widened to the borders of the characters that they cut; those that then touch stay apart, which does no harm."""

    def inside(at: Column) -> Column:  # the byte at this place continues a character
        byte = F.substring(text, (at + 1).cast("int"), F.lit(1))
        return (byte >= F.unhex(F.lit("80"))) & (byte < F.unhex(F.lit("C0")))

    def back(at: Column) -> Column:
        return F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)

    def on(at: Column) -> Column:
        return F.when(~inside(at), at).when(~inside(at + 1), at + 1).when(~inside(at + 2), at + 2).otherwise(at + 3)

    return F.transform(spans, lambda s: F.struct(back(s["start"]).alias("start"), on(s["end"]).alias("end")))


def without_repeats(docs: DataFrame, window: int = 50, spans_column: str = "spans", kept_column: str = "kept", whole_characters: bool = False) -> DataFrame:
    """The documents, with all their columns, and spans and kept (binary, the bytes outside the spans).

    Columns of docs that have the names of these two are replaced.  With
    ``whole_characters`` a character that a span cuts in part is left out of
    kept as a whole, so that kept is UTF-8 whenever the text is.

    A null text counts as empty; a row with null doc_id stays whole and is
    not compared; equal rows are one document; rows of one doc_id with
    different texts are never compared with each other; matches never cross
    documents; a text of any length is compared whole, and it must fit in a
    worker; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, window).checkpoint()
    names = [n for n in docs.columns if n not in (spans_column, kept_column)]
    body = docs.select(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)), F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("tag"))
    joined = body.join(_near(spans, 64 + F.size("spans") * 32), ["doc_id", "tag"], "left").drop("doc_id", "tag")
    text = F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit("")).cast("binary")
    cuts = _whole_characters(text, F.col("spans")) if whole_characters else F.col("spans")
    # what lies between the spans, from the end of each (and from the start) to the next; joined as strings, whose bytes nothing checks
    zero, far = (F.struct(F.lit(x).cast("long").alias("start"), F.lit(x).cast("long").alias("end")) for x in (0, 1 << 40))
    between = F.zip_with(F.concat(F.array(zero), cuts), F.concat(cuts, F.array(far)), lambda a, b: F.struct(a["end"].alias("from"), F.least(b["start"], F.octet_length(text).cast("long")).alias("to")))
    kept = F.array_join(F.transform(between, lambda x: F.substring(text, (x["from"] + 1).cast("int"), F.greatest(x["to"] - x["from"], F.lit(0)).cast("int")).cast("string")), "").cast("binary")
    return joined.select(
        *(F.col(f"c{k}").alias(n) for k, n in enumerate(names)),
        F.coalesce("spans", F.expr("array()").cast("array<struct<start:long,end:long>>")).alias(spans_column),
        F.when(F.col("spans").isNull(), text).otherwise(kept).alias(kept_column),
    )
