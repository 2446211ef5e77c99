"""N-gram Jaccard join with prefix filters under several global orders."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._common import lists, pieces_of, text_or_empty, trim
from ._shingles import forget, mix, shingle_sets, shingles

#: Seeds of the orders that lead to the first candidates, and of those that a pair's prefixes must also share tokens under.
STAR_SEEDS, FILTER_SEEDS = (11, 12, 13, 14), (21, 22)
#: Rows up to which a side of a join is sent to every executor.
SMALL = 1_000_000


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection that a set of n can have with a set that it links with."""
    return -(-percent * n // 100)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def count_sketch(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """How often shingles occur in the corpus, by 2**bits hash buckets, on a logarithmic scale of bytes.

    Every document counts.  Each task sends its compressed counters once, in
    slices that add up on different tasks, so the result has a fixed size.
    """
    slices = 1 << max(bits - 14, 0)
    width = (1 << bits) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for whole in batches:
            for batch in pieces_of(whole, "text", 2 << 20):
                grams, _ = shingles(batch.column("text").to_pylist(), k)
                np.add.at(total, (grams >> np.uint64(64 - bits)).astype(np.int64), 1)
        for s in range(slices):
            part = total[s * width : (s + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], ["s", "data"])
        del total
        forget()
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column("s").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), "<i8")
                sums[s] = sums[s] + part if s in sums else part
        for s, part in sums.items():
            scaled = np.minimum(np.round(8 * np.log2(part + 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([scaled.tobytes()], pa.binary())], ["s", "data"])

    found = _texts(docs).select("text").mapInArrow(count, "s int, data binary").repartition("s").mapInArrow(add, "s int, data binary")
    table = np.zeros(1 << bits, np.uint8)
    for row in found.collect():  # 2**bits bytes in all
        table[row["s"] * width : (row["s"] + 1) * width] = np.frombuffer(row["data"], np.uint8)
    return table


def signatures(docs: DataFrame, k: int, percent: int, shared: Broadcast) -> DataFrame:
    """doc_id, n, set_hash, rare, tops, prefix and filters of every document.

    prefix: the tokens of the set that come first by corpus count (then by
    value), as many as a linked set must share one of.  filters: 16 bits of
    each of the as many tokens that come first under the filter orders, one
    order after the other.  tops: the first token
    under each of the star orders.  rare: how many tokens are in the lower
    half of the counts that this set has.  shared: the table of count_sketch().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shift = np.uint64(65 - len(table).bit_length())
        for whole in batches:
            for batch in pieces_of(whole, "text", 2 << 20):
                grams, n = shingle_sets(batch.column("text").to_pylist(), k)
                ends = np.cumsum(n)
                starts = ends - n
                owner = np.repeat(np.arange(len(n)), n)
                counts = table[(grams >> shift).astype(np.int64)]
                raw = grams.astype("<u8").tobytes()
                hashes = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                order = np.argsort(owner << 8 | counts, kind="stable")  # equal counts stay in order of value
                take = np.where(n > 0, n - _needed(n, percent) + 1, 0)
                keep = np.arange(len(grams)) - starts[owner] < take[owner]
                prefix = grams[order][keep].view(np.int64)
                full = np.flatnonzero(n > 0)
                tops = np.zeros((len(n), len(STAR_SEEDS)), np.int64)
                for j, seed in enumerate(STAR_SEEDS):
                    if len(full):
                        scattered = mix(grams, seed)
                        tops[full, j] = np.minimum.reduceat(scattered, starts[full]).view(np.int64)
                filters = np.zeros((len(FILTER_SEEDS), int(take.sum())), "<u2")
                bounds = np.concatenate([[0], np.cumsum(take)])
                for j, seed in enumerate(FILTER_SEEDS):
                    scattered = mix(grams, seed)
                    for d in full.tolist():
                        filters[j, bounds[d] : bounds[d + 1]] = np.partition(scattered[starts[d] : ends[d]], take[d] - 1)[: take[d]] & np.uint64(0xFFFF)
                several = [filters[:, a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                rare = np.zeros(len(n), np.int64)
                if len(full):
                    rare[full] = np.add.reduceat((counts < 40).astype(np.int64), starts[full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(hashes, pa.binary()), pa.array(rare), lists(tops.ravel(), np.full(len(n), len(STAR_SEEDS)), pa.int64()), lists(prefix, take, pa.int64()), pa.array(several, pa.binary())],
                    ["doc_id", "n", "set_hash", "rare", "tops", "prefix", "filters"],
                )
        forget()
        trim()

    return _texts(docs).mapInArrow(run, "doc_id long, n long, set_hash binary, rare long, tops array<long>, prefix array<long>, filters binary")


def _near(df: DataFrame) -> DataFrame:
    """df, to be sent to every executor if it has few rows; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and shingles (binary, ascending) of the documents in ``ids`` (id), one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text", 2 << 20):
                grams, n = shingle_sets(batch.column("text").to_pylist(), k)
                raw, ends = grams.astype("<u8").tobytes(), (8 * np.cumsum(n)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["id", "shingles"])
        forget()
        trim()

    chosen = _texts(docs).join(_near(ids.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    return chosen.mapInArrow(run, "id long, shingles binary")


def _joined(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (a, b) with what their first (a, ...) and second documents (b, ...) have: the second meet their pairs where they are and then move to the first."""
    return second.join(_near(pairs), "b").join(first, "a")


def _meet_in_every_order(pairs: DataFrame, filters: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes fit and whose prefixes share a token under every filter order, as far as 16 bits of each token tell.

    This comes before sets move, and moves a few bytes for each document of a
    pair.  filters: id, n and filters of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for na, x, nb, y in zip(*(batch.column(c).to_pylist() for c in ("na", "fa", "nb", "fb")), strict=True):
                ok = 100 * min(na, nb) >= percent * max(na, nb)
                if ok:
                    orders = zip(np.frombuffer(x, "<u2").reshape(len(FILTER_SEEDS), -1), np.frombuffer(y, "<u2").reshape(len(FILTER_SEEDS), -1), strict=True)
                    ok = all(not set(p.tolist()).isdisjoint(q.tolist()) for p, q in orders)
                kept.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda s: filters.join(_near(pairs.select(F.col(s).alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("filters").alias(f"f{s}"))
    return _joined(pairs, side("a"), side("b")).select("a", "b", "na", "fa", "nb", "fb").mapInArrow(run, "a long, b long")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets link."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verify(docs: DataFrame, pairs: DataFrame, filters: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: those that pass the filters of every order, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                _linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    pairs = _meet_in_every_order(pairs, filters, percent).checkpoint()
    first = _sets_of(docs, pairs.select(F.col("a").alias("id")), k).select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    second = _sets_of(docs, pairs.select(F.col("b").alias("id")), k).select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return _joined(pairs, first, second).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _with_component(rows: DataFrame, id_: str, links: DataFrame) -> DataFrame:
    """rows with component: the smallest id linked with each.  Only linked ids are listed, so rows seldom have to move."""
    found = components(links).withColumnRenamed("id", id_)
    return rows.join(_near(found), id_, "left").withColumn("component", F.coalesce("component", id_))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership and links of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Membership: a row per document with doc_id, n_shingles, rep (the smallest
    doc_id with the same set) and component_id (the smallest doc_id reachable
    by links).  Links: pairs (a, b) of representatives with different sets
    that link and that together connect every component.

    1. Counts of all shingles, in hash buckets, give the first global order:
       rare tokens first.  Any order gives right results.
    2. Documents with equal sets share a representative; only those go on.
    3. Star round: documents with the same first token under one of four
       hash orders are compared with the one of them that has the fewest rare
       tokens.  This costs a pair a document and order, however large the
       group, and unites most of each group of near copies.
    4. Prefix join, which makes the result exact: two linked sets share a
       prefix token under the first order, which in the smaller of them lies
       among the first ninth of its tokens (for 80 percent).  Tokens whose
       documents are all in one component are done, and so are those that
       no document has that early; on the others, documents of different
       components that pass the length and position filters become
       candidates.
    5. In both rounds a candidate must share prefix tokens under each further
       order as well; only then do the whole sets move to be compared.

    Sets are compared by 64-bit hashes of their shingles.  A null text or one
    without words has n_shingles 0 and links with nothing; rows with null
    doc_id take no part but for their membership row, where component_id is
    null; rows that repeat a doc_id with the same text are one document each
    and share its component, different texts under one doc_id connect what
    they link with; an empty table gives empty results.
    """
    total = docs.count()
    bits = sketch_bits or int(np.clip(int(16 * max(total, 1)).bit_length(), 16, 24))
    sketch = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, k, bits))
    signed = signatures(docs, k, percent, sketch).checkpoint()
    sketch.unpersist()
    worded = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # only sets that several rows have need a join, and their list is small or, if not, stored apart so that hot sets can be split
    shared = worded.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").select("set_hash", "rep").checkpoint()
    members = worded.select("doc_id", "n", "set_hash").join(_near(shared), "set_hash", "left").select("doc_id", "n", "set_hash", F.coalesce("rep", "doc_id").alias("rep")).checkpoint()
    copies = members.where("doc_id <> rep").select("doc_id", "set_hash").distinct()
    chosen = worded.join(_near(copies), ["doc_id", "set_hash"], "left_anti").select("doc_id", "n", "rare", "tops", "prefix")
    nodes = members.select(F.col("rep").alias("doc_id")).distinct()

    filters = worded.join(_near(copies), ["doc_id", "set_hash"], "left_anti").select(F.col("doc_id").alias("id"), "n", "filters")

    tops = chosen.select("doc_id", "rare", F.posexplode("tops").alias("j", "top"))
    heads = tops.groupBy("j", "top").agg(F.min_by("doc_id", F.struct("rare", "doc_id")).alias("head"), F.count("*").alias("size")).where("size > 1")
    stars = tops.join(heads, ["j", "top"]).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct().checkpoint()
    links = _verify(docs, stars, filters, k, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()

    # the set's size and the token's place in one number: postings are most of what is shuffled
    posted = _with_component(chosen, "doc_id", links).select("doc_id", "n", "component", F.posexplode("prefix").alias("pos", "token")).select("token", "doc_id", "component", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    early = lambda n, pos: (100 + percent) * pos <= (100 - percent) * n  # noqa: E731  where the smaller of two linked sets has their first common token
    n, pos = F.shiftright("at", 32), F.col("at").bitwiseAND(2**32 - 1)
    open_ = posted.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(early(n, pos)).alias("early")).where("early AND lo <> hi").select("token")
    left = posted.join(open_, "token").checkpoint()
    left = left.select("token", "doc_id", "component", n.alias("n"), pos.alias("pos"))
    x, y = (left.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "component", "pos"))) for s in "xy")
    x = x.where(early(F.col("n_x"), F.col("pos_x")))
    least = -F.floor(-(F.lit(percent) * (F.col("n_x") + F.col("n_y"))) / (100 + percent))
    reach = 1 + F.least(F.col("n_x") - F.col("pos_x") - 1, F.col("n_y") - F.col("pos_y") - 1)
    passes = (F.col("n_x") <= F.col("n_y")) & (F.col("component_x") != F.col("component_y")) & (100 * F.col("n_x") >= percent * F.col("n_y")) & (reach >= least)
    pairs = x.join(y, (x["token"] == y["token"]) & passes).select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct().checkpoint()
    links = links.union(_verify(docs, pairs, filters, k, percent)).distinct().checkpoint()

    # a doc_id with several texts ties their representatives together
    ties = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(nodes.select(F.col("doc_id").alias("a")), "a", "left_semi")
    found = _with_component(members, "rep", links.union(ties)).select("doc_id", F.col("n").alias("n_shingles"), "rep", F.col("component").alias("component_id"))
    rest = signed.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("rep"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest), links


def keep_first(docs: DataFrame, **joining) -> DataFrame:
    """The documents, with all their columns, without those that share a component with a smaller doc_id.

    Rows with null doc_id and texts without words stay, and so do all rows
    of a document that stays; an empty table gives an empty result.
    """
    membership, _ = jaccard_join(docs, **joining)
    gone = membership.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct().checkpoint()
    return docs.join(_near(gone), "doc_id", "left_anti").select(*(F.col(f"`{n}`") for n in docs.columns))
