"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of queries and of a block of candidates; bins of a histogram.
QUERY_ROWS, CANDIDATE_ROWS, BINS = 1024, 4096, 1024


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """id and v (array<double>, the whole numbers floor(scale * x) of each component x as double) of the rows that take part.

    Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part.  Whole numbers of any size are exact
    as doubles; a component beyond the range of doubles once scaled counts as
    the largest double.
    """
    most = F.lit(float(np.finfo(float).max))
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        scaled = F.greatest(F.least(x.cast("double") * scale, most), -most)
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled).cast("double")).otherwise(scaled)

    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite).select(F.col(id_column).cast("long").alias("id"), F.transform(vector_column, whole).alias("v"))


def _blocks(rows: DataFrame, most: int, width: int, stored: str) -> DataFrame:
    """Rows packed into blocks: ids as little-endian 64-bit integers, components as numbers of the type ``stored``; shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def block() -> pa.RecordBatch:
            data = [pa.array([np.concatenate(x).astype(t).tobytes()], pa.binary()) for x, t in ((ids, "<i8"), (parts, stored))]
            return pa.RecordBatch.from_arrays(data, ["ids", "data"])

        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            table = np.zeros((batch.num_rows, width), stored)
            table[np.arange(width) < lengths[:, None]] = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            own = batch.column("id").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(own):
                take = most - sum(map(len, ids))
                ids.append(own[at : at + take])
                parts.append(table[at : at + take])
                at += take
                if sum(map(len, ids)) == most:
                    yield block()
                    ids.clear()
                    parts.clear()
        if ids:
            yield block()

    return rows.mapInArrow(run, "ids binary, data binary")


class Scores:
    """How scores are computed and in what range they lie.

    largest and norm bound the components and the squared lengths of the
    vectors, and so (by Cauchy and Schwarz) the scores.  The narrowest type
    that holds the components is stored, and the fastest that is exact for
    all sums computes the products.  Beyond 64-bit integers products are
    exact whole numbers of any size, and scores end at the limits of a long.
    """

    def __init__(self, width: int, largest: float, norm: float):
        self.width = width
        self.stored = next((t for t, m in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31)) if largest < m), "<f8")
        bound = norm * (1 + 1e-9) + 1
        self.kind = next((k for k, m in ((np.float32, 1 << 23), (np.float64, 1 << 52), (np.int64, 1 << 62)) if bound < m and largest < m), object)
        self.least = -int(bound) - 1 if self.kind is not object else -(1 << 63)
        self.span = min(2 * -self.least + 1, 1 << 64)

    def table(self, data: bytes) -> np.ndarray:
        held = np.frombuffer(data, self.stored).reshape(-1, self.width)
        if self.kind is not object:
            return held.astype(self.kind)
        return np.array([[int(x) for x in row] for row in held.tolist()], object).reshape(held.shape)

    def of(self, queries: bytes, candidates: bytes) -> np.ndarray:
        found = self.table(queries) @ self.table(candidates).T
        if self.kind is object:
            found = np.array([[max(min(int(x), (1 << 63) - 1), -(1 << 63)) for x in row] for row in found], object).reshape(found.shape)
        return found.astype(np.int64)


class _Pair:
    """Scores of one block of queries against one block of candidates."""

    def __init__(self, row: dict, scores: Scores):
        self.queries, self.candidates = (np.frombuffer(row[k], "<i8") for k in ("q_ids", "c_ids"))
        self.scores = scores.of(row["q_data"], row["c_data"])
        self.valid = self.queries[:, None] != self.candidates[None, :]
        self.low = np.full(len(self.queries), scores.least, np.int64)
        self.above = np.zeros(len(self.queries), np.int64)
        for s in row.get("state") or ():
            self.low[s["pos"]], self.above[s["pos"]] = s["low"], s["above"]


def _histogram(scores: Scores, span: int, step: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair = _Pair(row, scores)
                # differences of longs, exact as unsigned numbers wherever they aren't negative
                beyond = pair.scores.view(np.uint64) - pair.low.view(np.uint64)[:, None]
                ok = pair.valid & (pair.scores >= pair.low[:, None]) & (beyond <= np.uint64(span - 1))
                flat = (np.arange(len(pair.low))[:, None] * BINS + (beyond // np.uint64(step)).astype(np.int64))[ok]
                counts = np.bincount(flat, minlength=len(pair.low) * BINS).reshape(-1, BINS)
                higher = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
                pos, at = np.nonzero((counts > 0) & (higher < k))  # the kth value overall isn't below a block's own
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), row["q_block"])), pa.array(pos.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[pos, at])], ["q_block", "pos", "bin", "n"])

    return run


def _select(scores: Scores, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair = _Pair(row, scores)
                pos, at = np.nonzero(pair.valid & (pair.scores > pair.low[:, None]))
                found = [(pos, at)]
                for q in np.flatnonzero(((pair.scores == pair.low[:, None]) & pair.valid).any(axis=1)).tolist():
                    tied = np.flatnonzero((pair.scores[q] == pair.low[q]) & pair.valid[q])
                    tied = tied[np.argsort(pair.candidates[tied], kind="stable")][: k - pair.above[q]]
                    found.append((np.full(len(tied), q), tied))
                pos, at = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pos), row["q_block"])), pa.array(pos.astype(np.int32)), pa.array(pair.queries[pos]), pa.array(pair.candidates[at]), pa.array(pair.scores[pos, at])],
                    ["q_block", "pos", "query_id", "vec_id", "score"],
                )

    return run


def grid(queries: int, candidates: int, tasks: int) -> tuple[int, int]:
    """Into how many groups blocks of queries and of candidates are dealt, so that their product is about ``tasks`` and few blocks move.

    Each block of queries goes to every group of candidates and the other way
    round, so the groups should be in proportion to the blocks.
    """
    rows = max(1, min(queries, round((tasks * queries / max(candidates, 1)) ** 0.5)))
    return rows, max(1, min(candidates, -(-tasks // rows)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64, tasks: int | None = None) -> DataFrame:
    """The ``k`` highest integer inner products of each query: query_id, rank (from 1), vec_id, score.

    ``is_query`` tells by the column ``id`` which rows are queries; all rows
    are candidates, but for those with the query's own id.  Ties go to the
    smaller vec_id.  Vectors are packed into blocks and every block of
    queries meets every block of candidates once a pass, in a grid of about
    ``tasks`` groups.  A pass adds up score histograms of 1,024 bins over
    each query's current interval and narrows it to the bin that holds its
    kth value, until that is exact; the last pass returns what lies above it
    and, per block, the smallest ids that equal it.  A block sends at most
    ``k`` bins or rows beyond the ties a query, so hot vectors cost no more
    than others.

    Rows with null id or vector, or with a null or non-finite component, take
    no part; scores beyond the range of a long count as its limits, and tie
    there; a query with fewer than ``k`` candidates gets all of them; a query
    row that is repeated is answered each time; vectors of different lengths
    count as filled up with zeros; other columns are not read; without rows
    the result is empty.
    """
    rows = quantized(vectors, id_column, vector_column, scale)
    zero = F.lit(0.0)
    facts = rows.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", zero, lambda a, x: F.greatest(a, F.abs(x)))).alias("largest"),
        F.max(F.aggregate("v", zero, lambda a, x: a + x * x)).alias("norm"),
    ).first()
    scores = Scores(max(facts["width"] or 1, 1), facts["largest"] or 0.0, facts["norm"] or 0.0)

    stored = _blocks(rows, CANDIDATE_ROWS, scores.width, scores.stored).checkpoint()
    asked = _blocks(rows.where(is_query), QUERY_ROWS, scores.width, scores.stored).withColumn("q_block", F.xxhash64("ids", F.monotonically_increasing_id())).checkpoint()
    q_groups, c_groups = grid(asked.count(), stored.count(), tasks or 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    candidates = stored.select(F.pmod(F.xxhash64("ids"), F.lit(c_groups)).alias("cg"), everywhere(q_groups).alias("qg"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    queries = asked.select("q_block", F.pmod("q_block", F.lit(q_groups)).alias("qg"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def pairs(state: DataFrame | None) -> DataFrame:
        held = queries if state is None else queries.join(state, "q_block", "left")
        return candidates.join(held.withColumn("cg", everywhere(c_groups)), ["qg", "cg"]).drop("qg", "cg")

    state, step = None, scores.span
    while step > 1:
        span, step = step, -(-step // BINS)
        counted = pairs(state).mapInArrow(_histogram(scores, span, step, k), "q_block long, pos int, bin int, n long")
        total = counted.groupBy("q_block", "pos", "bin").agg(F.sum("n").alias("n"))
        if state is None:
            known = total.withColumns({"low": F.lit(scores.least).cast("long"), "above": F.lit(0).cast("long")})
        else:
            known = total.join(state.select("q_block", F.explode("state").alias("s")).select("q_block", "s.pos", "s.low", "s.above"), ["q_block", "pos"])
        down = Window.partitionBy("q_block", "pos").orderBy(F.desc("bin"))
        summed = known.withColumn("upto", F.sum("n").over(down)).where(F.col("above") + F.col("upto") - F.col("n") < k)
        # the last bin that begins short of k holds the kth value; if all rows are fewer than k it is the lowest bin with any
        low = F.col("low").cast("decimal(20,0)") + F.col("bin").cast("decimal(5,0)") * F.lit(Decimal(step)).cast("decimal(20,0)")  # a long whatever the step, but its parts may not be
        chosen = summed.groupBy("q_block", "pos").agg(F.min_by(F.struct(low.cast("long").alias("low"), (F.col("above") + F.col("upto") - F.col("n")).alias("above")), "bin").alias("s"))
        state = chosen.groupBy("q_block").agg(F.collect_list(F.struct("pos", "s.low", "s.above")).alias("state")).checkpoint()
    found = pairs(state).mapInArrow(_select(scores, k), "q_block long, pos int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "pos").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
