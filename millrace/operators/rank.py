"""Ranking, thread positions and capped selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows with rank (from 1): a top-k per partition, then one over at most n rows of each."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows


def capped(df: DataFrame, group: str, group_order: str, per_group: int, total: int, *order: Column) -> DataFrame:
    """At most ``per_group`` rows of each group and ``total`` in all, taken in order of the groups.

    The limit per group comes before the one over all, so the last step sees
    at most groups * per_group rows.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    few = df.withColumn("group_rank", rank).where(F.col("group_rank") <= per_group)
    place = F.row_number().over(Window.orderBy(group_order, "group_rank"))
    return few.withColumn("place", place).where(F.col("place") <= total)


#: Rows up to which a table of groups and ranges is sent to every executor.
SMALL = 100_000


def _same(groups: list[str]) -> Column:
    """Whether a row's groups, nulls among them, are those of the other side, which has them as __0, __1 and so on."""
    same = F.lit(True)
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__{k}"))
    return same


def places_by_range(df: DataFrame, groups: list[str], *order: Column | str, place: str = "place") -> DataFrame:
    """Adds the place (long, from 0) of each row in its group by ``order``, without a task that holds a group.

    Rows are sorted into ranges by group and order and stored; a row's place
    is its place in its range plus the rows of its group in earlier ranges,
    which a table with a row for each group and range tells.  Rows that are
    equal by ``order`` stay in one range.  Nulls are a group like any other.
    """
    shared_folder(df.sparkSession)
    keys = [F.col(g) for g in groups]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    own = F.shiftright("__at", 33)  # the upper bits of such an id are the range
    runs = ranged.groupBy(*(k.alias(f"__{i}") for i, k in enumerate(keys)), own.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*(f"__{i}" for i in range(len(keys)))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(f"__{i}" for i in range(len(keys))), "__part", (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__offset")).checkpoint()
    near = F.broadcast(runs) if runs.count() <= SMALL else runs  # else rows move once more, to the entries of their ranges
    found = ranged.join(near, _same(groups) & (own == F.col("__part")))
    return found.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__at") + F.col("__offset")).alias(place))


def places(df: DataFrame, groups: list[str], *order: Column | str, place: str = "place", size: str | None = None, most: int = 100_000) -> DataFrame:
    """Adds the place (long, from 0) of each row in its group by ``order``, and under ``size`` the group's rows.

    Groups of up to ``most`` rows are sorted in windows, the others, of which
    there are at most rows / most, by ranges (see places_by_range()), so that
    no task sorts more than ``most`` rows of a group.  Both give the same.
    """
    shared_folder(df.sparkSession)
    whole = Window.partitionBy(*(F.col(g) for g in groups))
    window = lambda x: x.withColumns({place: F.row_number().over(whole.orderBy(*order)).cast("long") - 1} | ({size: F.count("*").over(whole)} if size else {}))
    large = df.groupBy(*(F.col(g).alias(f"__{k}") for k, g in enumerate(groups))).agg(F.count("*").alias("__n")).where(F.col("__n") > most).checkpoint()
    if large.isEmpty():
        return window(df)
    names = [F.col(f"`{c}`") for c in df.columns]
    ranged = places_by_range(df.join(large, _same(groups)).select(*names, *([F.col("__n").alias(size)] if size else [])), groups, *order, place=place)
    return window(df.join(large, _same(groups), "left_anti")).unionByName(ranged)


def thread_positions(df: DataFrame, conversation: str, created: str, seq: str, most: int = 100_000) -> DataFrame:
    """Adds thread_position (int): the place by time, then seq, in a conversation of two rows or more, else null.

    A conversation may be larger than a task: beyond ``most`` rows its places
    come from ranges with prefix counts, see places().
    """
    known = places(df.where(F.col(conversation).isNotNull()), [conversation], created, seq, place="thread_position", size="__size", most=most)
    placed_ = known.withColumn("thread_position", F.when(F.col("__size") > 1, F.col("thread_position") + 1).cast("int")).drop("__size")
    return placed_.unionByName(df.where(F.col(conversation).isNull()).withColumn("thread_position", F.lit(None).cast("int")))


def ties(df: DataFrame, n: int, group: str, value: str, policy: str, *breakers: Column) -> DataFrame:
    """The first n of each group by value, largest first; ties by row_number (one row a place), rank or dense_rank."""
    over = Window.partitionBy(group).orderBy(F.desc(value), *(breakers if policy == "row_number" else ()))
    return df.withColumn("place", getattr(F, policy)().over(over)).where(F.col("place") <= n)


def by_followers(users: DataFrame, followers: str = "followers_count", key: str = "id") -> DataFrame:
    """Users by followers, most first; unknown counts are 0."""
    return users.orderBy(F.desc(F.coalesce(followers, F.lit(0))), key)


def newest_first(posts: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    """Posts by time as text, newest first; those without a time come last."""
    return posts.orderBy(F.desc(F.coalesce(created, F.lit(""))), key)


def placed(sorted_: DataFrame, n: int) -> DataFrame:
    """The first n rows of a sorted table with place (from 1)."""
    return sorted_.limit(n).withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")))  # n rows


def by_layer(catalog: DataFrame) -> DataFrame:
    """Entries of a catalog in order of layer and name."""
    return catalog.orderBy("layer", "name")


def stop_after(rounds: DataFrame, *scan: str, enough: int = 100, fair: int = 50, idle: int = 5, lost: int = 10) -> DataFrame:
    """The rounds of page scans (``scan``, round, found) up to the one after which each stops, with the rows so far and the rounds without any in a row.

    A scan stops with ``enough`` rows, with a ``fair`` number after ``idle``
    empty rounds in a row, or after ``lost`` empty rounds.  A scan's rounds
    are few; windows are over those of one scan.  Rounds are numbered, with
    gaps where a scan has left some out, which don't count as empty.
    """
    own = Window.partitionBy(*scan).orderBy("round")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    told = rounds.withColumn("__place", F.row_number().over(own)).withColumn("total", F.sum("found").over(so_far)).withColumn("__last", F.max(F.when(F.col("found") > 0, F.col("__place"))).over(so_far))
    told = told.withColumn("idle", (F.col("__place") - F.coalesce("__last", F.lit(0))).cast("long"))
    stops = (F.col("total") >= enough) | (F.col("total") >= fair) & (F.col("idle") >= idle) | (F.col("idle") >= lost)
    before = F.max(F.when(stops, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return told.withColumn("__before", before).where(F.coalesce("__before", F.lit(0)) == 0).select(*scan, "round", "found", "total", "idle")
