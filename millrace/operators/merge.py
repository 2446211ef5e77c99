"""Snapshots, upserts, differences and set algebra of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.posts import username_key


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of both by key, the last wins: changes over base, and within each the largest ``order``.

    An aggregation by key, so it is idempotent and needs no sort.
    """
    rank = F.col(order) if order else F.lit(0)
    both = base.select(F.struct(F.lit(0), rank).alias("o"), *base.columns).unionByName(changes.select(F.struct(F.lit(1), rank).alias("o"), *base.columns))
    return both.groupBy(key).agg(F.max_by(F.struct(*base.columns), "o").alias("r")).select("r.*")


def insert_absent(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base and those rows whose key it lacks."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti").select(base.columns))


def added(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return current.join(previous.select(key), key, "left_anti").select(current.columns)


def removed(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return added(previous, current, key)


def new_follows(latest: DataFrame, baseline: DataFrame, excluded: DataFrame) -> DataFrame:
    """Users of the latest snapshot that neither the baseline nor the excluded names hold."""
    fresh = added(latest, baseline, "id").withColumn("__name", username_key(F.col("username")))
    return fresh.join(excluded.select(username_key(F.col("username")).alias("__name")), "__name", "left_anti").select(latest.columns)


def distinct_ids(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The ids of two lists, each once."""
    return first.select(key).union(second.select(key)).distinct()


def tag_sources(first: DataFrame, second: DataFrame, key: str, names: tuple[str, str], both: str = "both") -> DataFrame:
    """key and source: which of two tables hold it, or ``both``; a key that the second repeats counts as both."""
    rows = first.select(key).distinct().select(key, F.lit(0).alias("w"), F.lit(1).alias("n")).unionByName(second.select(key, F.lit(1).alias("w"), F.lit(1).alias("n")))
    facts = rows.groupBy(key).agg(F.count_if(F.col("w") == 0).alias("a"), F.count_if(F.col("w") == 1).alias("b"))
    return facts.select(key, F.when((F.col("a") > 0) & (F.col("b") > 0) | (F.col("b") > 1), both).when(F.col("a") > 0, names[0]).otherwise(names[1]).alias("source"))


def status_over_snapshots(snapshots: DataFrame, key: str, day: str) -> DataFrame:
    """key, first_seen, last_seen and status: active if the last snapshot holds it, else unfollowed."""
    last = snapshots.agg(F.max(day).alias("last"))
    seen = snapshots.groupBy(key).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))
    return seen.crossJoin(F.broadcast(last)).select(key, "first_seen", "last_seen", F.when(F.col("last_seen") == F.col("last"), "active").otherwise("unfollowed").alias("status"))  # one row


def changed_fields(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """after with change: new, or changed and in which columns; rows that stayed the same are left out.  Nulls equal nulls."""
    names = [c for c in after.columns if c != key]
    old = before.select(key, F.struct(*names).alias("__old"))
    differs = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__old.{c}")), F.lit(c)) for c in names)))
    both = after.join(old, key, "left").withColumn("changed", F.when(F.col("__old").isNotNull(), differs))
    return both.withColumn("change", F.when(F.col("__old").isNull(), "new").otherwise("changed")).where(F.col("__old").isNull() | (F.size("changed") > 0)).drop("__old")


def users_with_posts(users: DataFrame, posts: DataFrame, user: str, post: str, created: str) -> DataFrame:
    """Users with posts, in their order: seq, their number of posts and the newest one's id."""
    own = posts.groupBy(F.col(user).alias("id")).agg(F.count("*").alias("posts"), F.max_by(post, F.struct(F.coalesce(created, F.lit("")), post)).alias("latest_id"))
    return users.join(own, "id").orderBy("seq")


def previous_snapshot(snapshots: DataFrame, day: str, current) -> DataFrame:
    """The rows of the latest snapshot that isn't the current one."""
    before = snapshots.where(F.col(day) != F.lit(current))
    return before.join(F.broadcast(before.agg(F.max(day).alias(day))), day, "left_semi")  # one row


def curate(tracked: DataFrame, pending: DataFrame, include: DataFrame, exclude: DataFrame, approve: DataFrame | None = None, reject: DataFrame | None = None, add: DataFrame | None = None, remove: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four lists of usernames after approving and rejecting pending names and adding and removing tracked ones.

    Approved and added names are tracked and included; rejected and removed
    ones are excluded and neither tracked nor pending nor included.  Names
    compare without case and a leading @.
    """
    none = tracked.select("username").limit(0)
    key = lambda df: (df if df is not None else none).select(username_key(F.col("username")).alias("username")).distinct()
    pending_, yes = key(pending), key(approve).join(key(pending), "username", "left_semi").union(key(add)).distinct()
    no = key(reject).join(pending_, "username", "left_semi").union(key(remove)).distinct()
    without = lambda df, gone: df.join(gone, "username", "left_anti")
    return {
        "tracked": without(key(tracked).union(yes).distinct(), no),
        "pending": without(without(pending_, yes), no),
        "include": without(key(include).union(yes).distinct(), no),
        "exclude": without(key(exclude), yes).union(no).distinct(),
    }


def tag_curated(tracked: DataFrame, include: DataFrame) -> DataFrame:
    """tracked with origin: manual for included names, else auto."""
    names = include.select(username_key(F.col("username")).alias("__k")).distinct().withColumn("__m", F.lit(True))
    return tracked.withColumn("__k", username_key(F.col("username"))).join(names, "__k", "left").withColumn("origin", F.when(F.col("__m"), "manual").otherwise("auto")).drop("__k", "__m")


def rebuild(ids: DataFrame, enriched: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """enriched rows of the ids; with defaults, ids without a row stay and take these values."""
    if defaults is None:
        return enriched.join(ids.select(key).distinct(), key, "left_semi")
    found = ids.select(key).distinct().join(enriched, key, "left")
    return found.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in found.columns))
