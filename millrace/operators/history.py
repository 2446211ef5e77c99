"""Who is on a list since when: validity intervals that daily snapshots are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import read_table, upsert_table

_DAYS = "{}-days"


def _last_day(spark: SparkSession, path: str, before: str | None = None) -> str | None:
    days = read_table(spark, _DAYS.format(path))
    if days is None:
        return None
    return (days.where(F.col("day") < before) if before else days).agg(F.max("day")).first()[0]


def merge_snapshot(snapshot: DataFrame, path: str, key: str, day: str) -> None:
    """Merges the snapshot of a day (yyyy-MM-dd) into the intervals (key, since, until) at ``path``.

    Only differences are written: keys that come begin an interval, those
    that are gone end theirs with the day of the snapshot before; who stays
    costs nothing, since an open interval has no end.  Earlier snapshots are
    never read again.  A day's rows may be merged once more, also after a
    stop; a day before the last one is refused.  Null keys play no part.
    """
    spark = snapshot.sparkSession
    last = _last_day(spark, path)
    if last is not None and day < last:
        raise ValueError(f"{day} is before {last}, the last snapshot merged")
    before = _last_day(spark, path, day)
    now = snapshot.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    known = read_table(spark, path)
    open_ = None if known is None else known.where("until IS NULL")
    begun = now if open_ is None else now.join(open_.select("key"), "key", "left_anti")
    changes = begun.select(F.concat_ws("\0", F.col("key").cast("string"), F.lit(day)).alias("interval"), "key", F.lit(day).alias("since"), F.lit(None).cast("string").alias("until"))
    if open_ is not None and before is not None:
        gone = open_.where(F.col("since") < day).join(now, "key", "left_anti")
        changes = changes.unionByName(gone.withColumn("until", F.lit(before)))
    upsert_table(changes, path, "interval")
    upsert_table(spark.createDataFrame([(day,)], "day string"), _DAYS.format(path), "day", buckets=1)


def intervals(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, since and until (null while it lasts) of every interval."""
    found = read_table(spark, path)
    if found is None:
        raise ValueError(f"no snapshot has been merged into {path}")
    return found.select(F.col("key").alias(key), "since", "until")


def status(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, first_seen, last_seen, status (active or unfollowed) and how often it has come (intervals)."""
    last = F.lit(_last_day(spark, path))
    return intervals(spark, path, key).groupBy(key).agg(
        F.min("since").alias("first_seen"), F.max(F.coalesce("until", last)).alias("last_seen"),
        F.when(F.count_if(F.col("until").isNull()) > 0, "active").otherwise("unfollowed").alias("status"), F.count("*").alias("intervals"),
    )
