"""As-of joins: the last fact of a key before a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder


def last_before(uses: DataFrame, facts: DataFrame, keys: list[str], at: str, value: str, ranges: int | None = None) -> DataFrame:
    """uses with ``value``: that of the last fact (keys, at, value) of its keys at or before its ``at``, null if there is none.

    Facts and uses are never paired: both are sorted together, facts first
    where places are equal, and each use takes the last value that went
    before.  They are sorted in ranges, which keys with very many facts or
    uses share; what a range doesn't know it takes from the ones before it,
    of which each tells one value, that of its last key.  So the cost is that
    of both sides, added.  Null keys and places find nothing; of facts at one
    place the one with the largest value counts.
    """
    spark = uses.sparkSession
    shared_folder(spark)
    known = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, at)))
    columns = [F.col(f"`{c}`") for c in uses.columns]
    told = known(facts.select(*keys, at, value)).where(F.col(value).isNotNull()).select(F.struct(*keys).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__use"), F.col(value).alias("__value"), F.lit(None).cast(uses.select(F.struct(*columns)).schema[0].dataType).alias("__row"))
    asked = known(uses).select(F.struct(*keys).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__use"), F.lit(None).cast(facts.schema[value].dataType).alias("__value"), F.struct(*columns).alias("__row"))
    order = ["__key", "__at", "__use", "__value"]
    both = told.unionByName(asked)
    both = (both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)).sortWithinPartitions(*order)
    both = both.withColumn("__place", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__place", 33)).checkpoint()
    here = Window.partitionBy("__range", "__key").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__value", F.last("__value", ignorenulls=True).over(here))
    # a row for each range: its last key, and that key's last value in it; a range that is all one key without a value hands on what it got
    ends = seen.groupBy("__range").agg(F.max_by(F.struct("__key", "__value"), "__place").alias("end"))
    on = Window.partitionBy("end.__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    handed = ends.select(F.col("__range").alias("from"), F.col("end.__key").alias("__key"), F.last("end.__value", ignorenulls=True).over(on).alias("__handed"))
    # the next range that has rows begins with that key or not at all
    following = Window.orderBy("from")  # a row for each range
    handed = handed.withColumn("__range", F.lead("from").over(following)).drop("from").where("__range IS NOT NULL AND __handed IS NOT NULL")
    asked = seen.where("__use = 1").join(handed, ["__range", "__key"], "left").select("__row.*", F.coalesce("__value", "__handed").alias(value))
    rest = uses.where(" OR ".join(f"`{c}` IS NULL" for c in (*keys, at))).withColumn(value, F.lit(None).cast(facts.schema[value].dataType))
    return asked.unionByName(rest)
