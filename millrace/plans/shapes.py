"""Shapes of generated reports: base, agg, dim and final; latest partitions; sets of conditions; ties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_first


def latest_rows(dim: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of a dimension for each key, the last in order: joins then can't multiply facts."""
    return keep_first(dim, keys, *order, last=True)


def report(base: DataFrame, grain: Sequence[str], measures: Mapping[str, Column], dims: Sequence[tuple[DataFrame, list[str]]], final: Mapping[str, str], order: Sequence[Column] = ()) -> DataFrame:
    """Facts aggregated to a grain, joined with unique dimensions, under the final names and sorted by them alone.

    Aggregating comes first, so joins see a row for each key of the grain.
    """
    out = base.groupBy(*grain).agg(*(m.alias(n) for n, m in measures.items()))
    for dim, keys in dims:
        out = out.join(dim, keys, "left")
    out = out.select(*(F.col(c).alias(n) for n, c in final.items()))
    return out.orderBy(*order) if order else out


def latest_partition(df: DataFrame, column: str) -> DataFrame:
    """The rows with the largest value of a column: a scalar subquery, so that of a table partitioned by it only that partition is read."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def store_by(df: DataFrame, column: str, path: str) -> None:
    """Writes a table in folders by a column, each value's rows together, so that queries on it read only the folders that they need."""
    df.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def latest_stored_partition(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The rows of the largest value of the column that a stored table is partitioned by.

    That value comes from a scan of no column; it reaches the scan of the
    rows as a partition filter while the query runs, and one folder is read.
    """
    return latest_partition(spark.read.parquet(path), column)


def having_all(rows: DataFrame, key: str, conditions: Sequence[Column]) -> DataFrame:
    """Keys that meet every condition, each on some row."""
    return rows.groupBy(key).agg(F.bool_and(F.lit(True)).alias("t"), *(F.bool_or(c).alias(f"c{k}") for k, c in enumerate(conditions))).where(" AND ".join(f"c{k}" for k in range(len(conditions)))).select(key)


def having_any(rows: DataFrame, key: str, conditions: Sequence[Column]) -> DataFrame:
    """Keys that meet any condition on some row."""
    any_ = conditions[0]
    for c in conditions[1:]:
        any_ = any_ | c
    return rows.where(any_).select(key).distinct()


def with_parameters(spark: SparkSession, sql: str, **values) -> DataFrame:
    """SQL with {{name}} places, bound as parameters and never pasted into the text."""
    for name in values:
        sql = sql.replace("{{" + name + "}}", f":{name}")
    return spark.sql(sql, args=values)
