"""Incremental loads with Structured Streaming: cursors, daily upserts and thresholds live in checkpoints and tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import qalog
from ..sources.sinks import read_table, replace_table, upsert_table, write_snapshot


def read(spark: SparkSession, path: str, schema, format: str = "parquet", files_a_batch: int | None = None, names: str | None = None) -> DataFrame:
    """A stream of the files that a folder gets, or of those whose names fit a pattern; its checkpoint is the cursor."""
    reader = spark.readStream.format(format).schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if names:
        reader = reader.option("pathGlobFilter", names)
    return reader.load(path)


def distinct_ids(stream: DataFrame, id_: str, ts: str, delay: str) -> DataFrame:
    """Each id once; ids are forgotten once the watermark is past them, so state stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_])


def windowed_counts(stream: DataFrame, ts: str, size: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("items"))


def upsert_into(stream: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Merges each batch into a table by key, the last wins; only the buckets of its keys are written, and running a batch again changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_table(batch, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since(rows: DataFrame, cursors: DataFrame, user: str, id_: str = "id") -> DataFrame:
    """Rows newer than their user's cursor (user, latest_id); users without one give all rows."""
    number = lambda c: F.col(c).try_cast("decimal(20,0)")
    return rows.join(cursors.select(user, F.col("latest_id").alias("__c")), user, "left").where(F.col("__c").isNull() | (number(id_) > number("__c"))).drop("__c")


def first_run_start(now: datetime, days: int = 30) -> datetime:
    """Where a load begins that has no cursor yet."""
    return now - timedelta(days=days)


def rotate_baseline(spark: SparkSession, latest: DataFrame, path: str, diff: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The difference to the stored baseline, which the latest rows then replace."""
    before = read_table(spark, path)
    found = diff(latest, latest.limit(0) if before is None else before).checkpoint()
    replace_table(latest, path)
    return found


def when_due(stream: DataFrame, path: str, state: str, checkpoint: str, act: Callable[[DataFrame], None], least: int = 20) -> StreamingQuery:
    """Adds log rows and calls ``act`` on the log once ``least`` rows are labelled, then again for as many new ones.

    Rows and their labelled count are stored under their batch, so a batch
    that runs again replaces what it wrote; counts add up in the state table
    and the log isn't read for them.  ``act`` runs once a batch, or again if
    a stop came between it and the note that it ran.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write_snapshot(batch.withColumn("batch", F.lit(number)), path, "batch")
        new = batch.where(qalog.label_of(F.col("label")) != qalog.UNKNOWN).count()
        upsert_table(spark.createDataFrame([(number, new, None)], "batch long, labelled long, acted_at long"), state, "batch")
        known = read_table(spark, state).where(F.col("batch") <= number)
        total = known.agg(F.sum("labelled")).first()[0]
        seen = known.where(F.col("batch") < number).agg(F.coalesce(F.max("acted_at"), F.lit(0))).first()[0]
        if total >= least and total - seen >= least:
            act(spark.read.parquet(path).where(F.col("batch") <= number).drop("batch"))
            upsert_table(spark.createDataFrame([(number, new, total)], "batch long, labelled long, acted_at long"), state, "batch")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
