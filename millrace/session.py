"""Where a session may put what several steps share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, else that which the cluster names, else, on one machine only, a local one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            shared = f"/tmp/millrace-checkpoints-{os.getpid()}"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    return f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once and written below the shared folder, from where several steps read the columns that they need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tasks for each core, so that none waits long for the last one.
TASKS = 4


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out to a few tasks for each core if it has fewer parts.

    A part of a scan is a row group at least, and columns of numbers pack so
    well that a million rows may be one; where each row is much work, that
    work must not stay in the task that reads them.  Choose the columns first,
    since they are what is sent.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= 2 * cores else scan.repartition(TASKS * cores)
