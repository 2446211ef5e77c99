import time

import pytest
from pyspark.sql import functions as F

from millrace.streaming import incremental, stateful


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, path, schema, work, files=None):
    """What has landed since the last run, from the checkpoint."""
    stream = work(incremental.read(spark, f"{path}/in", schema, files_a_batch=files))
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{path}/out").collect())


def test_cursors_survive_a_restart(spark, tmp_path):
    schema = "user string, id string, created string"
    work = lambda s: stateful.newer_than_cursors(s, "user", "id", "created")
    land(spark, tmp_path, [("a", "9", "2026-01-02"), ("a", "10", "2026-01-03"), ("b", "5", None), (None, "1", "x"), ("a", "no number", "z")], schema)
    first = [("a", "10", "2026-01-03"), ("a", "9", "2026-01-02"), ("b", "5", None)]
    assert run(spark, tmp_path, schema, work) == sorted(first, key=lambda r: r[:2])
    # a's cursor is 10; 30 is its newest by time, so that 20 goes by in the third batch though it wasn't there before
    land(spark, tmp_path, [("a", "9", "2026-01-02"), ("a", "30", "2026-01-05"), ("b", "4", "x"), ("c", "1", "")], schema)
    second = [("a", "30", "2026-01-05"), ("c", "1", "")]
    assert run(spark, tmp_path, schema, work) == sorted(first + second, key=lambda r: r[:2])
    land(spark, tmp_path, [("a", "20", "2026-01-04"), ("a", "31", "2026-01-01"), ("b", "6", "x")], schema)
    third = [("a", "31", "2026-01-01"), ("b", "6", "x")]
    assert run(spark, tmp_path, schema, work) == sorted(first + second + third, key=lambda r: r[:2])


def test_listings_end_at_the_known_id(spark, tmp_path):
    schema = "list string, listing int, place int, id string"
    work = lambda s: stateful.until_known(s, "list", "listing", "place", "id")
    listing = lambda name, k, ids: [(name, k, p, i) for p, i in enumerate(ids)]
    land(spark, tmp_path, listing("x", 1, "cba") + listing("y", 1, "c") + [(None, 1, 0, "z"), ("x", 1, 9, None)], schema)
    first = listing("x", 1, "cba") + listing("y", 1, "c")
    assert run(spark, tmp_path, schema, work) == sorted(first)
    # x has two more, then one more in the same batch; the row that y knows is gone
    land(spark, tmp_path, listing("x", 2, "edcba") + listing("x", 3, "fedcba") + listing("y", 2, "dba"), schema)
    second = listing("x", 2, "ed") + listing("x", 3, "f") + listing("y", 2, "dba")
    assert run(spark, tmp_path, schema, work) == sorted(first + second)


@pytest.mark.parametrize("files", [1, None])
def test_marks_do_not_depend_on_batches(spark, tmp_path, files):
    schema = "log string, label string"
    work = lambda s: stateful.due_marks(s, "log", "label", least=4)
    for _ in range(3):
        land(spark, tmp_path, [("a", "good"), ("a", " BAD_case "), ("a", "good"), ("a", "what"), ("b", "good"), (None, "good")], schema)
    want = [("a", 4, False), ("a", 8, False)]
    assert run(spark, tmp_path, schema, work, files) == want
    land(spark, tmp_path, [("a", "good")] * 8 + [("b", "bad")], schema)
    assert run(spark, tmp_path, schema, work, files) == [*want, ("a", 12, False), ("a", 16, False), ("b", 4, False)]


def test_rows_that_wait_are_told_by_a_timer(spark, tmp_path):
    schema = "log string, label string"
    land(spark, tmp_path, [("a", "good")] * 5, schema)
    stream = stateful.due_marks(incremental.read(spark, f"{tmp_path}/in", schema), "log", "label", least=4, patience_ms=1000)
    query = stream.writeStream.format("memory").queryName("waiting").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 60
        while spark.table("waiting").where(F.col("waited")).count() == 0 and time.time() < deadline:
            time.sleep(0.5)
        assert sorted(tuple(r) for r in spark.table("waiting").collect()) == [("a", 4, False), ("a", 5, True)]
    finally:
        query.stop()
