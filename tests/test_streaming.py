from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.schemas import QA
from millrace.sources import sinks
from millrace.streaming import incremental

SCHEMA = "id string, v long, ts timestamp"


def land(spark, path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_upserts_by_batch_equal_one_batch(spark, tmp_path):
    t = datetime(2026, 1, 1)
    batches = [[("1", 1, t), ("2", 1, t)], [("2", 2, t + timedelta(hours=1))], [("3", 1, t), ("1", 3, t + timedelta(hours=2))]]
    for rows in batches:
        land(spark, tmp_path, "x", rows)
        incremental.upsert_into(incremental.read(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/table", "id", f"{tmp_path}/check", "ts").awaitTermination()
    got = {(r.id, r.v) for r in sinks.read_table(spark, f"{tmp_path}/table").collect()}
    assert got == {("1", 3), ("2", 2), ("3", 1)}
    incremental.upsert_into(incremental.read(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/table", "id", f"{tmp_path}/check2", "ts").awaitTermination()
    assert {(r.id, r.v) for r in sinks.read_table(spark, f"{tmp_path}/table").collect()} == got


def test_distinct_ids(spark, tmp_path):
    t = datetime(2026, 1, 1)
    land(spark, tmp_path, "x", [("1", 1, t), ("1", 2, t), ("2", 1, t)])
    stream = incremental.distinct_ids(incremental.read(spark, f"{tmp_path}/in", SCHEMA), "id", "ts", "1 hour")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2"]


def test_cursor_and_baseline(spark, tmp_path):
    rows = spark.createDataFrame([("9", "a"), ("10", "a"), ("1", "b")], "id string, author_id string")
    cursors = spark.createDataFrame([("a", "9")], "author_id string, latest_id string")
    assert {r.id for r in incremental.since(rows, cursors, "author_id").collect()} == {"10", "1"}
    diff = lambda now, before: now.join(before.select("id"), "id", "left_anti")
    assert incremental.rotate_baseline(spark, rows, f"{tmp_path}/b", diff).count() == 3
    assert incremental.rotate_baseline(spark, rows.union(spark.createDataFrame([("5", "z")], rows.schema)), f"{tmp_path}/b", diff).count() == 1
    assert incremental.first_run_start(datetime(2026, 1, 31)) == datetime(2026, 1, 1)


def test_a_stop_before_the_swap_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("1", 1), ("2", 1)], "id string, v long")
    sinks.replace_table(rows, path)
    held = sinks.read_table(spark, path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        for change in (lambda: sinks.replace_table(rows.withColumn("v", F.lit(7)), path), lambda: sinks.upsert_table(rows.withColumn("v", F.lit(7)), path, "id")):
            try:
                change()
            except RuntimeError:
                pass
            assert {(r.id, r.v) for r in sinks.read_table(spark, path).collect()} == {("1", 1), ("2", 1)}
    sinks.replace_table(rows.withColumn("v", F.lit(8)), path)
    assert {r.v for r in sinks.read_table(spark, path).collect()} == {8} and held.count() == 2  # readers that had begun go on
    assert sinks.read_table(spark, f"{tmp_path}/none") is None


def test_upserts_write_only_the_buckets_of_their_keys(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(500).selectExpr("id", "id % 7 AS v")
    sinks.upsert_table(rows, path, "id")
    before = sinks.read_manifest(spark, path)
    sinks.upsert_table(spark.createDataFrame([(3, 100), (1000, 1)], "id long, v long"), path, "id")
    after = sinks.read_manifest(spark, path)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2 and set(before) <= set(after)
    got = {r.id: r.v for r in sinks.read_table(spark, path).collect()}
    assert got == {k: k % 7 for k in range(500)} | {3: 100, 1000: 1}
    sinks.upsert_table(spark.createDataFrame([(3, 100), (1000, 1)], "id long, v long"), path, "id")
    assert {r.id: r.v for r in sinks.read_table(spark, path).collect()} == got


def test_a_log_batch_that_runs_twice_counts_once(spark, tmp_path):
    """The same files from a new checkpoint: batch 0 again."""
    spark.createDataFrame([(f"{i}", "good") for i in range(25)], "id string, label string").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    for k in range(2):
        stream = incremental.read(spark, f"{tmp_path}/in", "id string, label string")
        incremental.when_due(stream, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/check{k}", lambda log: seen.append(log.count())).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 25 and set(seen) == {25}
    assert [tuple(r) for r in sinks.read_table(spark, f"{tmp_path}/state").select("batch", "labelled", "acted_at").collect()] == [(0, 25, 25)]


def test_threshold(spark, tmp_path):
    seen = []
    for k in range(3):
        spark.createDataFrame([(f"{k}-{i}", "good") for i in range(3)], "id string, label string").withColumns({f.split(" ")[0]: F.lit(None).cast(f.split(" ", 1)[1]) for f in QA.split(", ") if f.split(" ")[0] not in ("id", "label")}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.read(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        incremental.when_due(stream, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/check", lambda log: seen.append(log.count()), least=4).awaitTermination()
    assert seen == [6]


def test_two_writers_keep_both(spark, tmp_path, monkeypatch):
    """Another writer commits between what this one read and its own commit: rows of both are there, also in the same bucket."""
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v long")
    sinks.upsert_table(rows((1, 1), (2, 1), (3, 1)), path, "id", "v", buckets=2)
    commit, tried = sinks._commit, []

    def late(spark, where, version, parts):
        if not tried:
            tried.append(version)
            sinks.upsert_table(rows((2, 5), (3, 9), (10, 1), (11, 1)), path, "id", "v", buckets=2)
        else:
            tried.append(version)
        return commit(spark, where, version, parts)

    monkeypatch.setattr(sinks, "_commit", late)
    sinks.upsert_table(rows((1, 7), (3, 5), (20, 1), (21, 1)), path, "id", "v", buckets=2)
    assert tried == [2, 2, 3]  # this one's, the other's, this one's again
    got = {r.id: r.v for r in sinks.read_table(spark, path).collect()}
    assert got == {1: 7, 2: 5, 3: 5, 10: 1, 11: 1, 20: 1, 21: 1}


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/t"
    write = lambda k: sinks.upsert_table(spark.createDataFrame([(100 * k + i, k) for i in range(20)] + [(-1, k)], "id long, v long"), path, "id", "v", buckets=3)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(6)))
    got = {r.id: r.v for r in sinks.read_table(spark, path).collect()}
    assert set(got) == {100 * k + i for k in range(6) for i in range(20)} | {-1} and got[5] == 0
    assert sinks.read_version(spark, path)[0] == 6


def test_two_replacements_and_what_is_left_behind(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = lambda v: spark.createDataFrame([(1, v)], "id long, v long")
    commit, tried = sinks._commit, []
    monkeypatch.setattr(sinks, "_commit", lambda *a: (tried or (tried.append(1), sinks.replace_table(rows(1), path))) and commit(*a))
    sinks.replace_table(rows(2), path)
    assert sinks.read_version(spark, path)[0] == 2 and sinks.read_table(spark, path).first().v == 2
    monkeypatch.setattr(sinks, "_commit", commit)
    rows(9).write.parquet(f"{path}/data-lost")  # of a writer that stopped, or is still at work
    sinks.replace_table(rows(3), path)
    sinks.replace_table(rows(4), path)
    folders = {p.name for p in tmp_path.joinpath("t").iterdir() if p.name.startswith("data-")}
    assert "data-lost" in folders and len(folders) == 3 and sinks.vacuum(spark, path) == []
    assert sinks.vacuum(spark, path, hours=-1) == ["data-lost"] and sinks.read_table(spark, path).first().v == 4
