import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import history
from millrace.plans import catalog, searchindex, shapes
from millrace.sources import paged


def test_search_many_equals_search(spark):
    rng = random.Random(2)
    words = ["订单", "user", "id", "dt", "pay_order", "shop", "x1", "123", "编号"]
    rows = []
    for k in range(60):
        column = lambda: (rng.choice(words), "STRING", rng.choice([*words, "", None]))
        rows.append((rng.choice([*catalog.LAYERS, "DIM"]), f"{rng.choice(words)}.t_{k}", rng.choice([*words, None]), rng.choice([*words, ""]), [column() for _ in range(rng.randint(0, 4))], [column() for _ in range(rng.randint(0, 1))], [f"/a/{rng.choice(words)}{k}.sql"], []))
    column = "array<struct<name:string,type:string,comment:string>>"
    entries = spark.createDataFrame(rows, f"layer string, name string, description string, table_comment string, columns {column}, partition_columns {column}, sql_files array<string>, doc_files array<string>")
    asked = ["订单 pay_order", "USER id dt", "nothing at all", "", "１２３ 编号 x1", "统计", "t_1 shop", None]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    index = searchindex.postings(searchindex.field_texts(entries))
    for n in (3, 20):
        got = {}
        for r in searchindex.search_many(index, entries, questions, n).orderBy("question_id", "place").collect():
            got.setdefault(r.question_id, []).append((r.layer, r.name, r.score))
        for k, q in enumerate(asked):
            assert got.get(k, []) == [tuple(r) for r in catalog.search(entries, q or "", n).collect()], q


def test_only_texts_with_a_words_rarest_gram_are_looked_at(spark):
    texts = spark.createDataFrame([("DWD", f"t{k}", "name", f"common words of all tables {'zebra' if k == 7 else k}") for k in range(200)], "layer string, name string, field string, text string")
    index = searchindex.postings(texts)
    assert index.where("gram = 'eb'").count() == 1 and index.where("gram = 'co'").count() == 200
    entries = texts.select("layer", "name")
    found = searchindex.search_many(index, entries, spark.createDataFrame([(1, "zebra zebras of")], "question_id int, question string"), prefer=()).collect()
    assert [(r.name, r.score) for r in found] == [("t7", 5.0)]


def test_history_of_snapshots(spark, tmp_path):
    days = {"2026-01-01": [1, 2, None], "2026-01-02": [2, 3, 3], "2026-01-05": [1, 2], "2026-01-06": [], "2026-01-07": [2, 4]}
    path = f"{tmp_path}/h"
    merge = lambda day: history.merge_snapshot(spark.createDataFrame([(u, "x") for u in days[day]], "u long, key string"), path, "u", day)
    for day in days:
        merge(day)
        merge(day)  # once more changes nothing
    got = {tuple(r) for r in history.intervals(spark, path, "u").collect()}
    assert got == {(1, "2026-01-01", "2026-01-01"), (2, "2026-01-01", "2026-01-05"), (3, "2026-01-02", "2026-01-02"), (1, "2026-01-05", "2026-01-05"), (2, "2026-01-07", None), (4, "2026-01-07", None)}
    status = {r.u: (r.first_seen, r.last_seen, r.status, r.intervals) for r in history.status(spark, path, "u").collect()}
    assert status == {1: ("2026-01-01", "2026-01-05", "unfollowed", 2), 2: ("2026-01-01", "2026-01-07", "active", 2), 3: ("2026-01-02", "2026-01-02", "unfollowed", 1), 4: ("2026-01-07", "2026-01-07", "active", 1)}
    with pytest.raises(ValueError):
        merge("2026-01-01")


def test_pages(spark, tmp_path):
    for k, body in enumerate(('{"data": [{"id": 1}, {"id": 2}], "includes": {"users": [{"u": 1}], "media": []}}', "no json", '{"data": [{"id": 3}], "meta": {"next_token": null}}', "[]", '{"data": [{"id": 4}]}')):
        (tmp_path / f"page-{k:03d}.json").write_text(body)
    (tmp_path / "_SUCCESS").write_text("")
    found = paged.pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in found.orderBy("page", "kind", "place").collect()] == [(0, "data", 0, '{"id": 1}'), (0, "data", 1, '{"id": 2}'), (0, "users", 0, '{"u": 1}'), (1, "error", 0, "no json"), (2, "data", 0, '{"id": 3}'), (3, "error", 0, "[]"), (4, "data", 0, '{"id": 4}')]
    assert [(r.seq, r.value) for r in paged.listing(found, 3).orderBy("seq").collect()] == [(0, '{"id": 1}'), (1, '{"id": 2}'), (2, '{"id": 3}')]


def test_pages_as_a_stream_from_its_checkpoint(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for k in range(5):
        (root / f"p{k}.json").write_text(f'{{"data": [{{"id": {k}}}]}}')
        if k in (1, 4):
            query = paged.page_stream(spark, str(root)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(once=True).start()
            query.awaitTermination()
            assert sorted(r.page for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(k + 1))


def test_the_latest_partition_is_the_only_one_read(spark, tmp_path):
    shapes.store_by(spark.range(1000).withColumn("dt", F.format_string("d%02d", F.col("id") % 20)), "dt", f"{tmp_path}/t")
    found = shapes.latest_stored_partition(spark, f"{tmp_path}/t", "dt").select("id", F.lower("dt"))
    assert len(found.collect()) == 50
    plan = found._jdf.queryExecution().executedPlan()
    while plan.nodeName() in ("AdaptiveSparkPlan", "ResultQueryStage"):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.size())]
    assert [s.metrics().apply("numPartitions").value() for s in scans] == [1], plan.toString()
