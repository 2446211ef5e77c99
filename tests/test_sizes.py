"""What only shows on longer texts and larger tables."""

from pyspark.sql import functions as F

from millrace import session
from millrace.functions import sqltext
from millrace.operators import dedupe
from millrace.plans import catalog, sqlcheck
from millrace.sources import paged, sinks


def test_bookmark_texts_stay_whole(spark):
    long = "ä🙂 " * 1500
    posts = spark.createDataFrame([("1", long, "u"), ("2", None, "u")], "id string, text string, username string").select(
        "*", F.lit(None).cast("string").alias("full_text"), F.lit(None).cast("struct<text:string>").alias("note_tweet"), F.lit(None).cast("struct<media_keys:array<string>>").alias("attachments"),
        F.lit(None).cast("struct<like_count:long,retweet_count:long,reply_count:long,impression_count:long>").alias("public_metrics"),
    )
    assert {r.id: r.text for r in sinks.bookmark_rows(posts).collect()} == {"1": long, "2": ""}
    assert {r.id: len(r.text) for r in sinks.bookmark_rows(posts, 2000).collect()} == {"1": 2000, "2": 0}


def test_texts_of_a_catalog_are_scanned_once(spark, tmp_path):
    scanned = spark.sparkContext.accumulator(0)

    def told(frames):
        for frame in frames:
            scanned.add(len(frame))
            yield frame

    files = [(f"/dw/01-ADS/{k}.sql", f"CREATE TABLE ads.t_{k} (id INT)") for k in range(40)] + [(f"/dw/01-ADS/{k}_fill.sql", f"INSERT INTO TABLE t_{k} SELECT id FROM s") for k in range(40)]
    entries = catalog.build(spark.createDataFrame(files, "path string, text string").mapInPandas(told, "path string, text string"))
    assert entries.count() == 40 and {r.name for r in entries.collect()} == {f"ads.t_{k}" for k in range(40)}
    assert scanned.value == 80


def test_a_small_file_is_worked_on_in_several_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    scan = spark.read.parquet(f"{tmp_path}/one.parquet")
    assert scan.rdd.getNumPartitions() == 1 and session.spread(scan).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in session.spread(scan).collect()) == list(range(1000))


def test_sets_that_only_share_rare_tokens_do_not_travel(spark, monkeypatch):
    import random

    rng, handed, alike = random.Random(4), [], dedupe._alike
    words = ["".join(rng.sample("abcdefghijklmnopqrst", 6)) for _ in range(400)]
    titles = [rng.sample(words, 60) for _ in range(120)]
    for k in range(0, 40, 2):  # near copies, just like enough and just not
        titles[k + 1] = titles[k][: 57 - k % 4 // 2] + rng.sample([w for w in words if w not in titles[k]], 3)
    sets = [frozenset(t) for t in titles]
    want = {(a, b) for b in range(120) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9}
    monkeypatch.setattr(dedupe, "_alike", lambda pairs, *rest: handed.append(pairs.count()) or alike(pairs, *rest))
    found = dedupe.similar_title_pairs(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(titles)], "id long, t string"), "id", "t", 0.9)
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) == 10
    assert handed[0] <= 30


def test_sql_texts_are_scanned_once_for_all_dialects(spark, monkeypatch):
    from collections import Counter

    texts = [("p", "SELECT `a`::int FROM t ORDER BY 1"), ("q", "-- none\nSELECT a, explode(b) FROM t"), ("r", None)]
    scanned = spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame(texts, "path string, sql string").mapInPandas(lambda frames: ((scanned.add(len(f)), f)[1] for f in frames), "path string, sql string")
    found = sqlcheck.check_dialects(frame, sqlcheck.DIALECTS).collect()
    want = Counter((d, p, c) for d in sqlcheck.DIALECTS for p, s in texts for c in sqlcheck.text_codes(s or "", d)[0])
    assert Counter((r.dialect, r.path, r.code) for r in found) == want and len(want) == 7 and scanned.value == 3


def test_very_many_pages_are_fewer_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"p{k:03d}.json").write_text(f'{{"data": [{{"id": {k}}}]}}')
    found = paged.pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 60
    assert [tuple(r) for r in found.orderBy("page").collect()] == [(k, "data", 0, f'{{"id": {k}}}') for k in range(300)]
    assert [r.number for r in paged._runs([("p", 5 << 20)] * 70, 3)] == list(range(3, 73))


def test_entries_of_a_catalog_are_brought_together_once(spark):
    files = [(f"/dw/01-ADS/{k}.sql", f"CREATE TABLE ads.t_{k} (id INT)") for k in range(9)] + [(f"/dw/01-ADS/{k}_fill.sql", f"INSERT INTO TABLE t_{k} SELECT id FROM s") for k in range(9)] + [("/dw/x/1.sql", "CREATE TABLE x.t_1 (id INT)")]
    files = spark.createDataFrame(files, "path string, text string")
    assert catalog.extract(files, keep_unknown=False).count() == 18 and catalog.extract(files).count() == 19
    made = catalog.build(files)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.name, tuple(r.sql_files), tuple(r.signals.source_tables)) for r in made.collect()} == {(f"ads.t_{k}", (f"/dw/01-ADS/{k}.sql", f"/dw/01-ADS/{k}_fill.sql"), ("s",)) for k in range(9)}


def test_names_with_very_many_entries_are_qualified_in_ranges(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["ADS", "ODS"]), rng.choice(["hot", "hot", "hot", "a", "b"]), f"/p{rng.randint(0, 60):02d}", rng.choice(["", "", "x.", "y.", "Z."]), rng.random() < 0.7) for _ in range(400)]
    entries = spark.createDataFrame([(k, layer, path, whole + short, [("id", "", "")] if whole and told else []) for k, (layer, short, path, whole, told) in enumerate(rows)], "id int, layer string, path string, name string, columns array<struct<name:string,type:string,comment:string>>")
    want = {}
    for k, (layer, short, path, whole, _) in enumerate(rows):
        before = [(p, w + s) for la, s, p, w, told in rows if w and told and (la, s) == (layer, short) and p <= path]
        want[k] = whole + short if whole or not before else max(before)[1]
    for most in (0, 60, 100_000):  # all, some and none in ranges
        assert {r.id: r.name for r in catalog.qualify(entries, most).collect()} == want, most


def test_tokens_are_held_by_columns():
    sql = "SELECT 'a--b', `x y` /* ' */ FROM t.a -- FROM b\nWHERE c::int = '\\'' AND (d > \"e\") GROUP BY  f ,g) '"
    found = sqltext.tokens(sql)
    assert found.texts == ["SELECT", "'a--b'", ",", "`x y`", "FROM", "t.a", "WHERE", "c", "::", "int", "=", "'\\''", "AND", "(", "d", ">", '"e"', ")", "GROUP", "BY", "f", ",", "g", ")", "'"]
    assert [found.kind(k) for k in (0, 1, 2, 3, 8, 11, 16, 24)] == ["word", "text", "sign", "name", "sign", "text", "name", "text"]
    assert found.places["from"] == [4] and found.depths == [0] * 14 + [1] * 3 + [0] * 8
    assert [sql[a:b] for a, b in found.spans] == found.texts and found.between([20, 21, 22]) == "f ,g"
    assert sqltext.without_comments(sql) == sql.replace("/* ' */", " ").replace("-- FROM b", " ")
    assert sqltext.tokens(" \n").texts == [] and sqltext.tokens("'\\").texts == ["'", "\\"] and sqltext.tokens("'\\").kind(0) == "sign"


def test_what_isnt_asked_for_isnt_scanned_for(spark, monkeypatch):
    from millrace.functions import sqltext as scanner

    paths = [f"{a}{layer}{z}" for a in ("", "/", "x", "x_", "/ads_x/", "/y\n", "/0") for layer in ("ADS", "dwd", "Ods", "dim", "adsx") for z in ("", "/", "x", "_1/DWS/", ".sql", "\n")]
    split = F.transform(F.split("p", "/"), lambda p: F.upper(F.regexp_extract(p, rf"(?i)(?:^|[^a-zA-Z])({'|'.join(catalog.LAYERS)})(?:$|[^a-zA-Z])", 1)))
    by_part = F.coalesce(F.try_element_at(F.filter(split, lambda p: p != ""), F.lit(1)), F.lit("UNKNOWN"))
    assert spark.createDataFrame([(p,) for p in [*paths, None]], "p string").where(catalog.layer_of(F.col("p")) != by_part).count() == 0
    files = spark.createDataFrame([(f"/dw/{layer}/{k}.sql", f"INSERT INTO TABLE {layer}.t_{k} SELECT DISTINCT id FROM s_{k}") for layer in ("ADS", "ODS", "DIM") for k in range(3)], "path string, text string")
    assert {r.layer for r in catalog.extract(files, layers=["ODS"]).collect()} == {"ODS"}
    whole, part = catalog.build(files), catalog.build(files, layers=["ODS"], signals=False)
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.where("layer = 'ODS'").drop("signals").collect())) and "signals" not in part.columns
    monkeypatch.setattr(scanner, "signals", None)  # isn't called
    assert catalog._found_in("/dw/ODS/a.sql", "ODS", "INSERT INTO TABLE t SELECT 1", signals=False)[0][2] == "t"


def test_what_names_no_table_isnt_scanned(monkeypatch):
    import random

    rng = random.Random(8)
    pieces = ["CREATE TABLE ", "create", "Table ", "if not exists ", "INSERT INTO TABLE ", "insert overwrite table ", "insert ", "İnsert ", "overwrite ", "INTO ", "a.b", " t ", " . ", "`x y`", "'s'", "'", "`", "(", ")", ",", ";", "=", "::", "-- c\n", "/*", "*/", "\n", "x.insert", "1insert", "$", "\\", "select * from "]
    told = 0
    for text in ("".join(rng.choice(pieces) for _ in range(rng.randint(0, 24))) for _ in range(20_000)):
        few, all_ = sqltext.naming_tokens(text), sqltext.tokens(text)
        named = sqltext.inserted_tables(all_)
        told += bool(named)
        assert few.texts == all_.texts[: len(few)]
        assert (sqltext.created_tables(few), sqltext.inserted_tables(few)) == (sqltext.created_tables(all_), named), text
    assert told > 100
    fill = "-- fills\nINSERT OVERWRITE TABLE a . b SELECT id, v FROM s WHERE d = 'x';"
    assert sqltext.naming_tokens(fill).texts == ["INSERT", "OVERWRITE", "TABLE", "a", ".", "b", "SELECT", "id", ","]
    assert sqltext.naming_tokens("# a text of words (only)").texts == [] and len(sqltext.naming_tokens(f"{fill} CREATE TABLE c (d INT)")) > 20
    monkeypatch.setattr(sqltext, "tokens", None)  # isn't called
    assert [catalog._found_in(f"/dw/ODS/{name}", "ODS", text, signals)[0][2] for name, text, signals in (("x.sql", fill, False), ("x.md", fill, True), ("y.md", "words", True))] == ["a.b", "a.b", "y"]
