from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import asof, classify, dedupe, merge, profile, rank
from millrace.plans import archive, catalog, digest, qalog, shapes, sqlcheck
from millrace.schemas import ARTICLE, POST, QA
from millrace.sources import feeds, files, registry, sinks

NOW = datetime(2026, 1, 15, 12)


def article(seq, title, url, source="s1", at=None, summary="", tags=(), **more):
    fields = [f.split(" ")[0] for f in ARTICLE.split(", ")]
    row = {"seq": seq, "title": title, "url": url, "source_id": source, "source_name": source.upper(), "title_raw": title, "published_at": at, "published_raw": str(at or ""), "summary": summary, "summary_raw": summary, "tags": list(tags), "mentions": [], "score": 0.0, "flags": []} | more
    return tuple(row.get(f) for f in fields)


def articles(spark, *rows):
    return spark.createDataFrame(rows, ARTICLE)


def test_mentions(spark):
    rows = articles(spark, article(1, "a", "https://www.e.com/x/", summary=""), article(2, "b", "https://e.com/x", "s2", NOW, "sum"), article(3, "c", "https://e.com/y"), article(4, "d", None), article(5, "e", ""), article(6, "f", "HTTPS://E.com/x#z", "s3"))
    merged = dedupe.merge_mentions(rows)
    got = {r.seq: r for r in merged.collect()}
    assert set(got) == {1, 3, 4, 5} and [m.source_id for m in got[1].mentions] == ["s2", "s3"]
    assert (got[1].title, got[1].summary, got[1].published_at) == ("a", "sum", NOW) and merged.columns == [c for c in rows.columns if c != "mentions"] + ["mentions"]
    again = {r.seq: len(r.mentions) for r in dedupe.merge_mentions(merged.select(rows.columns)).collect()}
    assert set(again) == {1, 3, 4, 5} and sum(1 + len(r.mentions) for r in got.values()) == 6


def brute_greedy(rows, threshold, hours):
    import re

    token = lambda t: set(re.findall("[a-z]+|[一-鿿]", (t or "").lower()))
    leads, out = {}, {}
    for seq, title, at in sorted(rows):
        for lead, (tokens, when) in leads.items():
            a = token(title)
            like = len(a & tokens) / len(a | tokens) if a and tokens else 0
            if like >= threshold and (at is None or when is None or abs(at - when) <= timedelta(hours=hours)):
                out[seq] = lead
                if when is None:
                    leads[lead] = (tokens, at)
                break
        else:
            out[seq] = seq
            leads[seq] = (token(title), at)
    return out


def test_greedy_titles(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "新", "版"]
    rows = [(k, " ".join(rng.sample(words, rng.randint(0, 6))), rng.choice([None, NOW, NOW + timedelta(hours=30)])) for k in range(80)]
    df = spark.createDataFrame(rows, "seq long, title string, published_at timestamp")
    for threshold in (0.5, 0.8):
        got = {r.seq: r.leader for r in dedupe.greedy_title_groups(df, threshold=threshold).collect()}
        assert got == brute_greedy(rows, threshold, 24)


def test_classification(spark):
    words = {"research": [("paper", 3), ("study", 3)], "product": [("launch", 3), ("gpt-4", 3)], "policy": [("law", 1)]}
    df = spark.createDataFrame([(1, "A paper and a STUDY"), (2, "gpt-4 launch"), (3, "law"), (4, "papers"), (5, None), (6, "paper launch")], "id long, t string")
    got = {r.id: (r.topic, r.topic_score) for r in classify.classify(df, ["t"], words, exclude={"product": ["never"]}).collect()}
    assert got == {1: ("research", 6), 2: ("product", 6), 3: ("other", 1), 4: ("other", 0), 5: ("other", 0), 6: ("research", 3)}
    assert {r.id: r.topic for r in classify.classify(df, ["t"], words, include={"policy": ["papers"]}, exclude={"research": ["study"]}).collect()}[4] == "policy"


def test_upserts(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], "id string, v string, n int")
    changes = spark.createDataFrame([("2", "c", 1), ("2", "d", 2), ("3", None, 1)], "id string, v string, n int")
    got = {tuple(r) for r in merge.upsert(base, changes, "id", "n").collect()}
    assert got == {("1", "a", 1), ("2", "d", 2), ("3", None, 1)}
    assert {tuple(r) for r in merge.upsert(merge.upsert(base, changes, "id", "n"), changes, "id", "n").collect()} == got
    assert {r.id for r in merge.added(changes, base, "id").collect()} == {"3"} and {r.id for r in merge.removed(changes, base, "id").collect()} == {"1"}
    assert {tuple(r) for r in merge.tag_sources(base, changes, "id", ("f", "b")).collect()} == {("1", "f"), ("2", "both"), ("3", "b")}
    assert {r.id: r.v for r in merge.rebuild(changes, base, "id", {"v": "原创"}).collect()} == {"2": "b", "3": "原创"}


def test_curation(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "username string")
    got = merge.curate(names("A", "b"), names("@c", "d", "e"), names("b"), names("x"), approve=names("C"), reject=names("d"), add=names("x"), remove=names("B"))
    assert {k: {r.username for r in v.collect()} for k, v in got.items()} == {"tracked": {"a", "c", "x"}, "pending": {"e"}, "include": {"c", "x"}, "exclude": {"d", "b"}}
    assert {r.username: r.origin for r in merge.tag_curated(names("A", "z"), names("@a")).collect()} == {"A": "manual", "z": "auto"}


def test_snapshots(spark):
    days = spark.createDataFrame([("u", "2026-01-01"), ("u", "2026-01-02"), ("v", "2026-01-01")], "id string, day string")
    assert {tuple(r) for r in merge.status_over_snapshots(days, "id", "day").collect()} == {("u", "2026-01-01", "2026-01-02", "active"), ("v", "2026-01-01", "2026-01-01", "unfollowed")}
    assert {r.id for r in merge.previous_snapshot(days, "day", "2026-01-02").collect()} == {"u", "v"}


def test_caps(spark):
    rows = spark.createDataFrame([(k, k % 3, float(k % 7)) for k in range(60)], "id long, g long, s double")
    for total in (0, 4, 12, 100):
        got = [(r.g, r.id) for r in rank.capped(rows, "g", "g", 5, total, F.desc("s"), F.col("id")).orderBy("place").collect()]
        want = [(g, i) for g in range(3) for _, i in sorted((-(k % 7), k) for k in range(60) if k % 3 == g)[:5]][:total]
        assert got == want


def test_thread_positions(spark):
    rows = spark.createDataFrame([(1, "c", "2"), (2, "c", "1"), (3, None, "1"), (4, None, "2"), (5, "d", "1")], "id long, c string, at string")
    assert {r.id: r.thread_position for r in rank.thread_positions(rows, "c", "at", "id").collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: None}


def test_profile(spark):
    rows = spark.createDataFrame([("ab",), ("中文",), ("中文 abc",), (None,)], "t string")
    assert tuple(profile.language_shares(rows, "t").first()) == (25, 50, 25)
    assert tuple(profile.length_stats(rows, "t").first()) == (3, 2, 0, 6)
    empty = rows.limit(0)
    assert tuple(profile.language_shares(empty, "t").first()) == (None, None, None) and profile.top_words(empty, "t").count() == 0
    ts = spark.createDataFrame([(datetime(2026, 1, 1, h),) for h in (3, 3, 5, 5)] + [(None,)], "ts timestamp")
    assert profile.most_active_hour(ts, "ts").first().hour == 3 and profile.hour_histogram(ts, "ts").count() == 24
    words = spark.createDataFrame([("The cat's https://e.com/x cat 中文 a",)], "t string")
    assert {r.word: r.n for r in profile.top_words(words, "t").collect()} == {"cat": 2, "中文": 1}


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="c" xmlns:dc="d"><channel><title>F</title>
<item><title>T &amp; &lt;b&gt;U&lt;/b&gt;</title><link>/a?utm_source=x</link><pubDate>Mon, 15 Jan 2026 09:00:00 +0000</pubDate><description>short</description><content:encoded>&lt;p&gt;a longer &amp;eacute;&lt;/p&gt;</content:encoded><category>x</category></item>
<item><title>no link</title></item><item><title>guid</title><guid>https://e.com/g</guid><dc:date>bad</dc:date></item><item><title>off</title><guid isPermaLink="false">g</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://e.com/s"/><link href="https://e.com/a"/><updated>2026-01-15T09:00:00Z</updated><summary>s</summary><category term="t"/></entry></feed>"""


def test_feeds(spark):
    landed = spark.createDataFrame([(0, "r", "https://e.com/feed", "﻿" + RSS), (1, "a", "https://e.com/atom", ATOM), (2, "m", "u", "<rss>"), (3, "h", "u", "<html/>"), (4, "n", "u", None)], "seq long, source_id string, url string, content string")
    items, broken = feeds.parse(landed)
    got = {r.title: r for r in items.collect()}
    assert set(got) == {"T & U", "guid", "A"} and got["T & U"].url == "https://e.com/a" and got["T & U"].summary == "a longer é" and got["T & U"].published_at == datetime(2026, 1, 15, 9)
    assert got["guid"].flags == ["date_unknown"] and got["A"].url == "https://e.com/a" and got["A"].tags == ["t"]
    assert {r.source_id for r in broken.collect()} == {"m", "h", "n"}


YAML = """
# sources
sources:
  - id: a
    name: "Source: A"
    feeds:
      - https://a.com/feed
    lang: en
    topics: [research, product]
    weight: 9
    flags: []
  - id: b
    name: B
    feeds: []
    weight: 3
    flags:
      - paywall
"""


def test_digest(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(YAML)
    sources = registry.load(spark, str(tmp_path / "s.yaml"))
    assert [(r.id, r.name, r.weight, r.topics) for r in sources.collect()] == [("a", "Source: A", 9, ["research", "product"]), ("b", "B", 3, [])]
    landed = spark.createDataFrame([(0, "a", "https://e.com/feed", RSS, True, None), (1, "a", "https://e.com/2", None, False, "timeout"), (2, "b", "x", ATOM, True, None)], "seq long, source_id string, url string, content string, success boolean, error string")
    ask = digest.Digest(reference=NOW, keywords={"research": [("longer", 3)]}, window="2026-01-15", zone="UTC+8")
    rows, text, counts = digest.run(landed, sources, ask, "2026-01-15", "en")
    assert {(r.topic, r.title, r.weight) for r in rows.collect()} == {("research", "T & U", 9), ("other", "guid", 9)}
    page = text.first().text
    assert "## Research / Papers / Labs" in page and "## Other" in page and "timeout" in page and "## Products" not in page and tuple(counts.first()) == (1, 1)


def test_similar_digest_and_translation(spark):
    rows = articles(spark, article(1, "OpenAI ships GPT model today", "u1", at=NOW), article(2, "OpenAI ships GPT model now", "u2", "s2", NOW), article(3, "other", "u3"))
    got = {r.seq: [m.url for m in r.mentions] for r in digest.merge_similar(rows, 0.5).collect()}
    assert got == {1: ["u2"], 3: []}
    plain = digest.enrich(rows, None).collect()
    assert all(r.flags == ["untranslated"] for r in plain)
    done = digest.enrich(rows, lambda t, s: [(x.upper(), "摘要") if x != "other" else None for x in t])
    assert {r.title: r.flags for r in done.collect()} == {"OPENAI SHIPS GPT MODEL TODAY": [], "OPENAI SHIPS GPT MODEL NOW": [], "other": ["untranslated"]}


def test_archive(spark):
    fields = [f.split(" ")[0] for f in POST.split(", ")]
    post = lambda **v: tuple(v.get(f) for f in fields)
    ref = lambda kind, i: [(kind, i)]
    rows = spark.createDataFrame([
        post(id="1", text="root", author_id="a", created_at="2026-01-15T10:00:00Z", public_metrics=(5, 1, 0, 0, 2, 0)), post(id="2", text="self", author_id="a", referenced_tweets=ref("replied_to", "1"), created_at="2026-01-15T11:00:00Z"),
        post(id="3", text="other", author_id="b", referenced_tweets=ref("replied_to", "1"), in_reply_to_user_id="a", created_at="2026-01-15T11:00:00Z"), post(id="4", text="quote", author_id="b", referenced_tweets=ref("quoted", "9"), created_at="2026-01-14T11:00:00Z"),
        post(id="5", text="n", author_id="b", note_tweet=("long note",), created_at="2026-01-15T12:00:00Z"), post(id="6", text="https://e.com", author_id="c"),
    ], POST)
    users = spark.createDataFrame([("a", "ann"), ("b", "bob")], "id string, username string")
    typed = archive.typed(rows.drop("tweet_type", "full_text"), rows, users)
    got = {r.id: (r.tweet_type, r.full_text, r.original_tweet and r.original_tweet.author_username) for r in typed.collect()}
    assert got == {"1": ("原创", "root", None), "2": ("线程", "self", "ann"), "3": ("回复", "other", "ann"), "4": ("引用", "quote", ""), "5": ("长文", "long note", None), "6": ("原创", "https://e.com", None)}
    day, report = archive.scored(typed, typed.limit(0), "2026-01-15")
    assert {r.id: r.score for r in day.collect()} == {"1": 12, "2": 0, "5": 0} and report.first().replies == 1
    assert archive.digest(day, 2).orderBy("rank").first().id == "1" and archive.rewrite_candidates(day).count() == 3
    style = archive.style(rows)
    assert style["engagement"].first().avg_likes == 5 and style["content"].first().text_only == 6 and style["most_active"].first().hour == 11
    assert {r.author_id: r.latest_id for r in archive.newest_ids(rows).collect()} == {"a": "2", "b": "5", "c": "6"}
    assert archive.related(spark.createDataFrame([("Uses LLMs", "x"), ("no", "AI Bob"), (None, None)], "content string, displayName string"), ["llm", "ai"]).count() == 2


DDL = [
    ("/dw/01-ADS/订单汇总.sql", "CREATE TABLE IF NOT EXISTS ads.order_sum (\n id BIGINT COMMENT '编号', -- key\n amount DECIMAL(10, 2) COMMENT '金额, 元',\n PRIMARY KEY (id)\n) COMMENT '订单汇总表' PARTITIONED BY (dt STRING COMMENT '日期');"),
    ("/dw/01-ADS/load.sql", "INSERT OVERWRITE TABLE order_sum SELECT id, sum(amount) FROM (SELECT *, row_number() over (partition by id, dt order by ts desc) rn FROM dwd.orders) o JOIN dim.shop s ON o.sid = s.sid WHERE rn = 1 GROUP BY id, o.dt;"),
    ("/dw/02-DWD/orders.md", "# Orders\nCREATE TABLE dwd.orders (id BIGINT, sid BIGINT)"),
]


def small_catalog(spark):
    return catalog.build(spark.createDataFrame(DDL, "path string, text string"))


def test_catalog_and_search(spark, tmp_path):
    made = {(r.layer, r.name): r for r in small_catalog(spark).collect()}
    assert set(made) == {("ADS", "ads.order_sum"), ("DWD", "dwd.orders")} or set(made) == {("ADS", "ads.order_sum"), ("DWD", "dwd.orders"), ("ADS", "order_sum")}
    entry = made["ADS", "ads.order_sum"]
    assert entry.description == "订单汇总" and entry.table_comment == "订单汇总表" and [c.comment for c in entry.columns] == ["编号", "金额, 元"] and [c.name for c in entry.partition_columns] == ["dt"]
    found = catalog.search(small_catalog(spark), "统计 order 金额 dt").collect()
    assert found[0].name == "ads.order_sum" and found[0].score > found[-1].score
    assert catalog.query_tokens("查询 Order_ID 的 12 345 ＡＰＩ") == ["order_id", "id", "345", "api"]
    sinks.write_catalog(small_catalog(spark), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c" / "search")).count() == len(made)
    (tmp_path / "dw" / "ADS").mkdir(parents=True)
    (tmp_path / "dw" / "ADS" / "t.sql").write_text("CREATE TABLE t (a INT)")
    (tmp_path / "dw" / "ADS" / "t.py").write_text("no")
    assert [r.text for r in files.text_tree(spark, str(tmp_path / "dw")).collect()] == ["CREATE TABLE t (a INT)"]
    assert catalog.counts(small_catalog(spark)).where("layer = 'ADS'").first().commented == 1


@pytest.mark.parametrize(
    "sql,dialect,want",
    [
        ("SELECT a FROM ads.order_sum WHERE dt = '1'", "hive", set()),
        ("SELECT a FROM order_sum", "hive", {"missing-where"}),
        ("SELECT a FROM x.order_sum WHERE adt = 1", "sparksql", {"missing-partition-filter"}),
        ("SELECT * FROM t; DROP TABLE t", "gaussdb", {"select-star", "destructive"}),
        ("SELECT `a`, explode(b) FROM t", "gaussdb", {"gaussdb-backticks", "gaussdb-hive-only"}),
        ("SELECT a::int AS b FROM t ORDER BY b -- update", "hive", {"hive-postgres-cast"}),
        ("SELECT a::int b, 'text' FROM t", "hive-legacy", {"hive-legacy-postgres-cast"}),
        ("SELECT a FROM t\njoin u\njoin v\njoin w", "sparksql", {"many-joins"}),
        ("SELECT a FROM t ORDER BY 1, c DESC", "hive", {"hive-orderby-positional", "hive-orderby-not-selected"}),
        ("SELECT a, (SELECT 1) b FROM t JOIN u ON t.a = (SELECT 2) ORDER BY b", "hive-legacy", {"hive-legacy-scalar-subquery-select", "hive-legacy-scalar-subquery-on"}),
    ],
)
def test_sql_checks(spark, sql, dialect, want):
    got = sqlcheck.check(spark.createDataFrame([("p", sql)], "path string, sql string"), dialect, small_catalog(spark))
    assert {r.code for r in got.collect()} == want


def test_qa_log(spark, tmp_path):
    path = tmp_path / "qa.jsonl"
    path.write_text('{"id":"1","label":"Bad","issues":["x","y"],"feedback":{"issues":["x"]}}\n\nnot json\n[1]\n{"id":"2","label":"good","issues":["z"]}\n{"id":"3","label":"badcase","issues":["y"]}\n')
    log = files.json_lines(spark, str(path), QA).withColumn("seq", F.col("id").cast("long"))
    assert tuple(qalog.totals(log).first()) == (3, 1, 2)
    top = qalog.top_issues(log)
    assert [(r.issue, r.n) for r in top.collect()] == [("x", 2), ("y", 2)]
    assert [r.advice for r in qalog.advice(top, {"x": "ask", "y": "ask"}).collect()] == ["ask"]
    assert qalog.due(log, 0, 3) == (True, 3) and qalog.due(log, 1, 3) == (False, 3)
    assert files.json_lines(spark, str(tmp_path / "none"), QA).count() == 0
    kv = spark.createDataFrame([(["a=1", "b=x=y"],)], "x array<string>")
    assert kv.select(qalog.pairs(F.col("x")).alias("m")).first().m == {"a": "1", "b": "x=y"}
    assert sinks.replace_block("a\n<!--S-->\nold\n<!--E-->\nb", "<!--S-->", "<!--E-->", "new") == "a\n<!--S-->\nnew\n<!--E-->\nb"


def test_shapes(spark):
    spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02")], "id long, day string").createOrReplaceTempView("facts")
    assert [r.id for r in shapes.with_parameters(spark, "SELECT id FROM facts WHERE day >= {{start_date}}", start_date="2026-01-02").collect()] == [2]
    assert [r.id for r in shapes.latest_partition(spark.table("facts"), "day").collect()] == [2]


def test_other_sources_and_sinks(spark, tmp_path):
    days = spark.createDataFrame([("d", [("u", "n", "N", 1, "2", [("1",) + (None,) * 12, ("2",) + (None,) * 12])])], f"date string, results array<struct<user_id:string,username:string,name:string,followers_count:long,latest_tweet_id:string,tweets:array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in POST.split(', '))}>>>>")
    assert [(r.post_seq, r.id, r.username) for r in files.flatten_posts(days).collect()] == [(0, "1", "n"), (1, "2", "n")]
    blocks = spark.createDataFrame([(1, 2, "to_do", "x", 1, True), (1, 1, "heading_1", "H", 0, None)], "page_id long, seq long, type string, text string, depth int, checked boolean")
    assert files.block_text(blocks).first().text == "# H\n  [x] x"
    page = spark.createDataFrame([(1, "u", "<html><title>T</title><script>x<y</script><h1>A <i>b</i></h1>c</html>")], "page_id long, url string, html string")
    assert tuple(files.page_fields(page).first()) == (1, "u", "T", ["A b"], "A b c")
    rows = spark.createDataFrame([("2026-01-01", 1)], "date string, v long")
    sinks.write_snapshot(rows, str(tmp_path / "s"))
    sinks.write_snapshot(rows.withColumn("date", F.lit("2026-01-02")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.replace_table(rows, str(tmp_path / "t"))
    sinks.replace_table(rows.withColumn("v", F.lit(7)), str(tmp_path / "t"))
    assert [r.v for r in sinks.read_table(spark, str(tmp_path / "t")).collect()] == [7]
    cards = spark.createDataFrame([([(f"c{k}", "int", "x" if k == 0 else None) for k in range(12)],)], "columns array<struct<name:string,type:string,comment:string>>")
    assert cards.select(sinks.table_card(F.col("columns")).alias("c")).first().c.endswith("c9, ...(+2)")
    tries = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False)], "source_id string, attempt int, success boolean")
    ok, failed = registry.first_success(tries)
    assert [(r.source_id, r.attempt) for r in ok.collect()] == [("a", 2)] and failed.count() == 2


def test_places_are_the_same_by_windows_and_by_ranges(spark, monkeypatch):
    rows = [(c, t % 7, t) for c, n in (("a", 300), ("b", 1), (None, 40), ("c", 25)) for t in range(n)]
    df = spark.createDataFrame(rows, "c string, t int, s int").repartition(5)
    want, sizes = {}, {}
    for c in {r[0] for r in rows}:
        own = sorted((t, s) for c_, t, s in rows if c_ == c)
        want |= {(c, s): k for k, (_, s) in enumerate(own)}
        sizes[c] = len(own)
    for most, small in ((0, 0), (0, 1000), (20, 1000), (1000, 1000)):
        monkeypatch.setattr(rank, "SMALL", small)
        got = rank.places(df, ["c"], "t", "s", size="n", most=most).collect()
        assert len(got) == len(rows) and {(r.c, r.s): r.place for r in got} == want and all(r.n == sizes[r.c] for r in got)
        threads = rank.thread_positions(df, "c", "t", "s", most=most).collect()
        assert {(r.c, r.s): r.thread_position for r in threads} == {(c, s): k + 1 if c and c != "b" else None for (c, s), k in want.items()}
    assert rank.places(df.limit(0), ["c"], "t", most=0).count() == 0


def test_a_hot_conversation_is_split(spark):
    """Places by ranges: no range holds much more than its share of a group that has all rows."""
    df = spark.range(40_000).select(F.lit("hot").alias("c"), F.col("id").alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rank.places(df, ["c"], "s", most=1000).withColumn("task", F.spark_partition_id()).checkpoint()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 20_000
    assert found.where("place <> s").count() == 0


@pytest.mark.parametrize("many", [0, 10**6])
def test_greedy_titles_against_the_plain_pass(spark, monkeypatch, many):
    """Groups that overlap, equal titles, unknown times; pairs at once, and rounds with centres first."""
    import random

    monkeypatch.setattr(dedupe, "PAIRS", many)
    monkeypatch.setattr(dedupe, "PAIRS_A_TOKEN", many)
    rng = random.Random(8)
    rows = []
    for i in range(260):
        base = [f"t{chr(97 + i % 7)}{chr(97 + k)}" for k in range(10)]
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(10)] = f"e{chr(97 + rng.randrange(6))}"
        rows.append((i, " ".join(base) if i % 31 else "", None if rng.random() < 0.25 else NOW + timedelta(hours=rng.randrange(200))))
    df = spark.createDataFrame(rows, "seq long, title string, published_at timestamp")
    for threshold, hours in ((0.6, 24), (0.8, 1000), (1.0, 3)):
        got = {r.seq: r.leader for r in dedupe.greedy_title_groups(df, threshold=threshold, hours=hours).collect()}
        assert got == brute_greedy(rows, threshold, hours)


def test_titles_alike_never_meet_in_pairs(spark, monkeypatch):
    """4,000 titles, each like every other: no more comparisons than tokens of their prefixes."""
    seen = []
    alike = dedupe._alike
    monkeypatch.setattr(dedupe, "_alike", lambda pairs, *rest: seen.append(pairs.count()) or alike(pairs, *rest))
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    df = spark.range(4000).select(F.col("id").alias("seq"), F.concat(F.lit("all of these words are in every one of our titles here "), letters).alias("title"), F.lit(None).cast("timestamp").alias("published_at"))
    found = dedupe.greedy_title_groups(df, threshold=0.8)
    assert found.agg(F.count("*"), F.max("leader")).first()[:] == (4000, 0)
    assert sum(seen) < 4 * 4000


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_last_fact_before(spark, ranges):
    import random

    rng = random.Random(ranges)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "only uses", None])
    facts = [(key(), rng.choice([None, *range(60)]), f"v{k}") for k in range(80)] + [("only facts", 1, "x"), ("hot", 3, None)]
    facts = [f for f in facts if f[0] != "only uses"]
    uses = [(key(), rng.choice([None, *range(-3, 60)]), k) for k in range(200)]
    found = asof.last_before(spark.createDataFrame(uses, "k string, t int, id int"), spark.createDataFrame(facts, "k string, t int, v string"), ["k"], "t", "v", ranges).collect()
    assert len(found) == len(uses)
    for r in found:
        before = [(t, v) for k, t, v in facts if None not in (r.k, r.t, t, v) and k == r.k and t <= r.t]
        assert r.v == (max(before)[1] if before else None)


def test_a_name_with_many_definitions_and_uses(spark):
    """2,000 definitions and 2,000 uses of one short name: rows added, not multiplied."""
    plan = spark.range(2000).select(F.lit("DWD").alias("layer"), F.lit("t").alias("short"), F.format_string("p%05d", F.col("id") * 2 + 1).alias("path"))
    facts = spark.range(2000).select(F.lit("DWD").alias("layer"), F.lit("t").alias("short"), F.format_string("p%05d", F.col("id") * 2).alias("path"), F.format_string("db%d.t", "id").alias("full_name"))
    found = asof.last_before(plan, facts, ["layer", "short"], "path", "full_name")
    assert found.where(F.col("full_name") != F.format_string("db%d.t", F.floor(F.substring("path", 2, 5).cast("int") / 2))).count() == 0 and found.count() == 2000
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_close_pairs(spark):
    """Times on the borders of stretches, unknown times, and equal titles told by their first."""
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(["alpha", "beta", "gamma", "delta", "eps", "zeta"], rng.randint(3, 5))), None if i % 9 == 0 else NOW + timedelta(hours=rng.choice([0, 3, 6, 12, 24, 25, 48, 100]))) for i in range(60)]
    sets, first = {i: frozenset(t.split()) for i, t, _ in rows}, {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    at = {i: a for i, _, a in rows}
    reps = sorted(first.values())
    for threshold, hours in ((0.5, 24), (0.75, 3)):
        close = lambda a, b: at[a] is None or at[b] is None or abs(at[a] - at[b]) <= timedelta(hours=hours)  # noqa: E731, B023
        want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold and close(a, b)}
        got = [(r.a, r.b) for r in dedupe.close_title_pairs(spark.createDataFrame(rows, "id long, t string, at timestamp"), "id", "t", "at", threshold, hours).collect()]
        assert set(got) == want and len(got) == len(want)
