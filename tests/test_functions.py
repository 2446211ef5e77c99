from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import posts, sqltext, texts, times, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_dedupe_key(spark):
    keys = {one(spark, urls.dedupe_key(F.col("u")), u=u) for u in ("https://www.example.com/article/123/", "https://example.com/article/123", "HTTPS://Example.com/article/123#top")}
    assert keys == {"https://example.com/article/123"}
    assert one(spark, urls.dedupe_key(F.col("u")), u="http://www.a.com/b/?q=1") == "http://a.com/b?q=1"


@pytest.mark.parametrize(
    "url,base,want",
    [
        ("https://e.com/p?id=123&utm_source=twitter&ref=homepage", None, "https://e.com/p?id=123"),
        ("http://e.com/p?UTM_Source=x&blank=", None, "https://e.com/p?blank="),
        ("/article/123", "https://example.com/feed", "https://example.com/article/123"),
        ("b", "https://e.com/a/x", "https://e.com/a/b"),
        ("//cdn.e.com/x#f", "https://e.com/", "https://cdn.e.com/x"),
        ("?q=1", "https://e.com/a?z=2", "https://e.com/a?q=1"),
        (None, None, None),
    ],
)
def test_normalize_url(spark, url, base, want):
    assert one(spark, urls.normalize(F.col("u"), F.col("b")), u=url, b=base) == want


def test_ids_in_addresses(spark):
    assert one(spark, urls.post_id(F.col("u")), u="https://x.com/me/status/12345?s=1") == "12345"
    assert one(spark, urls.post_id(F.col("u")), u="https://e.com") is None
    assert one(spark, urls.page_uuid(F.col("u")), u="https://www.notion.so/t/Title-" + "0123456789abcdef" * 2) == "01234567-89ab-cdef-0123-456789abcdef"
    assert one(spark, urls.domain(F.col("u")), u="https://www.E.com:80/x") == "e.com"


def test_strip_html(spark):
    assert one(spark, texts.strip_html(F.col("t")), t="<p>Hello <strong>world</strong>!</p>") == "Hello world !"
    assert one(spark, texts.strip_html(F.col("t")), t="a &amp;lt; b&nbsp;c\n d") == "a &lt; b c d"
    assert one(spark, texts.shorten(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, texts.shorten(F.col("t"), 3), t="abc") == "abc"


def test_titles(spark):
    assert one(spark, texts.normalize_title(F.col("t")), t="Hello, World! 你好世界 é") == "hello world 你好世界 é"
    like = lambda a, b: one(spark, texts.jaccard(texts.title_tokens(F.col("a")), texts.title_tokens(F.col("b"))), a=a, b=b)
    assert like("OpenAI 发布 GPT-5", "OpenAI 发布了 GPT-5 模型") == pytest.approx(4 / 7)
    assert like("OpenAI 发布 GPT-5", "谷歌发布 Gemini 2") == pytest.approx(2 / 7)
    assert like("GPT-4", "GPT-5") == 1 and like("", "x") == 0


def test_bounded_keywords(spark):
    hit = lambda word, text, **kw: one(spark, F.col("t").rlike(texts.bounded(word, **kw)), t=text)
    assert hit("open source", "An OPEN \n source model") and not hit("ai", "said") and not hit("发布", "发布新版") and hit("发布", "今日 发布 。")
    assert one(spark, posts.category(F.col("t")), t="用ai写") == "AI/ML" and one(spark, posts.category(F.col("t")), t="said so") == "Other"


@pytest.mark.parametrize("text", ["Mon, 15 Jan 2026 09:00:00 +0000", "Thu, 15 Jan 2026 09:00:00 GMT", "2026-01-15T09:00:00Z", "2026-01-15T17:00:00+08:00", "2026-01-15T09:00:00", "2026-01-15 09:00:00", "2026/01/15 09:00:00"])
def test_parse_times(spark, text):
    assert one(spark, F.unix_micros(times.parse(F.col("t"))), t=text) == int(datetime(2026, 1, 15, 9, tzinfo=timezone.utc).timestamp() * 1e6)


def test_unreadable_times(spark):
    assert all(one(spark, times.parse(F.col("t")), t=t) is None for t in ("soon", "", None, "32 Jan 2026 09:00:00 +0000"))


@pytest.mark.parametrize("word,day", [("今天", 15), ("today", 15), ("昨天", 14), ("yesterday", 14), ("前天", 13), ("おととい", 13), ("2026-01-15", 15)])
def test_day_windows(word, day):
    now = datetime(2026, 1, 15, 3, tzinfo=timezone.utc)
    since, until = times.day_window(word, "UTC+8", now)
    assert (since.day, since.hour, until.hour, until.second) == (day, 0, 23, 59) and since.utcoffset().total_seconds() == 8 * 3600


def test_zones_and_bad_days():
    assert times.zone("UTC-5").key == "Etc/GMT+5" and times.zone("+08:00").key == "Etc/GMT-8" and times.zone("UTC+0").key == "UTC"
    assert times.zone("+05:30").key == times.zone("nowhere").key == times.zone(None).key == "Asia/Shanghai"
    for bad in ("last week", "2026-13-01"):
        with pytest.raises(ValueError):
            times.day_window(bad)


def test_closeness(spark):
    near = lambda a, b: one(spark, times.close(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"), 24), a=a, b=b)
    assert near("2026-01-16 10:00:00", "2026-01-16 12:00:00") and not near("2026-01-16 00:00:00", "2026-01-20 00:00:00") and near(None, "2026-01-16 00:00:00")


def test_gmt8(spark):
    day = lambda t: str(one(spark, times.gmt8_date(F.col("t").cast("timestamp")), t=t))
    assert day("2026-01-15 15:59:59") == "2026-01-15" and day("2026-01-15 16:00:00") == "2026-01-16"
    assert one(spark, times.gmt8_clock(F.col("t").cast("timestamp")), t="2026-01-15 16:05:00") == "00:05"


def test_scores(spark):
    score = lambda t, w, s: one(spark, posts.article_score(F.col("t").cast("timestamp"), F.lit(w), F.lit(s), F.lit("2026-01-15 10:00:00").cast("timestamp")), t=t)
    assert score("2026-01-15 00:00:00", 5, 4) == pytest.approx(80 + 25 + 6) and score(None, 5, 0) == 25 and score("2026-01-15 10:00:00", 9, 0) > score("2026-01-15 10:00:00", 5, 0)
    assert score("2026-01-15 12:00:00", 0, 0) == 104 and score("2020-01-01 00:00:00", 0, 0) == 0


def test_small_expressions(spark):
    assert [one(spark, posts.short_count(F.lit(n))) for n in (999, 3400, 1_200_000)] == ["999", "3.4K", "1.2M"]
    assert one(spark, texts.json_object(F.col("t")), t='say {"a": 1} so') == '{"a": 1}'
    assert one(spark, texts.fill("Hi {n}, {m}!", n=F.col("t"), m=F.lit(None).cast("string")), t="you") == "Hi you, !"
    assert one(spark, texts.labelled(F.col("t"), {"zh": {"a": "甲"}, "en": {"b": "B"}}, "en"), t="a") == "甲"
    assert one(spark, texts.language_mix(F.col("t")), t="中 abc") == "mixed" and one(spark, texts.language_mix(F.col("t")), t="中 ab") == "chinese"
    assert one(spark, posts.content_type(F.col("t")), t="How To cook") == "教程/经验分享"
    assert one(spark, posts.icon(F.col("t"), {"gpt": "*", "law": "#"}, "-"), t="New Law") == "#"
    assert one(spark, posts.username_key(F.col("t")), t="@Bob") == "bob"


def test_sql_scanner():
    sql = "CREATE EXTERNAL TABLE IF NOT EXISTS `a`.b (x DECIMAL(10, 2) COMMENT 'x, y', -- no\n y ARRAY<STRUCT<a:INT,b:INT>>, PRIMARY KEY (x)) PARTITIONED BY (dt STRING) COMMENT 'all';"
    found = sqltext.tokens(sql)
    assert sqltext.created_tables(found) == ["a.b"]
    made = sqltext.table_definition(found)
    assert [(c["name"], c["type"].replace(" ", "")) for c in made["columns"]][0] == ("x", "DECIMAL(10,2)") and made["columns"][0]["comment"] == "x, y"
    assert [c["name"] for c in made["partition_columns"]] == ["dt"] and made["table_comment"] == "all"
    etl = "INSERT OVERWRITE TABLE t SELECT DISTINCT a, sum(b) FROM x.y JOIN (SELECT row_number() OVER (PARTITION BY k, f(a, b) ORDER BY ts) r FROM z) q ON 1 = 1 GROUP BY a, f(b, c) HAVING 1 > 0"
    got = sqltext.signals(sqltext.tokens(etl), etl)
    assert got == {"source_tables": ["x.y", "z"], "group_by": ["a", "f(b, c)"], "row_number_keys": ["k", "f(a, b)"], "has_distinct": True, "has_row_number": True}
    assert sqltext.inserted_tables(sqltext.tokens(etl)) == ["t"]
