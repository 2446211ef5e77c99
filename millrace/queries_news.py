"""Registered queries on sources, feeds, digests and texts, with their DuckDB twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import posts, texts, times, urls
from .operators import classify
from .plans import digest
from .queries import _ARTICLES, _KEY, REFERENCE, _articles, _flagship, _pieces, query, table
from .session import TASKS, scratch, stored
from .sources import feeds, files, paged, registry, sinks


def _sql(s: str) -> str:
    return s.replace("'", "''")


def _yaml(spark, sf_dir) -> DataFrame:
    """A YAML registry of one source for each nation: every fifth without feeds, every seventh behind a paywall."""
    key = F.col("n_nationkey").cast("string")
    parts = [
        F.lit("sources:\n  - id: n"), key, F.lit("\n    name: \"Source: "), F.col("n_name"), F.lit("\"\n    lang: en\n    topics: [research, product]\n    weight: "), (F.col("n_nationkey") % 10).cast("string"),
        F.when(F.col("n_nationkey") % 5 == 0, "\n    feeds: []").otherwise(F.concat(F.lit("\n    feeds:\n      - https://n"), key, F.lit(".example.org/feed"))),
        F.when(F.col("n_nationkey") % 7 == 0, "\n    flags:\n      - paywall\n").otherwise("\n    flags: []\n"),
    ]
    return table(spark, sf_dir, "nation").select(F.concat(*parts).alias("text"))


@query("SELECT 'n' || n_nationkey AS id, 'Source: ' || n_name AS name, n_nationkey % 10 AS weight, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END AS n_feeds, CASE WHEN n_nationkey % 7 = 0 THEN 'paywall' ELSE '' END AS flags, 'research,product' AS topics FROM nation")
def source_registry(spark, sf_dir):
    found = registry.sources_of(_yaml(spark, sf_dir))
    return found.select("id", "name", "weight", F.size("feeds").alias("n_feeds"), F.array_join("flags", ",").alias("flags"), F.array_join("topics", ",").alias("topics"))


@query("SELECT 'n' || n_nationkey AS id, n_nationkey IN (1, 2, 3, 5, 7) AS chosen FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 7 > 0")
def usable_sources(spark, sf_dir):
    found = registry.sources_of(_yaml(spark, sf_dir))
    some = registry.usable(found, ["n1", "n2", "n3", "n5", "n7"]).select("id", F.lit(True).alias("yes"))
    return registry.usable(found).select("id").join(some, "id", "left").select("id", F.coalesce("yes", F.lit(False)).alias("chosen"))


@query("""
SELECT 'first' AS kind, source_id, min(attempt) AS attempt FROM (SELECT 'u' || user_id AS source_id, event_id AS attempt, event_type <> 'error' AS ok FROM events) WHERE ok GROUP BY source_id
UNION ALL SELECT 'failed', 'u' || user_id, event_id FROM events WHERE event_type = 'error'
""")
def fetch_attempts(spark, sf_dir):
    tries = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("success"))
    ok, failed = registry.first_success(tries)
    return ok.select(F.lit("first").alias("kind"), "source_id", "attempt").unionByName(failed.select(F.lit("failed").alias("kind"), "source_id", "attempt"))


@query("""
SELECT page_id, md5(url) AS key, page_id % 120 > 105 AS fresh, page_id % 120 < 60 AS cleared FROM pages
""")
def feed_cache(spark, sf_dir):
    """Entries of every minute from midnight on, at two o'clock: those of the last quarter are fresh, those older than an hour go."""
    held = table(spark, sf_dir, "pages").select("page_id", urls.cache_key(F.col("url")).alias("key"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("page_id") % 120 * 60_000_000).alias("fetched_at"))
    now = datetime(2024, 1, 1, 2)
    kept, gone = registry.expired(held, now, hours=1)
    rows = kept.withColumn("cleared", F.lit(False)).unionByName(gone.withColumn("cleared", F.lit(True)))
    fresh = registry.fresh(held, now).select("page_id", F.lit(True).alias("fresh"))
    return rows.join(fresh, "page_id", "left").select("page_id", "key", F.coalesce("fresh", F.lit(False)).alias("fresh"), "cleared")


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'date_unknown' ELSE '' END AS flags, CASE WHEN page_id % 3 > 0 THEN CAST(epoch_us(TIMESTAMP '2024-01-01 10:00:00') AS BIGINT) + page_id * 86400000000 END AS published_us,
  CASE WHEN page_id % 2 = 0 THEN 'https://e.org/' || page_id ELSE 'https://e.org/item/' || page_id END AS url, CASE WHEN page_id % 2 = 0 THEN 'a longer content' ELSE 'short' END AS summary,
  CASE WHEN page_id % 2 = 0 THEN 'x,y' ELSE '' END AS tags FROM pages
""")
def atom_and_rdf_articles(spark, sf_dir):
    """Every page as an Atom document (even ones) or an RDF document of one item, read back by the feed parser."""
    key = F.col("page_id").cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int"))
    date = F.when(F.col("page_id") % 3 == 0, "some day").when(F.col("page_id") % 2 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:00:00+02:00"))).otherwise(F.concat(F.date_format(day, "d MMM yyyy"), F.lit(" 10:00:00 GMT")))
    atom = F.concat(
        F.lit("﻿<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>t</title><link rel='self' href='https://e.org/self'/><link rel='alternate' href='https://e.org/"), key, F.lit("?ref=a'/><updated>"), date,
        F.lit("</updated><summary>short</summary><content>a longer content</content><category term='x'/><category term='y'/></entry><entry><title/></entry></feed>"),
    )
    rdf = F.concat(F.lit("<r:RDF xmlns:r='r' xmlns:d='d'><item><title>t</title><link>/item/"), key, F.lit("#part</link><d:date>"), date, F.lit("</d:date><description>short</description></item></r:RDF>"))
    landed = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.concat(F.lit("f"), key).alias("source_id"), F.lit("https://e.org/feed").alias("url"), F.when(F.col("page_id") % 2 == 0, atom).otherwise(rdf).alias("content"))
    items, _ = feeds.parse(landed)
    return items.select(F.shiftright("seq", feeds.ITEM_BITS).alias("page_id"), F.array_join("flags", ",").alias("flags"), F.unix_micros("published_at").alias("published_us"), "url", "summary", F.array_join("tags", ",").alias("tags"))


@query("SELECT 'f' || page_id AS source_id, CASE WHEN page_id % 4 = 2 THEN 'not a feed' ELSE 'malformed' END AS error FROM pages WHERE page_id % 4 > 0")
def feed_errors(spark, sf_dir):
    content = F.when(F.col("page_id") % 4 == 0, "<rss><channel/></rss>").when(F.col("page_id") % 4 == 1, "<rss>").when(F.col("page_id") % 4 == 2, "<html/>")
    landed = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("source_id"), "url", content.alias("content"))
    return feeds.parse(landed)[1].select("source_id", F.regexp_extract("error", "^([^:]*)", 1).alias("error"))


@query("""
SELECT event_id, 'n' || (user_id % 40) AS source_id, coalesce('Source: ' || n_name, 'n' || (user_id % 40)) AS source_name, CAST(coalesce(n_nationkey % 10, 5) AS INTEGER) AS weight
FROM events LEFT JOIN nation ON n_nationkey = user_id % 40
""")
def source_weights(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("n"), (F.col("user_id") % 40).cast("string")).alias("source_id"))
    return registry.with_source(items, registry.sources_of(_yaml(spark, sf_dir))).select("event_id", "source_id", "source_name", "weight")


_LANDED = "SELECT page_id, page_id % 25 AS n, page_id % 3 > 0 AS success FROM pages WHERE (page_id % 25) % 5 > 0 AND (page_id % 25) % 7 > 0"


@query(f"SELECT count(DISTINCT n) AS sources_queried, count(DISTINCT CASE WHEN success THEN n END) AS sources_succeeded, count(*) FILTER (WHERE NOT success) AS failures FROM ({_LANDED})")
def digest_counts(spark, sf_dir):
    """The counts of a whole run over landed feeds of the usable sources, and the lines of failures in its Markdown."""
    item = F.concat(F.lit("<rss><channel><item><title>page</title><link>https://e.org/"), F.col("page_id").cast("string"), F.lit("</link></item></channel></rss>"))
    landed = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.concat(F.lit("n"), (F.col("page_id") % 25).cast("string")).alias("source_id"), "url", item.alias("content"), (F.col("page_id") % 3 > 0).alias("success"), F.when(F.col("page_id") % 3 == 0, "timeout").alias("error"))
    ask = digest.Digest(reference=REFERENCE, keywords={"research": [("page", 2)]})
    _, text, counts = digest.run(landed, registry.sources_of(_yaml(spark, sf_dir)), ask, "2024-01-31", "en")
    return counts.crossJoin(text.select(F.regexp_count("text", F.lit("(?m)^- n\\d+: timeout$")).cast("long").alias("failures")))  # one row each


_CHOSEN = f"""
WITH a AS ({_ARTICLES}), k AS (SELECT *, {_KEY} AS key FROM a),
g AS (SELECT key, min(seq) AS seq, arg_min(url, seq) AS url, arg_min(source_name, seq) AS source_name, CAST(count(*) - 1 AS INTEGER) AS n_mentions, list(url ORDER BY seq)[2:] AS mu, list(source_name ORDER BY seq)[2:] AS ms,
  arg_min(published_at, seq) FILTER (WHERE published_at IS NOT NULL) AS published_at, coalesce(arg_min(summary, seq) FILTER (WHERE summary IS NOT NULL), '') AS summary FROM k GROUP BY key),
t AS (SELECT *, 'page ' || (seq // 4) AS title, CASE WHEN summary <> '' THEN 3 ELSE 2 END AS topic_score, CASE WHEN summary <> '' THEN 'product' ELSE 'research' END AS topic FROM g),
s AS (SELECT *, round(coalesce(greatest(0, 100 - 2 * (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(published_at)) / 3.6e9), 0) + ((seq // 4) % 10) * 10 * 0.5 + topic_score * 5 * 0.3, 6) AS score FROM t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, seq) AS INTEGER) AS group_rank FROM s),
c AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE topic WHEN 'research' THEN 0 ELSE 1 END, group_rank) AS INTEGER) AS place FROM r WHERE group_rank <= 5)
"""


@query(f"{_CHOSEN} SELECT place, topic, group_rank, seq, title, url, score, n_mentions FROM c WHERE place <= 20")
def digest_rows(spark, sf_dir):
    return _flagship(spark, sf_dir).select("place", "topic", "group_rank", "seq", "title", "url", F.round("score", 6).alias("score"), F.size("mentions").alias("n_mentions"))


@query(f"""{_CHOSEN}, l AS (SELECT topic, place, '- **[' || title || '](' || url || ')**  ' || chr(10) || '  Source: ' || source_name || ' | ' || coalesce(strftime(published_at, '%Y-%m-%d %H:%M'), 'unknown')
  || CASE WHEN summary <> '' THEN '  ' || chr(10) || '  ' || summary ELSE '' END
  || CASE WHEN n_mentions > 0 THEN '  ' || chr(10) || '  Also in: ' || array_to_string(list_transform(range(1, n_mentions + 1), lambda i: '[' || ms[i] || '](' || mu[i] || ')'), ', ') ELSE '' END AS line FROM c WHERE place <= 20),
z AS (SELECT topic, count(*) AS n, '## ' || CASE topic WHEN 'research' THEN '{sinks.TOPIC_NAMES["en"]["research"]}' ELSE '{sinks.TOPIC_NAMES["en"]["product"]}' END || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY place) AS s, min(place) AS o FROM l GROUP BY topic)
SELECT '# AI News Digest 2024-01-31' || chr(10) || chr(10) || sum(n) || ' items' || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY o) AS text FROM z
""")
def digest_markdown(spark, sf_dir):
    return sinks.markdown(_flagship(spark, sf_dir), None, "2024-01-31", "en")


@query(f"{_CHOSEN} SELECT CAST(to_json({{'place': place, 'title': title, 'url': url, 'n_mentions': n_mentions}}) AS VARCHAR) AS json FROM c WHERE place <= 20")
def digest_json(spark, sf_dir):
    return sinks.as_json(_flagship(spark, sf_dir).select("place", "title", "url", F.size("mentions").alias("n_mentions")))


@query(f"{_CHOSEN}, f AS (SELECT seq, title, score, CAST(row_number() OVER (ORDER BY score DESC, seq) AS INTEGER) AS place FROM s WHERE topic = 'product') SELECT seq, title, score, place FROM f WHERE place <= 5")
def digest_of_one_topic(spark, sf_dir):
    ask = digest.Digest(reference=REFERENCE, keywords={"research": [("page", 2)], "product": [("summary", 3)]}, topics=["product", "no such topic"])
    return digest.select(_articles(spark, sf_dir), ask).select("seq", "title", F.round("score", 6).alias("score"), "place")


_HAS = "regexp_matches(coalesce(text, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_]){}($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"""
WITH s AS (SELECT doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'que') THEN 0 ELSE CASE WHEN {_HAS.format('the')} THEN 1 ELSE 0 END END AS a,
  CASE WHEN {_HAS.format('und')} THEN 2 ELSE 0 END + CASE WHEN {_HAS.format('les')} THEN 3 ELSE 0 END AS b FROM documents)
SELECT doc_id, greatest(a, b, 0) AS topic_score, CASE WHEN greatest(a, b) < 2 THEN 'other' WHEN a = greatest(a, b) THEN 'english' ELSE 'german' END AS topic FROM s
""")
def topic_overrides(spark, sf_dir):
    """Words that a user adds (weight 3) or that rule a topic out."""
    rows = classify.classify(table(spark, sf_dir, "documents"), ["text"], {"english": [("the", 1)], "german": [("und", 2)]}, include={"german": ["les"]}, exclude={"english": ["QUE"]})
    return rows.select("doc_id", "topic_score", "topic")


@query("""
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN '中 ' || text WHEN turn % 2 = 0 AND text IS NOT NULL THEN upper(text) ELSE text END AS title, CASE WHEN conv_id % 4 = 0 OR turn % 2 = 0 AND text IS NOT NULL THEN 'seen' ELSE 'seen,untranslated' END AS flags FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS text FROM conversations)
""")
def translations(spark, sf_dir):
    """A provider that knows only titles marked for it; rows in Chinese aren't sent."""
    plain = F.regexp_replace("text", "[^a-zA-Z ]", "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("中 "), plain)).otherwise(plain).alias("title"), F.when(F.col("turn") % 2 == 0, "yes").otherwise("").alias("summary"), F.array(F.lit("seen")).alias("flags"))
    done = digest.enrich(rows, lambda t, s: [(a.upper(), b) if b == "yes" else None for a, b in zip(t, s, strict=True)])
    return done.select("conv_id", "turn", "title", F.array_join("flags", ",").alias("flags"))


_ENTITIES = "x"
for _name, _sign in texts.ENTITIES.items():
    _ENTITIES = f"replace({_ENTITIES}, '{_name}', '{_sql(_sign)}')"
_BARE = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_TEXT = f"""trim(regexp_replace({_ENTITIES}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"""


def _stripped(x: str) -> str:
    return f"(SELECT {_TEXT} FROM (SELECT regexp_replace({x}, '<[^>]*>', ' ', 'g') AS x))"


@query(f"""
WITH b AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g') AS bare FROM pages)
SELECT page_id, url, nullif({_stripped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title,
  coalesce((SELECT string_agg({_TEXT}, ' | ' ORDER BY i) FROM (SELECT i, regexp_replace(h, '<[^>]*>', ' ', 'g') AS x FROM (SELECT unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), 1) AS i))), '') AS headings,
  {_stripped("regexp_replace(bare, '(?is)<title[^>]*>.*?</title>', ' ', 'g')")} AS body FROM b
""")
def page_extract(spark, sf_dir):
    return files.page_fields(table(spark, sf_dir, "pages")).withColumn("headings", F.array_join("headings", " | "))


@query("""
SELECT conv_id * 1000 + turn AS key, 'https://x.com/' || role || '/status/' || (conv_id * 1000 + turn) AS url, CAST(conv_id * 1000 + turn AS VARCHAR) AS id, role AS username, 'Name of ' || role AS display_name,
  '2024-01-02T03:04:05.000Z' AS datetime, 'text <' || turn || '> & more' AS content, turn * 3 AS replies, conv_id AS likes FROM conversations
""")
def scraped_posts(spark, sf_dir):
    """Turns as articles of a page, read back as posts."""
    key, role, turn = (F.col(c).cast("string") for c in ("key", "role", "turn"))
    html = F.concat(
        F.lit('<article><div data-testid="User-Name"><a href="/'), role, F.lit('"><span>Name of '), role, F.lit("</span></a><span>@"), role, F.lit('</span><a href="/'), role, F.lit("/status/"), key, F.lit('"><time datetime="2024-01-02T03:04:05.000Z">2h</time></a></div><div data-testid="tweetText">text &lt;'), turn,
        F.lit('&gt; <b>&amp;</b> more</div><button data-testid="reply" aria-label="'), (F.col("turn") * 3).cast("string"), F.lit(' Replies"></button><button data-testid="like" aria-label="'), F.col("conv_id").cast("string"), F.lit(' Likes. Like"></button></article>'),
    )
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")).select("key", html.alias("html"))
    return files.post_fields(rows).select("key", "url", "id", "username", "display_name", "datetime", "content", "replies", "likes")


@query("SELECT 'b/' || doc_id || '.SQL' AS path, CASE WHEN doc_id % 10 = 0 THEN substr(text, 1, 5) ELSE substr(text, 1, 40) END AS text FROM (SELECT doc_id, regexp_replace(text, '[^a-z ]', '', 'g') AS text FROM documents) WHERE doc_id % 5 = 0")
def text_files(spark, sf_dir):
    """Documents as files: other suffixes are left out, long files cut, bytes that aren't text dropped."""
    plain = F.regexp_replace("text", "[^a-z ]", "")
    broken = F.concat(F.substring(plain, 1, 5).cast("binary"), F.unhex(F.lit("C3FF")))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("b/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".SQL").otherwise(".py")).alias("path"), F.when(F.col("doc_id") % 10 == 0, broken).otherwise(plain.cast("binary")).alias("content"))
    return files.texts_of(rows, most=40)


@query("SELECT conv_id, turn, role FROM conversations WHERE turn % 4 > 0 AND conv_id % 7 > 0")
def json_line_objects(spark, sf_dir):
    """Turns as lines; some are blank, some aren't JSON, some are no objects."""
    line = F.when(F.col("turn") % 4 == 0, F.when(F.col("conv_id") % 2 == 0, "  ").otherwise("{not json}")).when(F.col("conv_id") % 7 == 0, "[1, 2]").otherwise(F.to_json(F.struct("conv_id", "turn", "role")))
    return files.json_objects(table(spark, sf_dir, "conversations").select(line.alias("value")), "conv_id long, turn long, role string")


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def missing_document(spark, sf_dir):
    """A document that doesn't exist is an empty table."""
    notes = files.json_document(spark, f"{sf_dir}/no-such-file.json", "n_nationkey int, note string")
    return table(spark, sf_dir, "nation").join(notes, "n_nationkey", "left").select("n_nationkey", "n_name", "note")


_ITEM = _pieces(
    ("<title>T #</title>", "<title></title>", "<title> A &amp; B | #</title>", ""),
    ("<link>https://e.org/a?x=#&amp;utm_source=q</link>", "<guid>http://e.org/g/#</guid>", "<guid isPermaLink=\"false\">tag:#</guid>", "<link></link><guid isPermaLink=\"true\">https://e.org/h/#</guid>", "<link>/r/#</link>"),
    ("<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>", "<pubDate>2024-01-02T03:04:05+02:00</pubDate>", "<dc:date>2024-03-04</dc:date>", "<pubDate>soon</pubDate>", "", "<pubDate></pubDate><dc:date>2024-05-06T07:08:09Z</dc:date>"),
    ("<description>short</description>", "<description>a long text of #</description><content:encoded>tiny</content:encoded>", "<content:encoded>only # here</content:encoded>", "", "<description>a</description><content:encoded>&lt;p&gt;the &lt;b&gt;longer&lt;/b&gt; one&lt;/p&gt;</content:encoded>"),
    ("", "<category>a</category><category> </category><category>b</category>", "<category>1</category><category>2</category><category>3</category><category>4</category><category>5</category><category>6</category>"), key="c_custkey",
)
_ONE = "trim(regexp_extract(x, '(?s)<{0}[^>]*>([^<]*)</{0}>', 1), chr(10) || ' ')"
_READ = "replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"""
WITH i AS (SELECT c_custkey AS id, {_ITEM} AS x FROM customer),
f AS (SELECT id, {_READ.format(_ONE.format("title"))} AS title, {_ONE.format("link")} AS link, CASE WHEN contains(x, 'isPermaLink="false"') THEN '' ELSE {_ONE.format("guid")} END AS guid, coalesce(nullif({_ONE.format("pubDate")}, ''), {_ONE.format("dc:date")}) AS day,
  {_READ.format(_ONE.format("description"))} AS d, {_READ.format(_ONE.format("content:encoded"))} AS c, list_filter(list_transform(regexp_extract_all(x, '<category>([^<]*)</category>', 1), lambda t: trim(t)), lambda t: t <> '')[1:5] AS tags FROM i),
u AS (SELECT *, {_READ.format("coalesce(nullif(link, ''), guid)")} AS url, regexp_replace(day, '^[A-Za-z]+, ', '') AS said FROM f),
t AS (SELECT *, CASE WHEN regexp_matches(said, '^[0-9]+ [A-Z]') THEN strptime(said, '%d %b %Y %H:%M:%S GMT') WHEN regexp_matches(said, 'T.*[+]02:00$') THEN strptime(said[1:19], '%Y-%m-%dT%H:%M:%S') - INTERVAL 2 HOUR WHEN regexp_matches(said, 'T.*Z$') THEN strptime(said, '%Y-%m-%dT%H:%M:%SZ') WHEN regexp_full_match(said, '[0-9-]+') THEN strptime(said, '%Y-%m-%d') END AS ts FROM u)
SELECT id, regexp_replace(title, '\\s+', ' ', 'g') AS title, regexp_replace(regexp_replace(CASE WHEN starts_with(url, '/') THEN 'https://feeds.example.org' || url ELSE url END, '^http:', 'https:'), '[?&]utm_[^&]*', '') AS url, CAST(epoch_us(ts) AS BIGINT) AS published_us,
  trim(regexp_replace(regexp_replace(CASE WHEN length(c) > length(d) THEN c ELSE d END, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS summary, array_to_string(tags, ',') AS tags, CASE WHEN ts IS NULL THEN 'date_unknown' ELSE '' END AS flags FROM t WHERE title <> '' AND url <> ''
""")
def feed_items_of_all_shapes(spark, sf_dir):
    """A feed for every customer, its item made of pieces in all combinations; the twin reads the same texts with patterns of its own."""
    head = "<?xml version='1.0'?><rss xmlns:dc='d' xmlns:content='c'><channel>"
    landed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.lit("s").alias("source_id"), F.lit("https://feeds.example.org/f.xml").alias("url"), F.concat(F.lit(head + "<item>"), F.expr(_ITEM), F.lit("</item></channel></rss>")).alias("content"))
    items, _ = feeds.parse(landed)
    return items.select(
        F.shiftright("seq", feeds.ITEM_BITS).alias("id"), "title", "url", F.unix_micros("published_at").alias("published_us"), "summary", F.array_join("tags", ",").alias("tags"), F.array_join("flags", ",").alias("flags")
    )


@query("SELECT CAST(conv_id AS VARCHAR) AS user_id, 'user' || conv_id AS username, turn AS post_seq, role AS id, text FROM conversations")
def nested_posts(spark, sf_dir):
    """Conversations as documents of users with posts, made flat again."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("id"), t["text"].alias("text")))
    users = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("tweets"))
    days = users.select(F.lit("d").alias("date"), F.array(F.struct(F.col("conv_id").cast("string").alias("user_id"), F.concat(F.lit("user"), F.col("conv_id").cast("string")).alias("username"), F.lit("N").alias("name"), "tweets")).alias("results"))
    return files.flatten_posts(days).select("user_id", "username", F.col("post_seq").cast("long").alias("post_seq"), "id", "text")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS note, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS customer FROM orders")
def listing_pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    page = lambda k, *more: orders.where(F.col("o_orderkey") % 3 == k).select(F.col("o_orderkey").alias("id"), *more)
    return files.union_pages([page(0, F.col("o_orderpriority").alias("note")), page(1, F.col("o_custkey").alias("customer")), page(2)])


@query("""
SELECT 'data' AS kind, row_number() OVER (ORDER BY c_custkey) - 1 AS at, CAST(c_custkey AS VARCHAR) AS told FROM customer UNION ALL
SELECT 'segments', page * 1000 + row_number() OVER (PARTITION BY page ORDER BY segment) - 1, segment FROM (SELECT DISTINCT dense_rank() OVER (ORDER BY c_custkey // 100) - 1 AS page, c_mktsegment AS segment FROM customer WHERE c_mktsegment IS NOT NULL)
""")
def paged_listing(spark, sf_dir):
    """Customers landed as pages of up to a hundred with their segments beside them, read as one listing, a task for each page or run of pages."""
    path = scratch(spark, "pages")
    rows = table(spark, sf_dir, "customer").select(F.lpad(F.floor(F.col("c_custkey") / 100).cast("string"), 12, "0").alias("page"), F.struct(F.col("c_custkey").alias("id")).alias("row"), "c_mktsegment")
    page = F.struct(F.sort_array(F.collect_list("row")).alias("data"), F.struct(F.array_sort(F.collect_set("c_mktsegment")).alias("segments")).alias("includes"))
    rows.groupBy("page").agg(F.to_json(page).alias("value")).repartition(TASKS * spark.sparkContext.defaultParallelism, "page").write.partitionBy("page").text(path)  # a file a page is more work than its bytes tell
    landed = stored(paged.pages(spark, path), "listing")  # pages are opened once, though three steps look at their rows
    data = paged.listing(landed).select(F.lit("data").alias("kind"), F.col("seq").alias("at"), F.get_json_object("value", "$.id").alias("told"))
    beside = landed.where("kind = 'segments'").select("kind", (F.col("page") * 1000 + F.col("place")).alias("at"), F.replace(F.col("value"), F.lit('"'), F.lit("")).alias("told"))
    return data.unionByName(beside)


@query("""
SELECT conv_id, string_agg(CASE turn % 8 WHEN 0 THEN '# ' WHEN 1 THEN '## ' WHEN 2 THEN '  ### ' WHEN 3 THEN '- ' WHEN 4 THEN '1. ' WHEN 5 THEN '> ' WHEN 6 THEN CASE WHEN conv_id % 2 = 0 THEN '[x] ' ELSE '[ ] ' END ELSE '' END || coalesce(role, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def block_texts(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "quote", "to_do", "paragraph")))
    kind = F.element_at(kinds, (F.col("turn") % 8 + 1).cast("int"))
    blocks = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), kind.alias("type"), F.col("role").alias("text"), F.when(F.col("turn") % 8 == 2, 1).alias("depth"), F.when(F.col("conv_id") % 2 == 0, True).alias("checked"))
    return files.block_text(blocks, "conv_id")


@query("SELECT string_agg('SELECT * FROM t WHERE n = ''' || n_name || ''';' || chr(10), '' ORDER BY n_nationkey) AS sql FROM nation")
def sql_file(spark, sf_dir):
    """A SQL text written to the shared folder and read back whole."""
    path = scratch(spark, "sql")
    lines = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat(F.lit("SELECT * FROM t WHERE n = '"), F.col("n_name"), F.lit("';")).alias("value"))
    lines.write.text(path)
    return files.sql_files(spark, path).select("sql")


@query("""
SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^$', '') AS title,
  CASE WHEN regexp_matches(lower(text), 'the') THEN '1' WHEN regexp_matches(lower(text), 'user') THEN '2' ELSE '0' END AS icon, CASE WHEN turn % 2 = 0 THEN '{"a": "' || turn || '"}' END AS object, 'Say ' || role || ' in English: ' || CASE WHEN turn > 2 THEN '' ELSE turn::VARCHAR END AS prompt,
  CASE turn % 3 WHEN 0 THEN 'Policy / Ethics / Safety' WHEN 1 THEN '其他' ELSE 'unknown key' END AS label FROM conversations WHERE text IS NOT NULL
""")
def text_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('Sure: {"a": "'), F.col("turn").cast("string"), F.lit('"} and {"b": 1}'))).otherwise("no { object")
    key = F.when(F.col("turn") % 3 == 0, "policy").when(F.col("turn") % 3 == 1, "other").otherwise("unknown key")
    labels = {"en": {"policy": sinks.TOPIC_NAMES["en"]["policy"]}, "zh": sinks.TOPIC_NAMES["zh"]}
    return rows.select(
        "conv_id", "turn", texts.normalize_title(F.col("text")).alias("title"), posts.icon(F.col("text"), {"The": "1", "user": "2"}, "0").alias("icon"), texts.json_object(said).alias("object"),
        texts.fill("Say {role} in English: {n}", role=F.col("role"), n=F.when(F.col("turn") <= 2, F.col("turn"))).alias("prompt"), texts.labelled(key, labels, "en").alias("label"),
    )


@query("""
SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS clock FROM events WHERE ts >= TIMESTAMP '2024-01-04 16:00:00' AND ts < TIMESTAMP '2024-01-05 16:00:00'
""")
def beijing_day(spark, sf_dir):
    """A day of GMT+8 as a range of UTC times, and its clock."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.where(times.on_gmt8_day(F.col("ts"), "2024-01-05")).select("event_id", times.gmt8_clock(F.col("ts")).alias("clock"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(conv_id * 1000 + turn AS VARCHAR) END AS post_id, CASE WHEN turn % 2 = 1 THEN '01234567-89ab-cdef-0123-456789abcdef' END AS page_uuid,
  'https://x.com/' || role || '/status/' || conv_id AS post_url, 'likes ' || conv_id || ', reposts ' || turn || ', replies 0, views 7' AS metrics, CASE WHEN turn % 5 = 0 THEN '原创' ELSE 'k' || turn % 5 END AS label, turn % 3 = 0 AS link_only FROM conversations
""")
def post_functions(spark, sf_dir):
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    address = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("see https://twitter.com/a_b/status/"), key, F.lit("?s=1"))).otherwise("https://www.notion.so/w/A-title-0123456789abcdef0123456789abcdef?v=1")
    kind = F.when(F.col("turn") % 5 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("turn") % 5).cast("string")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", urls.post_id(address).alias("post_id"), urls.page_uuid(address).alias("page_uuid"), urls.post_url(F.col("role"), F.col("conv_id").cast("string")).alias("post_url"),
        posts.metrics_line(F.col("conv_id"), F.col("turn"), F.lit(None).cast("long"), F.lit(7)).alias("metrics"), posts.type_label(kind).alias("label"), posts.is_link_only(F.when(F.col("turn") % 3 == 0, " https://e.org/x ").otherwise("see https://e.org/x")).alias("link_only"),
    )


@query("""
SELECT doc_id, 'd' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'x' END AS kind, CAST(2 + doc_id % 2 AS BIGINT) AS n_links, CAST(1 AS BIGINT) AS n_examples FROM documents
""")
def markdown_facts(spark, sf_dir):
    """Front matter, links and fenced examples of Markdown texts."""
    key = F.col("doc_id").cast("string")
    text = F.concat(F.lit("---\nname: d"), key, F.when(F.col("doc_id") % 3 == 0, "\nkind: x").otherwise(""), F.lit("\n---\n# T\n[a](b.md) and [c](https://d.org)"), F.when(F.col("doc_id") % 2 == 1, " [e](#f)").otherwise(""), F.lit("\n```sql\nSELECT 1\n```\nname: not in front"))
    front = texts.front_matter(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", front["name"].alias("name"), front["kind"].alias("kind"), F.size(texts.markdown_links(F.col("text"))).cast("long").alias("n_links"), texts.examples(F.col("text")).cast("long").alias("n_examples"))
