"""Registered queries, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import posts, texts, times, urls
from .operators import classify, dedupe, history, merge, profile, rank
from .plans import archive, digest, qalog, shapes
from .session import scratch, shared_folder
from .sources import feeds

REFERENCE = datetime(2024, 1, 31)
KEYWORDS = {"research": [("the", 1), ("this", 2), ("thand", 3)], "product": [("les", 2), ("pour", 3)], "opensource": [("der", 2), ("und", 2)], "funding": [("los", 2), ("con", 2)], "policy": [("que", 1), ("all rights", 3)]}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _pieces(*choices: tuple[str, ...], key: str = "o_orderkey", size: int = 1) -> str:
    """SQL, for either engine, of a text made of one piece of each kind, so that every combination occurs; ~ stands for a quote, | for a new line, # for the key."""
    signs, out = {"~": "chr(39)", "|": "chr(10)", "#": f"CAST({key} AS STRING)"}, []
    for texts in choices:
        cases = " ".join(f"WHEN {k} THEN " + " || ".join(signs.get(x, f"'{x}'") for x in re.split(r"([~|#])", t) if x) for k, t in enumerate(texts) if t)
        out.append(f"CASE CAST(floor({key} / {size}) AS BIGINT) % {len(texts)} {cases} ELSE '' END" if len(texts) > 1 else cases.removeprefix("WHEN 0 THEN "))
        size *= len(texts)
    return " || ".join(out)


_PLAIN = "url_decode(replace(regexp_extract(p, '{}', 1), '+', ' '))"
_CODED = "replace(url_encode({}), '%20', '+')"
_NORMAL = f"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', 'https://') AS u FROM pages),
q AS (SELECT page_id, regexp_extract(u, '^([^?]*)', 1) AS head, list_filter(list_transform(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> ''),
  lambda p: {{'k': {_PLAIN.format("^([^=]*)")}, 'v': {_PLAIN.format("^[^=]*=(.*)$")}}}), lambda x: NOT list_contains({list(urls.TRACKING)!r}, lower(x.k))) AS kv FROM u),
n AS (SELECT page_id, head, kv, list_transform(kv, lambda x: x.k) AS names FROM q)
SELECT page_id, CASE WHEN len(kv) = 0 THEN head ELSE head || '?' || array_to_string(list_transform(list_sort(list_transform(kv, lambda x, i: {{'first': list_position(names, x.k), 'at': i, 'text': {_CODED.format("x.k")} || '=' || {_CODED.format("x.v")}}})), lambda x: x.text), '&') END AS url FROM n
"""


@query(_NORMAL)
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


def _articles(spark, sf_dir) -> DataFrame:
    """Pages as articles of several sources, each under four spellings of its address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    plain = F.regexp_replace("url", "#.*$", "")
    spelled = F.array(plain, F.regexp_replace(plain, "^(https?)://", "$1://www."), F.concat(plain, F.lit("#part")), F.upper(plain))
    rows = pages.select("page_id", F.posexplode(spelled).alias("k", "url"))
    seq = F.col("page_id") * 4 + F.col("k")
    nothing = F.expr("CAST(array() AS array<struct<source_id:string,source_name:string,url:string>>)")
    return rows.select(
        seq.alias("seq"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), "url", F.concat(F.lit("s"), F.col("k").cast("string")).alias("source_id"),
        F.concat(F.lit("Source "), F.col("k").cast("string")).alias("source_name"), F.lit("").alias("title_raw"),
        F.when(F.col("k") >= F.col("page_id") % 4, F.timestamp_micros(F.lit(1_704_067_200_000_000) + seq * 3_600_000_000)).alias("published_at"), F.lit("").alias("published_raw"),
        F.when(F.col("k") % 2 == 1, F.concat(F.lit("summary "), seq.cast("string"))).otherwise("").alias("summary"), F.lit("").alias("summary_raw"),
        F.lit(None).cast("string").alias("topic"), F.array(F.lit("t")).alias("tags"), nothing.alias("mentions"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("flags"), (F.col("page_id") % 10).cast("int").alias("weight"),
    )


_ARTICLES = """
  SELECT page_id * 4 + k AS seq, 's' || k AS source_id, 'Source ' || k AS source_name,
    CASE k WHEN 0 THEN p WHEN 1 THEN regexp_replace(p, '^(https?)://', '\\1://www.') WHEN 2 THEN p || '#part' ELSE upper(p) END AS url,
    CASE WHEN k >= page_id % 4 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(page_id * 4 + k AS INTEGER)) END AS published_at,
    CASE WHEN k % 2 = 1 THEN 'summary ' || (page_id * 4 + k) END AS summary
  FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS p FROM pages), range(4) AS r(k)
"""
_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^([a-z][a-z0-9+.-]*://)www\.', '\1'), '/+(\?|$)', '\1')"


@query(f"""
WITH a AS ({_ARTICLES}), k AS (SELECT *, {_KEY} AS key FROM a),
g AS (SELECT key, min(seq) AS seq, arg_min(url, seq) AS url, list(url ORDER BY seq)[2:] AS u, list(source_id ORDER BY seq)[2:] AS s,
      arg_min(published_at, seq) FILTER (WHERE published_at IS NOT NULL) AS published_at, arg_min(summary, seq) FILTER (WHERE summary IS NOT NULL) AS summary FROM k GROUP BY key)
SELECT seq, url, CAST(epoch_us(published_at) AS BIGINT) AS published_us, coalesce(summary, '') AS summary, CAST(len(u) AS INTEGER) AS n_mentions,
  array_to_string(list_transform(range(1, len(u) + 1), lambda i: s[i] || '=' || u[i]), ' ') AS mentions FROM g
""")
def url_dedupe_mentions(spark, sf_dir):
    merged = dedupe.merge_mentions(_articles(spark, sf_dir))
    joined = F.array_join(F.transform("mentions", lambda m: F.concat(m["source_id"], F.lit("="), m["url"])), " ")
    return merged.select("seq", "url", F.unix_micros("published_at").alias("published_us"), "summary", F.size("mentions").alias("n_mentions"), joined.alias("mentions"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_text_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


_UNESCAPE = "x"
for _entity, _sign in texts.ENTITIES.items():
    _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_STRIP = f"trim(regexp_replace({_UNESCAPE}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query(f"SELECT page_id, {_STRIP} AS body FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS x FROM pages)")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.strip_html(F.col("html")).alias("body"))


@query(f"SELECT page_id, CASE WHEN length(b) > 500 THEN substr(b, 1, 500) || '...' ELSE b END AS summary FROM (SELECT page_id, {_STRIP} AS b FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS x FROM pages))")
def summary_truncate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.shorten(texts.strip_html(F.col("html"))).alias("summary"))


@query("SELECT event_id, user_id FROM events WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-05 16:00:00' AND TIMESTAMP '2024-01-06 15:59:59'")
def time_window_filter(spark, sf_dir):
    since, until = times.day_window("2024-01-06", "UTC+8")
    utc = lambda t: t.astimezone(times.zone("UTC")).replace(tzinfo=None)
    return table(spark, sf_dir, "events").where(times.inside(F.col("ts"), utc(since), utc(until))).select("event_id", "user_id")


@query("SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, count(*) AS items FROM events GROUP BY 1")
def gmt8_date_distribution(spark, sf_dir):
    return profile.count_by(table(spark, sf_dir, "events"), times.gmt8_date(F.col("ts")), "date")


def _score_sql(words) -> str:
    return " + ".join("CASE WHEN regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}_])" + w.replace(" ", "\\s+") + "($|[^\\p{L}\\p{N}_])') THEN " + str(n) + " ELSE 0 END" for w, n in words)


_TOPICS = "SELECT doc_id, greatest(" + ", ".join(f"s{k}" for k in range(len(KEYWORDS))) + ") AS topic_score, " + ", ".join(f"s{k}" for k in range(len(KEYWORDS))) + " FROM (SELECT doc_id, " + ", ".join(f"{_score_sql(w)} AS s{k}" for k, w in enumerate(KEYWORDS.values())) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"
_TOPIC = "CASE WHEN topic_score < 2 THEN 'other' " + " ".join(f"WHEN s{k} = topic_score THEN '{t}'" for k, t in enumerate(KEYWORDS)) + " END"


@query(f"SELECT doc_id, CAST(topic_score AS INTEGER) AS topic_score, {_TOPIC} AS topic FROM ({_TOPICS})")
def topic_classify(spark, sf_dir):
    return classify.classify(table(spark, sf_dir, "documents"), ["text"], KEYWORDS).select("doc_id", "topic_score", "topic")


@query(f"SELECT t AS topic, CAST(o - 1 AS INTEGER) AS topic_order, count(doc_id) AS items FROM (SELECT unnest({[*KEYWORDS, 'other']!r}) AS t, generate_subscripts({[*KEYWORDS, 'other']!r}, 1) AS o) LEFT JOIN (SELECT doc_id, {_TOPIC} AS topic FROM ({_TOPICS})) ON t = topic GROUP BY 1, 2")
def topic_counts(spark, sf_dir):
    return classify.counts_by_topic(topic_classify(spark, sf_dir), [*KEYWORDS, "other"])


@query("""
WITH s AS (SELECT event_id, event_type,
  round(greatest(0, 100 - 2 * ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9)) + (user_id % 10) * 10 * 0.5 + (event_id % 4) * 5 * 0.3, 6) AS score FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) AS group_rank FROM s QUALIFY group_rank <= 5)
SELECT event_id, event_type, score, CAST(group_rank AS INTEGER) AS group_rank, CAST(row_number() OVER (ORDER BY event_type, group_rank) AS INTEGER) AS place FROM g QUALIFY place <= 20
""")
def recency_topk_global_cap(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    score = posts.article_score(F.col("ts").cast("timestamp"), F.col("user_id") % 10, F.col("event_id") % 4, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    rows = events.select("event_id", "event_type", F.round(score, 6).alias("score"))
    return rank.capped(rows, "event_type", "event_type", 5, 20, F.desc("score"), F.col("event_id")).select("event_id", "event_type", "score", "group_rank", "place")


@query("""
WITH m AS (SELECT l_partkey, count(*) AS likes, count(*) FILTER (WHERE l_returnflag = 'R') AS reposts, count(*) FILTER (WHERE l_linestatus = 'O') AS marks FROM lineitem GROUP BY 1),
s AS (SELECT p_partkey, coalesce(likes, 0) + 3 * coalesce(reposts, 0) + 2 * coalesce(marks, 0) AS score FROM part LEFT JOIN m ON p_partkey = l_partkey)
SELECT p_partkey, score, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM s QUALIFY rank <= 20
""")
def engagement_topk(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("likes"), F.count_if(F.col("l_returnflag") == "R").alias("reposts"), F.count_if(F.col("l_linestatus") == "O").alias("marks"))
    rows = table(spark, sf_dir, "part").select("p_partkey").join(m, "p_partkey", "left")
    scored = rows.select("p_partkey", posts.engagement(F.col("likes"), F.col("reposts"), F.col("marks")).alias("score"))
    return rank.top(scored, 20, F.desc("score"), F.col("p_partkey"))


@query("""
WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, n_name, o_orderkey AS last_order, o_totalprice AS last_price FROM customer LEFT JOIN l ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def latest_per_key_dim_join(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    out = table(spark, sf_dir, "customer").join(last, "c_custkey", "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", "n_name", F.col("o.o_orderkey").alias("last_order"), F.col("o.o_totalprice").alias("last_price"))


def _days(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    day = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.to_date("ts").alias("d"))
    return tuple(day.where(F.col("d") == F.lit(d).cast("date")).select("id").distinct() for d in ("2024-01-03", "2024-01-02"))


_DAY = "SELECT DISTINCT user_id AS id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-0{}'"


@query(f"{_DAY.format(3)} EXCEPT {_DAY.format(2)}")
def snapshot_new(spark, sf_dir):
    return merge.added(*_days(spark, sf_dir), "id")


@query(f"{_DAY.format(2)} EXCEPT {_DAY.format(3)}")
def snapshot_removed(spark, sf_dir):
    return merge.removed(*_days(spark, sf_dir), "id")


@query(f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'following' ELSE 'bookmark' END AS source FROM ({_DAY.format(3)}) a FULL JOIN ({_DAY.format(2)}) b ON a.id = b.id")
def source_tag_merge(spark, sf_dir):
    return merge.tag_sources(*_days(spark, sf_dir), "id", ("following", "bookmark"))


@query("""
WITH u AS (SELECT 0 AS b, o_custkey AS id, o_orderkey, o_totalprice FROM orders WHERE o_orderdate < DATE '1998-01-01' UNION ALL SELECT 1, o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01')
SELECT id, o_orderkey, o_totalprice FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY b DESC, o_orderkey DESC) = 1
""")
def upsert_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    part = lambda c: orders.where(c).select("id", "o_orderkey", "o_totalprice")
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")
    return merge.upsert(part(~late), part(late), "id", "o_orderkey")


@query("SELECT s_nationkey AS id, 'supplier' AS kind FROM (SELECT DISTINCT s_nationkey FROM supplier) UNION ALL SELECT n_nationkey, 'nation' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def insert_absent(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")).distinct().withColumn("kind", F.lit("supplier"))
    return merge.insert_absent(own, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("nation").alias("kind")), "id")


@query("SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 AND conv_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) END AS thread_position FROM conversations")
def conversation_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("seq", F.col("turn"))
    return rank.thread_positions(rows, "conv_id", "turn", "seq").select("conv_id", "turn", "thread_position")


@query("SELECT CAST(h AS INTEGER) AS hour, count(ts) AS posts FROM range(24) AS r(h) LEFT JOIN events ON hour(ts) = h AND event_type = 'error' GROUP BY 1")
def hour_histogram_zero_filled(spark, sf_dir):
    return profile.hour_histogram(table(spark, sf_dir, "events").where("event_type = 'error'"), "ts")


@query("SELECT CAST(arg_max(h, c * 100 - h) AS INTEGER) AS hour FROM (SELECT hour(ts) AS h, count(*) AS c FROM events GROUP BY 1)")
def most_active_hour(spark, sf_dir):
    return profile.most_active_hour(table(spark, sf_dir, "events"), "ts")


_CJK = "一-鿿"


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', '', 'g'), '[^a-z0-9_{_CJK}]', ' ', 'g'), '\\s+')) AS w FROM documents) WHERE length(w) >= 2 AND NOT list_contains({sorted(set(texts.STOP_WORDS))!r}, w) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def vocabulary_top50(spark, sf_dir):
    return profile.top_words(table(spark, sf_dir, "documents"), "text", 50)


@query("WITH l AS (SELECT length(coalesce(text, '')) AS n FROM documents) SELECT CAST(floor(avg(n) + 0.5) AS BIGINT) AS avg_chars, list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_chars, min(n) AS min_chars, max(n) AS max_chars FROM l")
def length_stats_upper_median(spark, sf_dir):
    return profile.length_stats(table(spark, sf_dir, "documents"), "text")


@query("WITH k AS (SELECT CASE WHEN length(text) % 3 = 0 THEN '中 ' || text ELSE text END AS t FROM conversations), c AS (SELECT regexp_matches(t, '[一-鿿]') AS z, regexp_matches(t, '[a-zA-Z]{3,}') AS e FROM k) SELECT CAST(floor(count(*) FILTER (WHERE z AND NOT e) / count(*) * 100 + 0.5) AS BIGINT) AS chinese, CAST(floor(count(*) FILTER (WHERE NOT z) / count(*) * 100 + 0.5) AS BIGINT) AS english, CAST(floor(count(*) FILTER (WHERE z AND e) / count(*) * 100 + 0.5) AS BIGINT) AS mixed FROM c")
def language_mix(spark, sf_dir):
    text = F.when(F.length("text") % 3 == 0, F.concat(F.lit("中 "), F.col("text"))).otherwise(F.col("text"))
    return profile.language_shares(table(spark, sf_dir, "conversations").select(text.alias("text")), "text")


@query("""
WITH e AS (SELECT event_id AS s, event_type AS issue FROM events JOIN labels ON doc_id = user_id WHERE quality = 0)
SELECT issue, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, min(s) LIMIT 12
""")
def issue_top12(spark, sf_dir):
    log = table(spark, sf_dir, "events").join(table(spark, sf_dir, "labels"), F.col("user_id") == F.col("doc_id"))
    rows = log.select(F.col("event_id").alias("seq"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("label"), F.array("event_type").alias("issues"), F.lit(None).cast("struct<text:string,issues:array<string>>").alias("feedback"))
    return qalog.top_issues(rows)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM labels")
def label_totals(spark, sf_dir):
    return qalog.totals(table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, " Good").when(F.col("quality") == 0, "BAD_case").alias("label")))


_TITLES = "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS s FROM documents"
_LIKE = f"""t AS ({_TITLES}), u AS (SELECT min(doc_id) AS doc_id, s FROM t WHERE len(s) > 0 GROUP BY s), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM u),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL)"""


@query(f"WITH {_LIKE} SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM p WHERE k / (na + nb - k) >= 0.9")
def jaccard_pairs(spark, sf_dir):
    return dedupe.similar_title_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 0.9).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_TITLES.join(('t AS (', ')'))} SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM t WHERE len(s) > 0")
def title_classes(spark, sf_dir):
    """The membership that goes with jaccard_pairs."""
    return dedupe.title_sets(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "rep")


@query(f"WITH {_LIKE}, c AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN doc_id * 600 END AS at FROM documents) SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE k / (na + nb - k) >= 0.9 AND coalesce(abs(x.at - y.at) <= 172800, true)")
def close_title_pairs(spark, sf_dir):
    """Titles alike whose times lie close, an unknown time being close to all."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 > 0, F.timestamp_seconds(F.col("doc_id") * 600)).alias("at"), "text")
    return dedupe.close_title_pairs(rows, "id", "text", "at", 0.9, 48)


_GREEDY = f"""
WITH RECURSIVE {_LIKE}, q AS (SELECT a, b FROM p WHERE k / (na + nb - k) >= 0.9),
c AS (SELECT t.doc_id, u.doc_id AS rep FROM t JOIN u ON t.s = u.s),
e AS (SELECT c.doc_id AS id, list(d.doc_id) AS near FROM c JOIN (SELECT a, b FROM q UNION ALL SELECT b, a FROM q UNION ALL SELECT doc_id, doc_id FROM u) l ON l.a = c.rep JOIN c d ON d.rep = l.b AND d.doc_id < c.doc_id GROUP BY c.doc_id),
i AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS id, CASE WHEN doc_id % 7 > 0 THEN doc_id * 600 END AS w, coalesce(near, []) AS near FROM documents LEFT JOIN e ON id = doc_id),
r AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader, CAST([] AS STRUCT(id BIGINT, w BIGINT)[]) AS leads
  UNION ALL
  SELECT m.i, m.id, coalesce(m.found.id, m.id), CASE WHEN m.found IS NULL THEN list_append(m.leads, {{'id': m.id, 'w': m.w}}) WHEN m.found.w IS NULL THEN list_transform(m.leads, lambda l: CASE WHEN l.id = m.found.id THEN {{'id': l.id, 'w': m.w}} ELSE l END) ELSE m.leads END
  FROM (SELECT i.i, i.id, i.w, r.leads, list_filter(r.leads, lambda l: list_contains(i.near, l.id) AND (i.w IS NULL OR l.w IS NULL OR abs(i.w - l.w) <= 172800))[1] AS found FROM r JOIN i ON i.i = r.i + 1) m
)
SELECT id AS seq, leader FROM r WHERE id IS NOT NULL
"""


@query(_GREEDY)
def title_similarity_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("title"), F.when(F.col("doc_id") % 7 > 0, F.timestamp_seconds(F.col("doc_id") * 600)).alias("published_at"))
    shared_folder(spark)
    return dedupe.greedy_title_groups(rows, threshold=0.9, hours=48)


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS known FROM events GROUP BY 1")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k.try_cast("long")).alias("total"), F.count(k).alias("known"))


@query("SELECT w AS word, count(*) AS parts, min(p_partkey) AS first_part FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def explode_array(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query("""
WITH base AS (SELECT o_custkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= DATE '1998-01-01'),
agg AS (SELECT o_custkey, CAST(sum(CAST(revenue AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(*) AS lines FROM base GROUP BY 1)
SELECT c_custkey AS customer, n_name AS nation, revenue, lines FROM agg JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def base_agg_dim_final(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("date"))
    base = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_custkey", "c_custkey")
    customers = shapes.latest_rows(table(spark, sf_dir, "customer"), ["c_custkey"], "c_acctbal").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    measures = {"revenue": F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double"), "lines": F.count("*")}
    return shapes.report(base, ["c_custkey"], measures, [(customers, ["c_custkey"]), (nations, ["n_nationkey"])], {"customer": "c_custkey", "nation": "n_name", "revenue": "revenue", "lines": "lines"}, [F.desc("revenue"), F.col("customer")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def latest_partition(spark, sf_dir):
    return shapes.latest_partition(table(spark, sf_dir, "orders").withColumn("dt", F.to_date("o_orderdate")), "dt").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS dt FROM orders WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)")
def latest_stored_partition(spark, sf_dir):
    """Orders stored by month; the last month is the only folder read."""
    path = scratch(spark, "months")
    shapes.store_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("dt")), "dt", path)
    return shapes.latest_stored_partition(spark, path, "dt").select("o_orderkey", "o_custkey", F.col("dt").cast("string").alias("dt"))


@query("""
SELECT user_id, 'all' AS logic FROM events GROUP BY 1 HAVING bool_or(event_type = 'error') AND bool_or(value > 50) UNION ALL
SELECT DISTINCT user_id, 'any' FROM events WHERE event_type = 'error' OR value > 50
""")
def intersect_vs_union(spark, sf_dir):
    events, conditions = table(spark, sf_dir, "events"), [F.col("event_type") == "error", F.col("value") > 50]
    both = shapes.having_all(events, "user_id", conditions).withColumn("logic", F.lit("all"))
    return both.unionByName(shapes.having_any(events, "user_id", conditions).withColumn("logic", F.lit("any")))


@query("""
SELECT 'rank' AS policy, p_partkey, p_brand, p_size, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS place FROM part QUALIFY place <= 3 UNION ALL
SELECT 'dense_rank', p_partkey, p_brand, p_size, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS place FROM part QUALIFY place <= 3 UNION ALL
SELECT 'row_number', p_partkey, p_brand, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 3
""")
def topn_ties(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    one = lambda p: rank.ties(part, 3, "p_brand", "p_size", p, F.col("p_partkey")).withColumn("policy", F.lit(p))
    return one("rank").unionByName(one("dense_rank")).unionByName(one("row_number")).select("policy", "p_partkey", "p_brand", "p_size", "place")


def _case(rules, column: str, other: str) -> str:
    plain = lambda p: p.replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])")
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{plain(p)}') THEN '{k}'" for k, p in rules.items()) + f" ELSE '{other}' END"


_SAID = "CASE conv_id % 9 WHEN 0 THEN 'New LLM: ' WHEN 1 THEN '用ai写 ' WHEN 2 THEN 'Docker, kubernetes. ' WHEN 3 THEN 'the launch ' WHEN 4 THEN 'UX ' WHEN 5 THEN 'Founder ' WHEN 6 THEN '论文 arxiv ' WHEN 7 THEN '数据 ' ELSE '' END || text"


def _said(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("text"))


@query(f"SELECT category, count(*) AS items, min(conv_id * 1000 + turn) AS first_seq FROM (SELECT conv_id, turn, {_case(posts.CATEGORIES, 't', 'Other')} AS category FROM (SELECT conv_id, turn, coalesce({_SAID}, '') AS t FROM conversations)) GROUP BY 1")
def content_categories(spark, sf_dir):
    rows = _said(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), posts.category(F.col("text")).alias("category"))
    return profile.by_category(rows, "category", "seq")


_ANGLE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in posts.ANGLES.items()) + " END"


@query(f"SELECT conv_id, turn, kind, {_ANGLE} AS angle FROM (SELECT conv_id, turn, {_case(posts.CONTENT_TYPES, 't', posts.OTHER_CONTENT)} AS kind FROM (SELECT conv_id, turn, {_SAID} AS t FROM conversations))")
def content_type_angle(spark, sf_dir):
    kind = posts.content_type(F.col("text"))
    return _said(spark, sf_dir).select("conv_id", "turn", kind.alias("kind"), posts.rewrite_angle(kind).alias("angle"))


@query("""
SELECT c.conv_id * 1000 + c.turn AS id, CASE WHEN c.turn = 0 THEN CASE WHEN c.conv_id % 3 = 0 THEN '长文' ELSE '原创' END WHEN c.turn % 5 = 4 THEN '引用' WHEN p.role = c.role THEN '线程' ELSE '回复' END AS tweet_type,
  CASE WHEN c.turn > 0 THEN c.conv_id * 1000 + c.turn - 1 END AS original_id, CASE WHEN c.turn > 0 THEN coalesce('@' || p.role, '') END AS original_user, CASE WHEN c.turn > 0 THEN substr(coalesce(p.text, ''), 1, 2000) END AS original_text
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
""")
def post_types(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    ref = F.struct(F.when(F.col("turn") % 5 == 4, "quoted").otherwise("replied_to").alias("type"), (id_ - 1).cast("string").alias("id"))
    note = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), F.struct(F.col("text").alias("text")))
    rows = turns.select(id_.cast("string").alias("id"), "text", F.col("role").alias("author_id"), F.lit(None).cast("string").alias("in_reply_to_user_id"), note.alias("note_tweet"), F.when(F.col("turn") > 0, F.array(ref)).alias("referenced_tweets"))
    users = turns.select(F.col("role").alias("id"), F.concat(F.lit("@"), F.col("role")).alias("username")).distinct()
    out = archive.typed(rows, rows, users)
    o = F.col("original_tweet")
    return out.select(F.col("id").cast("long").alias("id"), "tweet_type", o["id"].cast("long").alias("original_id"), o["author_username"].alias("original_user"), o["text"].alias("original_text"))


@query("SELECT user_id, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, CASE WHEN max(CAST(ts AS DATE)) = (SELECT max(CAST(ts AS DATE)) FROM events) THEN 'active' ELSE 'unfollowed' END AS status FROM events GROUP BY 1")
def status_over_snapshots(spark, sf_dir):
    return merge.status_over_snapshots(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date")), "user_id", "date")


_WEEKS = "SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events WHERE user_id IS NOT NULL AND event_type = 'error'"


@query(f"""
WITH w AS ({_WEEKS}), n AS (SELECT week, row_number() OVER (ORDER BY week) AS i FROM (SELECT DISTINCT week FROM w)),
g AS (SELECT user_id, w.week, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM w JOIN n ON n.week = w.week)
SELECT user_id, CAST(min(week) AS VARCHAR) AS first_seen, CAST(max(week) AS VARCHAR) AS last_seen, CASE WHEN max(i) = (SELECT max(i) FROM n) THEN 'active' ELSE 'unfollowed' END AS status, count(DISTINCT run) AS intervals FROM g GROUP BY user_id
""")
def status_from_intervals(spark, sf_dir):
    """Weekly snapshots merged one after the other into intervals; earlier ones are never read again."""
    path = scratch(spark, "history")
    weeks = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).distinct().checkpoint()
    for day in sorted(r["week"] for r in weeks.select("week").distinct().collect()):  # the snapshots' days
        history.merge_snapshot(weeks.where(F.col("week") == day), path, "user_id", day)
    return history.status(spark, path, "user_id")


@query("""
WITH t AS (SELECT DISTINCT 'u' || user_id AS u FROM events WHERE event_type = 'click'), p AS (SELECT DISTINCT 'u' || user_id AS u FROM events WHERE event_type = 'error'),
yes AS (SELECT u FROM p WHERE CAST(substr(u, 2) AS BIGINT) % 2 = 0), no AS (SELECT u FROM p WHERE CAST(substr(u, 2) AS BIGINT) % 5 = 0)
SELECT 'tracked' AS list, u AS username FROM (SELECT u FROM t UNION SELECT u FROM yes) WHERE u NOT IN (SELECT u FROM no) UNION ALL
SELECT 'pending', u FROM p WHERE u NOT IN (SELECT u FROM yes) AND u NOT IN (SELECT u FROM no) UNION ALL SELECT 'include', u FROM yes WHERE u NOT IN (SELECT u FROM no) UNION ALL SELECT 'exclude', u FROM no
""")
def curation_lists(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of = lambda kind, every=1: events.where((F.col("event_type") == kind) & (F.col("user_id") % every == 0)).select(F.concat(F.lit("@U"), F.col("user_id").cast("string")).alias("username")).distinct()
    none = of("none")
    lists = merge.curate(of("click"), of("error"), none, none, approve=of("error", 2), reject=of("error", 5))
    parts = [df.select(F.lit(name).alias("list"), "username") for name, df in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT page_id, 'f' || page_id AS source_id, url AS raw, CAST(epoch_us(TIMESTAMP '2024-01-02 03:04:05') AS BIGINT) + page_id * 86400000000 AS published_us, len(list_distinct(['a', 'b', 'c', 'd', 'e'])) AS n_tags FROM pages")
def feed_articles(spark, sf_dir):
    """Every page as an RSS document of one item, read back by the feed parser."""
    pages = table(spark, sf_dir, "pages")
    link = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    day = F.date_format(F.date_add(F.lit("2024-01-02").cast("date"), F.col("page_id").cast("int")), "d MMM yyyy")
    item = F.concat(F.lit("<item><title>"), link, F.lit("</title><link>"), link, F.lit("</link><pubDate>Tue, "), day, F.lit(" 03:04:05 GMT</pubDate>"), *(F.lit(f"<category>{c}</category>") for c in "abcdef"), F.lit("</item>"))
    landed = pages.select(F.col("page_id").alias("seq"), F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("source_id"), "url", F.concat(F.lit("<?xml version='1.0'?><rss><channel>"), item, F.lit("</channel></rss>")).alias("content"))
    items, _ = feeds.parse(landed)
    return items.select(F.shiftright("seq", feeds.ITEM_BITS).alias("page_id"), "source_id", F.col("title").alias("raw"), F.unix_micros("published_at").alias("published_us"), F.size("tags").cast("long").alias("n_tags"))


def _flagship(spark, sf_dir) -> DataFrame:
    ask = digest.Digest(reference=REFERENCE, keywords={"research": [("page", 2)], "product": [("summary", 3)]})
    return digest.select(_articles(spark, sf_dir), ask)


@query("SELECT c_custkey, CASE WHEN c_custkey * 997 >= 1000000 THEN format('{:.1f}M', c_custkey * 997 / 1000000) WHEN c_custkey * 997 >= 1000 THEN format('{:.1f}K', c_custkey * 997 / 1000) ELSE CAST(c_custkey * 997 AS VARCHAR) END AS followers FROM customer")
def follower_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", posts.short_count(F.col("c_custkey") * 997).alias("followers"))

