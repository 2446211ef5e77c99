"""Registered queries on archives of posts, snapshots, sinks and incremental loads, with their DuckDB twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import posts as P
from .operators import merge, profile, rank
from .plans import archive, qalog
from .queries import _DAY, _days, query, table
from .session import scratch, shared_folder
from .sources import sinks
from .streaming import incremental, stateful

_HOUR = "(conv_id * 7 + turn) % 24"


def _posts(spark, sf_dir) -> DataFrame:
    """Turns as posts: every sixth turn a retweet, metrics for every other conversation, tags, links, articles and media."""
    turn, conv = F.col("turn"), F.col("conv_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (conv % 3).cast("int"))
    created = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad(((conv * 7 + turn) % 24).cast("string"), 2, "0"), F.lit(":30:00.000Z"))
    kind = F.when(turn % 6 == 5, "retweeted").when(turn % 6 == 4, "replied_to").when(turn % 6 == 3, "quoted")
    link = F.struct(F.lit("https://t.co/x").alias("url"), F.when(conv % 8 == 0, "https://x.com/i/articles/1").otherwise("https://e.org/").alias("expanded_url"))
    metrics = F.struct(conv.alias("like_count"), turn.alias("retweet_count"), (turn % 2).alias("reply_count"), F.lit(0).cast("long").alias("quote_count"), F.when(turn % 3 == 0, conv % 5).alias("bookmark_count"), F.lit(1).cast("long").alias("impression_count"))
    tag = lambda t: F.struct(t.alias("tag"))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(
        (conv * 1000 + turn).cast("string").alias("id"), "text", F.lit(None).cast("string").alias("full_text"), created.alias("created_at"), F.col("role").alias("author_id"),
        F.when(turn % 6 == 4, "someone").alias("in_reply_to_user_id"), conv.cast("string").alias("conversation_id"), F.when(conv % 2 == 0, metrics).alias("public_metrics"), F.lit(None).cast("struct<text:string>").alias("note_tweet"),
        F.when(kind.isNotNull(), F.array(F.struct(kind.alias("type"), F.lit("1").alias("id")))).alias("referenced_tweets"),
        F.struct(F.array(tag(F.upper("role")), tag(F.concat(F.lit("C"), (conv % 5).cast("string")))).alias("hashtags"), F.when(conv % 4 == 0, F.array(link)).alias("urls")).alias("entities"),
        F.struct(F.when(turn % 3 == 0, F.array(F.lit("m"))).alias("media_keys")).alias("attachments"), F.when(turn % 6 == 4, P.REPLY).otherwise(P.ORIGINAL).alias("tweet_type"),
    )


_TURNS = f"SELECT *, conv_id * 1000 + turn AS id, conv_id % 3 AS day, {_HOUR} AS hour FROM conversations WHERE text IS NOT NULL"
_OWN = f"SELECT * FROM ({_TURNS}) WHERE turn % 6 <> 5"


@query(f"SELECT id, turn % 6 = 5 AS is_retweet, turn % 6 = 4 AS is_reply, conv_id % 8 = 0 AS is_article FROM ({_TURNS})")
def post_flags(spark, sf_dir):
    return archive.flags(_posts(spark, sf_dir)).select(F.col("id").cast("long").alias("id"), "is_retweet", "is_reply", "is_article")


@query(f"SELECT tag, count(*) AS n FROM (SELECT lower(role) AS tag FROM ({_OWN}) UNION ALL SELECT 'c' || (conv_id % 5) FROM ({_OWN})) GROUP BY tag")
def style_hashtags(spark, sf_dir):
    return archive.style(_posts(spark, sf_dir))["hashtags"]


@query(f"SELECT round(avg(conv_id), 6) AS avg_likes, round(avg(turn), 6) AS avg_retweets, round(avg(turn % 2), 6) AS avg_replies, CAST(sum(conv_id) AS BIGINT) AS total_likes FROM ({_OWN}) WHERE conv_id % 2 = 0")
def style_engagement(spark, sf_dir):
    found = archive.style(_posts(spark, sf_dir))["engagement"]
    return found.select(*(F.round(c, 6).alias(c) for c in ("avg_likes", "avg_retweets", "avg_replies")), "total_likes")


@query(f"""
SELECT count(*) FILTER (WHERE conv_id % 8 = 0) AS articles, count(*) FILTER (WHERE conv_id % 8 > 0 AND turn % 3 = 0) AS with_media,
  count(*) FILTER (WHERE conv_id % 8 = 4 AND turn % 3 > 0) AS with_links, count(*) FILTER (WHERE conv_id % 4 > 0 AND turn % 3 > 0) AS text_only FROM ({_OWN})
""")
def style_content_kinds(spark, sf_dir):
    return archive.style(_posts(spark, sf_dir))["content"]


@query(f"""
WITH o AS ({_OWN}), h AS (SELECT hour, count(*) AS c FROM o GROUP BY hour)
SELECT (SELECT CAST(max(length(text)) AS BIGINT) FROM o) AS longest, (SELECT CAST(arg_max(hour, c * 100 - hour) AS BIGINT) FROM h) AS hour, 24 AS hours, 50 AS words, (SELECT count(*) FROM o WHERE conv_id % 8 = 0) AS articles,
  (SELECT w FROM (SELECT unnest(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', '', 'g'), '[^a-z0-9_一-鿿]', ' ', 'g'), '\\s+')) AS w FROM o) WHERE length(w) >= 2 AND w NOT IN (SELECT unnest({sorted(set(profile.STOP_WORDS))!r})) GROUP BY w ORDER BY count(*) DESC, w LIMIT 1) AS first_word
""")
def style_document(spark, sf_dir):
    """The profile as one JSON document, and some of what it says."""
    at = lambda path, kind="long": F.get_json_object("json", path).cast(kind)
    listed = lambda path: F.json_array_length(F.get_json_object("json", path))
    return archive.style_document(_posts(spark, sf_dir)).select(
        at("$.length.max_chars").alias("longest"), at("$.most_active.hour").alias("hour"), listed("$.hours").alias("hours"), listed("$.vocabulary").alias("words"), at("$.content.articles").alias("articles"), at("$.vocabulary[0].word", "string").alias("first_word")
    )


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _posts(spark, sf_dir)
    conv = F.col("conversation_id").cast("long")
    return rows.where(conv % 3 < 2), rows.where(conv % 3 > 0)


_SCORED = f"SELECT id, conv_id, turn, text, role, CASE conv_id % 3 WHEN 0 THEN 'following' WHEN 1 THEN 'both' ELSE 'bookmark' END AS source, CASE WHEN conv_id % 2 = 0 THEN conv_id + 3 * turn + 2 * CASE WHEN turn % 3 = 0 THEN conv_id % 5 ELSE 0 END ELSE 0 END AS score, DATE '2024-01-01' + CAST(day AS INTEGER) + CASE WHEN hour >= 16 THEN 1 ELSE 0 END AS date FROM ({_TURNS})"
_TODAY = f"SELECT * FROM ({_SCORED}) WHERE turn % 6 <> 4 AND date = DATE '2024-01-02'"


@query(f"SELECT id, source, CAST(score AS BIGINT) AS score FROM ({_TODAY})")
def day_posts(spark, sf_dir):
    """Posts of two lists on a day of GMT+8, without replies, with where they come from."""
    return archive.scored(*_lists(spark, sf_dir), "2024-01-02")[0].select(F.col("id").cast("long").alias("id"), "source", F.col("score").cast("long").alias("score"))


@query(f"SELECT count(*) FILTER (WHERE turn % 6 = 4) AS replies, count(*) FILTER (WHERE turn % 6 <> 4 AND date <> DATE '2024-01-02') AS other_days, count(*) FILTER (WHERE turn % 6 <> 4 AND date = DATE '2024-01-02') AS kept FROM ({_SCORED})")
def day_report(spark, sf_dir):
    return archive.scored(*_lists(spark, sf_dir), "2024-01-02")[1]


_RANKED = f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, CAST(id AS VARCHAR)) AS INTEGER) AS rank FROM ({_TODAY}) QUALIFY rank <= 10"


@query(f"SELECT rank, id, text, CAST(score AS BIGINT) AS score, false AS is_link_only, CASE WHEN conv_id % 8 = 0 THEN 'https://x.com/i/articles/1' WHEN conv_id % 4 = 0 THEN 'https://e.org/' END AS expanded_url FROM ({_RANKED})")
def rewrite_rows(spark, sf_dir):
    found = archive.rewrite_candidates(archive.scored(*_lists(spark, sf_dir), "2024-01-02")[0])
    return found.select("rank", F.col("id").cast("long").alias("id"), "text", F.col("score").cast("long").alias("score"), "is_link_only", "expanded_url")


@query(f"SELECT '2024-01-02' AS date, count(*) AS n, max(CASE WHEN rank = 1 THEN id END) AS first_id, max(CASE WHEN rank = 10 THEN id END) AS last_id FROM ({_RANKED})")
def rewrite_document(spark, sf_dir):
    at = lambda path: F.get_json_object("json", path)
    found = archive.rewrite_document(archive.scored(*_lists(spark, sf_dir), "2024-01-02")[0], "2024-01-02")
    return found.select(at("$.date").alias("date"), at("$.count").cast("long").alias("n"), at("$.tweets[0].id").cast("long").alias("first_id"), at("$.tweets[9].id").cast("long").alias("last_id"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(coalesce(text, '')), 'thin') OR contains(lower(coalesce(text, '')), 'über') OR contains(lower(role), 'assist')")
def related_posts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("content"), F.col("role").alias("displayName"))
    return archive.related(rows, ("Thin", "ÜBER", "assist")).select("conv_id", "turn")


@query(f"SELECT role AS author_id, arg_max(id, (day * 100 + hour) * 100000000 + id) AS latest_id, max(id) AS largest_id FROM ({_TURNS}) GROUP BY role")
def newest_ids(spark, sf_dir):
    return archive.newest_ids(_posts(spark, sf_dir)).select("author_id", F.col("latest_id").cast("long").alias("latest_id"), F.col("largest_id").cast("long").alias("largest_id"))


_STATUS = "SELECT user_id, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, CASE WHEN max(CAST(ts AS DATE)) = (SELECT max(CAST(ts AS DATE)) FROM events) THEN 'active' ELSE 'unfollowed' END AS status FROM events GROUP BY 1"


@query(f"""
SELECT 'active_follows' AS view, CAST(user_id AS VARCHAR) AS key, first_seen AS day FROM ({_STATUS}) WHERE status = 'active' UNION ALL SELECT 'recent_unfollows', CAST(user_id AS VARCHAR), last_seen FROM ({_STATUS}) WHERE status = 'unfollowed'
UNION ALL SELECT 'bookmarks_by_category', p_type || ' ' || count(*), NULL FROM part GROUP BY p_type UNION ALL SELECT 'ai_bookmarks', CAST(p_partkey AS VARCHAR), NULL FROM part WHERE contains(p_type, 'AI/ML')
""")
def saved_views(spark, sf_dir):
    status = merge.status_over_snapshots(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("username"), F.to_date("ts").alias("date")), "username", "date")
    archive.views(spark, status, table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category")))
    return spark.sql("""
        SELECT 'active_follows' AS view, username AS key, first_seen AS day FROM active_follows UNION ALL SELECT 'recent_unfollows', username, last_seen FROM recent_unfollows
        UNION ALL SELECT 'bookmarks_by_category', category || ' ' || count, NULL FROM bookmarks_by_category UNION ALL SELECT 'ai_bookmarks', CAST(p_partkey AS STRING), NULL FROM ai_bookmarks
    """)


@query(f"SELECT 'new' AS kind, id FROM ({_DAY.format(3)} EXCEPT {_DAY.format(2)}) WHERE id % 4 > 0 UNION ALL SELECT 'gone', id FROM ({_DAY.format(2)} EXCEPT {_DAY.format(3)})")
def follow_changes(spark, sf_dir):
    """New follows but for excluded names, and who is no longer followed."""
    now, before = (d.select("id", F.concat(F.lit("U"), F.col("id").cast("string")).alias("username")) for d in _days(spark, sf_dir))
    excluded = now.where("id % 4 = 0").select(F.concat(F.lit("@u"), F.col("id").cast("string")).alias("username"))
    new, gone = merge.new_follows(now, before, excluded), merge.removed(now, before, "id")
    return new.select(F.lit("new").alias("kind"), "id").unionByName(gone.select(F.lit("gone").alias("kind"), "id"))


@query(f"SELECT coalesce(a.id, b.id) AS id FROM ({_DAY.format(3)}) a FULL JOIN ({_DAY.format(2)}) b ON a.id = b.id")
def ids_of_both(spark, sf_dir):
    a, b = _days(spark, sf_dir)
    return merge.distinct_ids(a, b, "id")


@query("""
SELECT 'following' AS list, c_custkey AS id, c_name AS name, 'x' AS tweet_type FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0
UNION ALL SELECT 'bookmark', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '原创' END FROM customer WHERE c_custkey % 3 = 0
""")
def rebuilt_lists(spark, sf_dir):
    """Ids that were kept: follows without details go, bookmarks without stay as originals."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    ids, rich = customers.where("id % 3 = 0").select("id"), customers.where("id % 2 = 0").withColumn("tweet_type", F.lit("x"))
    following, kept = merge.rebuild(ids, rich, "id"), merge.rebuild(ids, rich, "id", {"tweet_type": P.ORIGINAL})
    return following.select(F.lit("following").alias("list"), "id", "name", "tweet_type").unionByName(kept.select(F.lit("bookmark").alias("list"), "id", "name", "tweet_type"))


@query("""
SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS seq, count(*) AS posts, arg_max(o_orderkey, (epoch_us(o_orderdate) // 86400000000) * 10000000 + o_orderkey) AS latest_id FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def users_with_posts(spark, sf_dir):
    """Tracked users in their order, without those that have no posts."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"))
    found = merge.users_with_posts(users, table(spark, sf_dir, "orders").withColumn("created", F.date_format("o_orderdate", "yyyy-MM-dd")), "o_custkey", "o_orderkey", "created")
    return rank.places_by_range(found, [], "seq").select("id", F.col("place").cast("int").alias("seq"), "posts", "latest_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS origin FROM customer")
def tracked_origins(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("username"))
    include = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("@"), F.lower("c_name")).alias("username"))
    return merge.tag_curated(users, include).select("id", "origin")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE 'changed' END AS change, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN 'segment,balance' WHEN c_custkey % 2 = 0 THEN 'segment' ELSE 'balance' END AS changed FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def changed_fields(spark, sf_dir):
    """What a snapshot changes: new rows, and rows with other values, nulls included, with the columns that differ."""
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    before = now.where("id % 10 > 0").select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("segment")).alias("segment"), F.when(F.col("id") % 3 == 0, F.col("balance") + 1).otherwise(F.col("balance")).alias("balance"))
    return merge.changed_fields(before, now, "id").select("id", "change", F.coalesce(F.array_join("changed", ","), F.lit("")).alias("changed"))


@query("SELECT user_id, event_type AS kind, count(*) AS items, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS total FROM events GROUP BY user_id, event_type")
def type_counts(spark, sf_dir):
    return profile.type_counts(table(spark, sf_dir, "events"), "user_id", "event_type").withColumnRenamed("event_type", "kind")


@query("""
WITH r AS (SELECT conv_id % 20 AS user_id, conv_id, count(*) AS posts FROM conversations GROUP BY conv_id), u AS (SELECT user_id, arg_max(posts, conv_id) AS posts FROM r GROUP BY user_id)
SELECT count(*) AS users, CAST(sum(posts) AS BIGINT) AS total FROM u
""")
def result_totals(spark, sf_dir):
    """Results by user, a later one replacing the whole row; totals anew."""
    results = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("tweets")).select((F.col("conv_id") % 20).alias("user_id"), "conv_id", "tweets")
    merged = merge.upsert(results.where("conv_id < 20"), results.where("conv_id >= 20"), "user_id", "conv_id")
    return merged.agg(F.count("*").alias("users"), F.sum(F.size("tweets")).alias("total"))


# sinks


@query("SELECT 'Customer' AS kind, substr(c_name, 1, 5) AS \"标题\", coalesce(c_mktsegment, '') AS segment, c_acctbal AS balance FROM customer")
def sink_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("kind", F.lit("Customer"))
    return sinks.sink_rows(rows, {"kind": ("kind", 100), "标题": ("c_name", 5), "segment": ("c_mktsegment", 2000), "balance": ("c_acctbal", None)})


@query("""
SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) ELSE c_name END AS "Name", lower(c_name) AS "Username", CAST(c_custkey AS VARCHAR) AS "User ID", CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS "Bio",
  CASE WHEN c_custkey % 5 > 0 THEN c_custkey ELSE 0 END AS "Followers", CAST(0 AS BIGINT) AS "Following", CASE WHEN c_custkey % 5 > 0 THEN 7 ELSE 0 END::BIGINT AS "Tweets", '' AS "Location", 'https://e.org' AS "Website",
  'active' AS "Status", '2024-01-02' AS "First Seen", '2024-01-02' AS "Last Seen", '2020-02-03' AS "Created At" FROM customer
""")
def following_payload(spark, sf_dir):
    key = F.col("c_custkey")
    metrics = F.when(key % 5 > 0, F.struct(key.alias("followers_count"), F.lit(None).cast("long").alias("following_count"), F.lit(7).alias("tweet_count")))
    users = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"), F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lower("c_name").alias("username"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("description"),
        metrics.alias("public_metrics"), F.lit(None).cast("string").alias("location"), F.lit("https://e.org").alias("url"), F.lit("2020-02-03T04:05:06.000Z").alias("created_at"),
    )
    return sinks.following_rows(users, F.lit("2024-01-02"))


@query(f"SELECT CAST(id AS VARCHAR) AS id, text, 'https://x.com/' || role || '/status/' || id AS url, CASE WHEN conv_id % 2 = 0 THEN 'likes ' || conv_id || ', reposts ' || turn || ', replies ' || (turn % 2) || ', views 1' ELSE 'likes 0, reposts 0, replies 0, views 0' END AS metrics, turn % 3 = 0 AS has_media FROM ({_TURNS})")
def bookmark_payload(spark, sf_dir):
    return sinks.bookmark_rows(_posts(spark, sf_dir).withColumn("username", F.col("author_id")))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'refused' ELSE 'written' END AS state, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN '类型,点赞' ELSE '类型' END ELSE '' END AS wrong FROM part
""")
def typed_sink_rows(spark, sf_dir):
    """Rows under the sink's typed schema; those with a select or a number that it doesn't have are refused."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("标题"), F.when(key % 4 == 0, "别的").otherwise("推文").alias("类型"), F.when(key % 12 == 0, "many").otherwise(key.cast("string")).alias("点赞"), key.cast("string").alias("Tweet ID"))
    fine, refused = sinks.typed_rows(rows)
    part = lambda df, state, wrong: df.select(F.col("Tweet ID").cast("long").alias("p_partkey"), F.lit(state).alias("state"), wrong.alias("wrong"))
    return part(fine, "written", F.lit("")).unionByName(part(refused, "refused", F.array_join("wrong", ",")))


@query("""
SELECT '| author | text | likes | link |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || c_mktsegment || ' | a \\| ' || c_name || ' | ' || c_custkey || ' | https://e.org/' || c_custkey || ' |', chr(10) ORDER BY c_custkey) AS text FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100)
""")
def posts_markdown(spark, sf_dir):
    key = F.col("c_custkey")
    posts = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("author"), F.concat(F.lit("a |\n "), "c_name").alias("text"), key.alias("likes"), F.concat(F.lit("https://e.org/"), key.cast("string")).alias("url"), key)
    return sinks.posts_table(posts, "c_custkey", 100)


@query("SELECT count(*) AS posts, count(DISTINCT event_type) AS topics, count(*) FILTER (WHERE event_type = 'error') AS products FROM events")
def card_counts(spark, sf_dir):
    return sinks.card_counts(table(spark, sf_dir, "events"), "event_type", "error")


@query("SELECT 'a' || chr(10) || '<!--S-->' || chr(10) || (SELECT string_agg(event_type || ': ' || n, chr(10) ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) || chr(10) || '<!--E-->' || chr(10) || 'b' AS text")
def marked_block(spark, sf_dir):
    """A generated block of a document replaced by counts."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").count()  # a line for each type
    body = counts.agg(F.array_join(F.sort_array(F.collect_list(F.concat("event_type", F.lit(": "), F.col("count").cast("string")))), "\n").alias("body")).first()["body"]
    return spark.createDataFrame([(sinks.replace_block("a\n<!--S-->\nold\n<!--E-->\nb", "<!--S-->", "<!--E-->", body),)], "text string")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'changed' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM labels UNION ALL SELECT -1, 'changed'")
def json_line_log(spark, sf_dir):
    """A log of JSON lines: appended twice, then updated by id, an unknown id being added."""
    path = scratch(spark, "log")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    sinks.append_lines(labels.where("id % 2 = 0"), path)
    sinks.append_lines(labels.where("id % 2 = 1"), path)
    log = spark.read.schema("id long, label string").json(path)
    changes = labels.where("id % 4 = 0").select("id", F.lit("changed").alias("label")).unionByName(spark.createDataFrame([(-1, "changed")], "id long, label string"))
    sinks.replace_table(qalog.update(log, changes), f"{path}-table")
    return sinks.read_table(spark, f"{path}-table")


@query(f"SELECT 'day' AS kind, CAST(d AS VARCHAR) AS date, count(*) AS rows FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY d UNION ALL SELECT 'latest', '2024-01-02', count(*) FROM ({_DAY.format(2)})")
def daily_snapshots(spark, sf_dir):
    """Days as partitions, one of them written twice, and the latest one as a table of its own."""
    path = scratch(spark, "days")
    days = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct()
    sinks.write_snapshot(days, path)
    sinks.write_snapshot(days.where("date = '2024-01-02'"), path, latest=f"{path}-latest")
    held = spark.read.parquet(path).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("rows"))
    latest = sinks.read_table(spark, f"{path}-latest").groupBy("date").agg(F.count("*").alias("rows"))
    return held.select(F.lit("day").alias("kind"), "date", "rows").unionByName(latest.select(F.lit("latest").alias("kind"), "date", "rows"))


@query("SELECT user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-31') GROUP BY 1")
def previous_snapshot(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct()
    return merge.previous_snapshot(days, "date", "2024-01-31").select("user_id")


# orders and limits


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, 0) DESC, c_custkey) AS INTEGER) AS place FROM customer QUALIFY place <= 50")
def most_followed(spark, sf_dir):
    users = table(spark, sf_dir, "customer").withColumn("f", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")))
    return rank.placed(rank.by_followers(users, "f", "c_custkey"), 50).select("c_custkey", "place")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '' END DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 50")
def newest_posts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("created", F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    return rank.placed(rank.newest_first(rows, "created", "event_id"), 50).select("event_id", "place")


@query("""
WITH RECURSIVE c AS (SELECT conv_id // 200 AS scan, conv_id AS round, CASE WHEN conv_id % 7 < 3 THEN 0 ELSE count(*) END AS found FROM conversations GROUP BY conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY round) AS i FROM c),
w AS (SELECT scan, i, round, found, found AS total, CASE WHEN found > 0 THEN 0 ELSE 1 END AS idle FROM n WHERE i = 1
  UNION ALL SELECT n.scan, n.i, n.round, n.found, w.total + n.found, CASE WHEN n.found > 0 THEN 0 ELSE w.idle + 1 END FROM w JOIN n ON n.scan = w.scan AND n.i = w.i + 1 WHERE NOT (w.total >= 100 OR w.total >= 50 AND w.idle >= 5 OR w.idle >= 10))
SELECT scan, round, found, CAST(total AS BIGINT) AS total, CAST(idle AS BIGINT) AS idle FROM w
""")
def scan_stop(spark, sf_dir):
    """Conversations as rounds of scans, two hundred to a scan, each up to where it stops."""
    rounds = table(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 200).alias("scan"), F.col("conv_id").alias("round")).agg(F.count("*").alias("found"))
    return rank.stop_after(rounds.withColumn("found", F.when(F.col("round") % 7 < 3, 0).otherwise(F.col("found")).cast("long")), "scan")


@query("SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, text AS full_text FROM conversations WHERE conv_id = 3 AND turn = 1 AND text IS NOT NULL")
def single_post(spark, sf_dir):
    return archive.single(_posts(spark, sf_dir), "3001").select("id", "full_text")


# incremental loads


@query("SELECT event_id, event_type FROM events")
def stream_of_new_ids(spark, sf_dir):
    """A stream of a file, each id once within the watermark, written to a table."""
    path, schema = scratch(spark, "stream"), table(spark, sf_dir, "events").schema
    stream = incremental.distinct_ids(incremental.read(spark, sf_dir, schema, names="events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", "1 hour")
    stream.select("event_id", "event_type").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upserts(spark, sf_dir):
    """A stream merged into a table by key, and once more from the start, which changes nothing."""
    path, schema = scratch(spark, "upserts"), table(spark, sf_dir, "events").schema
    for k in range(2):
        stream = incremental.read(spark, sf_dir, schema, names="events.parquet").select("user_id", "event_id", "event_type")
        incremental.upsert_into(stream, f"{path}/table", "user_id", f"{path}/c{k}", "event_id").awaitTermination()
    return sinks.read_table(spark, f"{path}/table")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 2 = 1 OR o_orderkey > (SELECT max(o_orderkey) FROM orders) // 2")
def since_cursor(spark, sf_dir):
    """Rows newer than their user's cursor; users without one give all."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_custkey")
    half = table(spark, sf_dir, "orders").agg(F.expr("max(o_orderkey) div 2").cast("string").alias("latest_id"))
    cursors = rows.where("o_custkey % 2 = 0").select("o_custkey").distinct().crossJoin(F.broadcast(half))  # one row
    return incremental.since(rows, cursors, "o_custkey").select(F.col("id").cast("long").alias("id"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def first_load(spark, sf_dir):
    """A first load goes back thirty days."""
    start = incremental.first_run_start(datetime(2024, 2, 19))
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.lit(start)).select("event_id")


@query("SELECT count(*) >= 20 AS due, count(*) AS labelled, 1 AS calls FROM labels WHERE quality IS NOT NULL")
def due_after_labels(spark, sf_dir):
    """A log that streams in, and what is called once enough of it is labelled; a batch that runs again is counted once."""
    path, calls = scratch(spark, "due"), []
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("label"))
    labels.coalesce(1).write.parquet(f"{path}/in")
    for k in range(2):
        stream = incremental.read(spark, f"{path}/in", labels.schema)
        incremental.when_due(stream, f"{path}/log", f"{path}/state", f"{path}/c{k}", lambda log: calls.append(log.count())).awaitTermination()
    yes, labelled = qalog.due(spark.read.parquet(f"{path}/log"), 0)
    return spark.createDataFrame([(yes, labelled, len(set(calls)))], "due boolean, labelled long, calls int")


@query(f"{_DAY.format(3)} EXCEPT {_DAY.format(2)}")
def rotated_baseline(spark, sf_dir):
    shared_folder(spark)
    path = scratch(spark, "baseline")
    now, before = _days(spark, sf_dir)
    new = lambda a, b: merge.added(a, b, "id")
    incremental.rotate_baseline(spark, before, path, new)
    return incremental.rotate_baseline(spark, now, path, new)


def _landings(spark, name, landings, work) -> DataFrame:
    """What a stream gives when folders of files land one after the other, and the query starts anew for each from its checkpoint."""
    path = scratch(spark, name)
    for rows in landings:
        rows.write.mode("append").parquet(f"{path}/in")
        stream = work(incremental.read(spark, f"{path}/in", rows.schema))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


@query(f"""
WITH a AS (SELECT * FROM events WHERE event_id % 3 = 0), c AS (SELECT user_id, arg_max(event_id, {_AT} || lpad(CAST(event_id AS VARCHAR), 20, '0')) AS latest FROM a GROUP BY user_id),
b AS (SELECT event_id FROM a UNION ALL SELECT event_id FROM events LEFT JOIN c ON c.user_id = events.user_id WHERE latest IS NULL OR event_id > latest)
SELECT event_id, count(*) AS times FROM b GROUP BY event_id
""")
def stream_since_cursors(spark, sf_dir):
    """A third of the events lands, then all of them: the second time, what is newer than its user's cursor."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created"))
    found = _landings(spark, "cursors", [events.where("event_id % 3 = 0"), events], lambda s: stateful.newer_than_cursors(s, "user_id", "event_id", "created"))
    return found.groupBy("event_id").agg(F.count("*").alias("times"))


@query("""
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_id % 2 = 0),
k AS (SELECT user_id, event_id AS known FROM a WHERE place = 1),
b AS (SELECT events.user_id, event_id, known, row_number() OVER (PARTITION BY events.user_id ORDER BY ts DESC, event_id DESC) AS place FROM events LEFT JOIN k ON k.user_id = events.user_id WHERE events.user_id % 5 > 0 OR known IS NULL OR event_id <> known),
e AS (SELECT user_id, min(place) AS stop FROM b WHERE event_id = known GROUP BY user_id)
SELECT 1 AS listing, event_id FROM a UNION ALL SELECT 2, event_id FROM b LEFT JOIN e ON e.user_id = b.user_id WHERE stop IS NULL OR place < stop
""")
def stream_until_known(spark, sf_dir):
    """Every user's events listed newest first, first half of them, then all: the second listing up to where the first began, which a fifth of the users have deleted."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    newest = rank.Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    listed = lambda df, k: df.select("user_id", F.lit(k).alias("listing"), F.row_number().over(newest).alias("place"), "event_id")
    first = listed(events.where("event_id % 2 = 0"), 1)
    known = first.where("place = 1 AND user_id % 5 = 0").select("event_id")
    second = listed(events.join(known, "event_id", "left_anti"), 2)
    return _landings(spark, "listings", [first, second], lambda s: stateful.until_known(s, "user_id", "listing", "place", "event_id")).select("listing", "event_id")


@query("SELECT log, unnest(range(20, n + 1, 20)) AS labelled FROM (SELECT 'log' || (doc_id % 7) AS log, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)")
def stream_due_marks(spark, sf_dir):
    """Logs that land in two parts, with a mark at every twenty labelled rows."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("log"), (F.col("doc_id") % 7).cast("string")).alias("log"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("label"))
    parts = [labels.where(f"doc_id % 2 = {k}").drop("doc_id") for k in (0, 1)]
    return _landings(spark, "marks", parts, lambda s: stateful.due_marks(s, "log", "label")).select("log", "labelled")
