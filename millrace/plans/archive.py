"""The archive of social posts: typing, digests, rewrite candidates and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import posts as P
from ..functions import times
from ..operators import merge, profile, rank

#: Words that tell posts on AI.
AI_KEYWORDS = (
    "AI", "Claude", "GPT", "LLM", "Codex", "agent", "skill", "skills", "model", "Gemini", "OpenAI", "Anthropic", "coding", "code",
    "prompt", "GLM", "Grok", "Cursor", "Remotion", "Devin", "MCP", "RAG", "embedding", "fine-tune", "RLHF", "vibe",
    "Ralphy", "Ralph", "Zed", "Kiro", "LangChain", "token", "API", "neural", "deep learning", "machine learning",
    "automation", "chatbot", "inference", "智能", "模型", "编程", "提示词", "大模型", "人工智能",
)


def typed(posts: DataFrame, referenced: DataFrame, users: DataFrame) -> DataFrame:
    """Adds full_text, tweet_type and original_tweet by what a post refers to.

    A post that replies is a thread if it answers its own author, else a
    reply; one that quotes is a quote; one with a note is long; others are
    original.  referenced (id, text, note_tweet, author_id) and users (id,
    username) are joined on the one reference that counts, so posts move once
    for each.
    """
    pick = F.coalesce(F.try_element_at(F.filter("referenced_tweets", lambda r: r["type"] == "replied_to"), F.lit(1)), F.try_element_at(F.filter("referenced_tweets", lambda r: r["type"] == "quoted"), F.lit(1)))
    out = posts.withColumn("__ref", pick)
    known = referenced.select(F.col("id").alias("__rid"), F.substring(P.full_text(F.lit(None).cast("string"), F.col("note_tweet.text"), F.col("text")), 1, 2000).alias("__rtext"), F.col("author_id").alias("__rauthor")).dropDuplicates(["__rid"])
    out = out.join(known, F.col("__ref.id") == F.col("__rid"), "left")
    replied = F.coalesce(F.col("__ref.type") == "replied_to", F.lit(False))
    answered = F.nullif("in_reply_to_user_id", F.lit(""))
    self_reply = F.coalesce(F.coalesce(answered, "__rauthor") == F.col("author_id"), F.lit(False))
    out = out.withColumn("__oauthor", F.when(replied, F.coalesce(answered, "__rauthor", F.lit(""))).otherwise(F.coalesce("__rauthor", F.lit(""))))
    names = users.select(F.col("id").alias("__uid"), F.col("username").alias("__uname")).dropDuplicates(["__uid"])
    out = out.join(names, F.col("__oauthor") == F.col("__uid"), "left")
    kind = F.when(replied & self_reply, P.THREAD).when(replied, P.REPLY).when(F.col("__ref").isNotNull(), P.QUOTE).when(F.col("note_tweet").isNotNull(), P.LONG).otherwise(P.ORIGINAL)
    original = F.when(F.col("__ref").isNotNull(), F.struct(F.col("__ref.id").alias("id"), F.coalesce("__rtext", F.lit("")).alias("text"), F.col("__oauthor").alias("author_id"), F.coalesce("__uname", F.lit("")).alias("author_username")))
    return out.withColumns({"full_text": P.full_text(F.lit(None).cast("string"), F.col("note_tweet.text"), F.col("text")), "tweet_type": kind, "original_tweet": original}).drop("__ref", "__rid", "__rtext", "__rauthor", "__oauthor", "__uid", "__uname")


def flags(posts: DataFrame) -> DataFrame:
    """Adds is_retweet, is_reply and is_article."""
    kinds = F.coalesce(F.transform("referenced_tweets", lambda r: r["type"]), F.array().cast("array<string>"))
    links = F.coalesce("entities.urls", F.expr("CAST(array() AS array<struct<url:string,expanded_url:string>>)"))
    return posts.withColumns({"is_retweet": F.array_contains(kinds, "retweeted"), "is_reply": F.array_contains(kinds, "replied_to"), "is_article": F.exists(links, lambda u: F.coalesce(F.contains(u["expanded_url"], F.lit("/articles/")), F.lit(False)))})


def own_engagement():
    m = F.col("public_metrics")
    return P.engagement(m["like_count"], m["retweet_count"], m["bookmark_count"])


def scored(following: DataFrame, bookmarks: DataFrame, day: str, date_column: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """The day's posts of both lists with source and score, and a row of how many were dropped as replies or by date."""
    both = following.unionByName(bookmarks, allowMissingColumns=True).dropDuplicates(["id"])
    tags = merge.tag_sources(following, bookmarks, "id", ("following", "bookmark"))
    rows = both.join(tags, "id").withColumn("date", times.gmt8_date(F.try_to_timestamp(date_column)))
    reply = F.coalesce(F.col("tweet_type") == P.REPLY, F.lit(False)) | F.col("in_reply_to_user_id").isNotNull()
    today = F.coalesce(F.col("date") == F.lit(day).cast("date"), F.lit(False))
    report = rows.agg(F.count_if(reply).alias("replies"), F.count_if(~reply & ~today).alias("other_days"), F.count_if(~reply & today).alias("kept"))
    return rows.where(~reply & today).withColumn("score", own_engagement()), report


def digest(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n posts with most engagement with rank and category."""
    return rank.top(rows, n, F.desc("score"), F.col("id")).withColumn("category", P.category(F.col("text")))


def rewrite_candidates(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n posts with most engagement with kind of content, angle and whether they are only a link."""
    text = P.full_text(F.col("full_text"), F.col("note_tweet.text"), F.col("text"))
    kind = P.content_type(text)
    return rank.top(rows, n, F.desc("score"), F.col("id")).select("rank", "id", text.alias("text"), "score", kind.alias("content_type"), P.rewrite_angle(kind).alias("angle"), P.is_link_only(text).alias("is_link_only"), F.try_element_at(F.col("entities.urls"), F.lit(1))["expanded_url"].alias("expanded_url"))


def style(posts: DataFrame, created: str = "created_at") -> dict[str, DataFrame]:
    """The style profile of an author's own posts: eight small tables."""
    own = flags(posts).where("NOT is_retweet").withColumn("__ts", F.try_to_timestamp(created))
    m = F.col("public_metrics")
    flat = own.withColumns({"likes": m["like_count"], "reposts": m["retweet_count"], "replies": m["reply_count"], "tags": F.transform("entities.hashtags", lambda h: h["tag"])})
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return {
        "language": profile.language_shares(flat, "text"),
        "length": profile.length_stats(flat, "text"),
        "hours": profile.hour_histogram(flat, "__ts"),
        "most_active": profile.most_active_hour(flat, "__ts"),
        "vocabulary": profile.top_words(flat, "text"),
        "hashtags": profile.tag_counts(flat, "tags"),
        "engagement": profile.engagement_averages(flat, "likes", "reposts", "replies", m.isNotNull()),
        "content": profile.content_kinds(flat, F.col("is_article"), some(F.col("attachments.media_keys")), some(F.col("entities.urls"))),
    }


def style_document(posts: DataFrame, created: str = "created_at") -> DataFrame:
    """style() as one JSON document: a row with the column json."""
    tables = style(posts, created)
    one = lambda df, name: df.agg(F.first(F.struct(*df.columns)).alias(name))
    listed = lambda df, name, *order: df.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("r")))), lambda x: x["r"]).alias(name))
    out = one(tables["language"], "language")
    for name in ("length", "most_active", "engagement", "content"):
        out = out.crossJoin(one(tables[name], name))  # one row each
    out = out.crossJoin(listed(tables["hours"], "hours", "hour")).crossJoin(listed(tables["vocabulary"], "vocabulary", (-F.col("n")).alias("o"), "word"))  # 24 and 50 entries
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def rewrite_document(rows: DataFrame, day: str, n: int = 10) -> DataFrame:
    """rewrite_candidates() as one JSON document of a day: a row with the column json."""
    found = rewrite_candidates(rows, n)
    return found.agg(F.sort_array(F.collect_list(F.struct(*found.columns))).alias("tweets")).select(F.to_json(F.struct(F.lit(day).alias("date"), F.size("tweets").alias("count"), "tweets")).alias("json"))


def related(posts: DataFrame, keywords: Sequence[str] = AI_KEYWORDS, text: str = "content", name: str = "displayName") -> DataFrame:
    """Posts whose text or author's name contains any keyword."""
    from ..functions.texts import contains_any

    return posts.where(contains_any(F.col(text), keywords) | contains_any(F.col(name), keywords))


def single(posts: DataFrame, id_: str) -> DataFrame:
    """The post of an id with its full text."""
    return posts.where(F.col("id") == id_).withColumn("full_text", P.full_text(F.col("full_text"), F.col("note_tweet.text"), F.col("text")))


def newest_ids(posts: DataFrame, user: str = "author_id") -> DataFrame:
    """The newest post of each user and the largest id, as numbers."""
    return posts.groupBy(user).agg(F.max_by("id", F.struct(F.coalesce("created_at", F.lit("")), P.numeric_id(F.col("id")))).alias("latest_id"), F.max(P.numeric_id(F.col("id"))).alias("largest_id"))


def views(spark, status: DataFrame, bookmarks: DataFrame) -> None:
    """Registers the saved views: active follows, recent unfollows, bookmarks by category and those on AI."""
    status.where("status = 'active'").orderBy(F.desc("first_seen"), "username").createOrReplaceTempView("active_follows")
    status.where("status = 'unfollowed'").orderBy(F.desc("last_seen"), "username").createOrReplaceTempView("recent_unfollows")
    bookmarks.groupBy("category").count().createOrReplaceTempView("bookmarks_by_category")
    bookmarks.where(F.contains("category", F.lit("AI/ML"))).createOrReplaceTempView("ai_bookmarks")
