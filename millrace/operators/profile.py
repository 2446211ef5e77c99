"""Style profile of posts: languages, lengths, hours, words, tags, engagement and kinds of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.texts import STOP_WORDS, language_mix, vocabulary


def _percent(part: Column, whole: Column) -> Column:
    return F.floor(part / whole * 100 + 0.5).cast("long")


def language_shares(df: DataFrame, text: str) -> DataFrame:
    """chinese, english and mixed: whole percents of the rows; null without rows."""
    kind = language_mix(F.coalesce(F.col(text), F.lit("")))
    return df.select(kind.alias("k")).agg(*(_percent(F.count_if(F.col("k") == k), F.nullif(F.count("*"), F.lit(0))).alias(k) for k in ("chinese", "english", "mixed")))


def length_stats(df: DataFrame, text: str) -> DataFrame:
    """avg_chars (rounded), median_chars (the upper one), min_chars and max_chars.

    The median comes from counts by length, so no task gathers all lengths.
    """
    lengths = df.select(F.length(F.coalesce(F.col(text), F.lit(""))).alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    facts = lengths.agg(F.sum("c").alias("rows"), F.sum(F.col("n") * F.col("c")).alias("total"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.sort_array(F.collect_list(F.struct("n", "c"))).alias("all"))  # a row for each length
    upto = F.aggregate("all", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")), lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["c"] > F.floor(F.col("rows") / 2), x["n"])).alias("at")))
    return facts.select(F.floor(F.col("total") / F.col("rows") + 0.5).cast("long").alias("avg_chars"), upto["at"].cast("long").alias("median_chars"), F.col("min_chars").cast("long").alias("min_chars"), F.col("max_chars").cast("long").alias("max_chars"))


def hour_histogram(df: DataFrame, ts: str) -> DataFrame:
    """hour and posts for each of 24 hours of UTC, also for hours without posts."""
    found = df.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("posts"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(found, "hour", "left").select("hour", F.coalesce("posts", F.lit(0)).cast("long").alias("posts"))


def most_active_hour(df: DataFrame, ts: str) -> DataFrame:
    """The hour with most posts, the smallest of equals."""
    return hour_histogram(df, ts).agg(F.max_by("hour", F.struct("posts", -F.col("hour"))).alias("hour"))


def top_words(df: DataFrame, text: str, n: int = 50) -> DataFrame:
    """The n most frequent words; equals in order of the word."""
    words = df.select(F.explode(vocabulary(F.coalesce(F.col(text), F.lit("")), stop=False)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(~F.col("word").isin(*STOP_WORDS)).orderBy(F.desc("n"), "word").limit(n)


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """Tags without case, and how often each occurs."""
    return df.select(F.explode(tags).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != "")).groupBy(F.lower("t").alias("tag")).agg(F.count("*").alias("n"))


def engagement_averages(df: DataFrame, likes: str, reposts: str, replies: str, has_metrics: Column) -> DataFrame:
    """Averages over rows with metrics, zeros without any."""
    known = df.where(has_metrics)
    mean = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0))), F.lit(0.0))
    return known.agg(mean(likes).alias("avg_likes"), mean(reposts).alias("avg_retweets"), mean(replies).alias("avg_replies"), F.coalesce(F.sum(likes), F.lit(0)).alias("total_likes"))


def content_kinds(df: DataFrame, is_article: Column, has_media: Column, has_links: Column) -> DataFrame:
    """Counts of articles, then of posts with media, with links and with text alone; each post counts once."""
    kind = F.when(is_article, "articles").when(has_media, "with_media").when(has_links, "with_links").otherwise("text_only")
    return df.select(kind.alias("k")).agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("text_only", "with_media", "with_links", "articles")))


def by_category(df: DataFrame, category: str, seq: str) -> DataFrame:
    """category, items and first_seq, in order of first appearance with Other last."""
    return df.groupBy(category).agg(F.count("*").alias("items"), F.min(seq).alias("first_seq")).orderBy(F.col(category) == "Other", "first_seq")


def count_by(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("items"))


def type_counts(df: DataFrame, user: str, kind: str) -> DataFrame:
    """user, kind, items and the user's total, which adds up the counts and not the rows once more."""
    counts = df.groupBy(user, kind).agg(F.count("*").alias("items"))
    return counts.withColumn("total", F.sum("items").over(Window.partitionBy(user)))
