"""Topic classification by weighted keywords."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import bounded

Keywords = Mapping[str, Sequence[tuple[str, int]]]


def topic_scores(text: Column, keywords: Keywords, include: Mapping[str, Sequence[str]] | None = None, exclude: Mapping[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """A column per topic: the weights of its keywords that the text holds, each counted once.

    Keywords are a parameter.  Words to include weigh 3; a topic with a word
    to exclude anywhere in the text scores 0.
    """
    out = {}
    for topic, words in keywords.items():
        weighted = [*words, *((w, 3) for w in (include or {}).get(topic, ()))]
        score = reduce(lambda a, b: a + b, (F.when(text.rlike(bounded(w)), weight).otherwise(0) for w, weight in weighted), F.lit(0))
        for w in (exclude or {}).get(topic, ()):
            score = F.when(F.contains(F.lower(text), F.lit(w.lower())), 0).otherwise(score)
        out[topic] = score
    return out


def classify(df: DataFrame, parts: Sequence[str], keywords: Keywords, include=None, exclude=None, least: int = 2, other: str = "other") -> DataFrame:
    """Adds topic and topic_score by the text of ``parts``: the best topic, the first of equals; below ``least`` it is ``other``."""
    text = F.concat_ws(" ", *(F.col(p) for p in parts))
    scores = topic_scores(F.col("__text"), keywords, include, exclude)
    names = {t: f"__score_{k}" for k, t in enumerate(scores)}
    df = df.withColumn("__text", text).withColumns({names[t]: s for t, s in scores.items()})
    best = F.greatest(*(F.col(n) for n in names.values()), F.lit(0))
    topic = F.when(F.col("topic_score") < least, other)
    for t, n in names.items():
        topic = topic.when(F.col(n) == F.col("topic_score"), t)
    return df.withColumn("topic_score", best).withColumn("topic", topic.otherwise(other)).drop("__text", *names.values())


def counts_by_topic(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    """topic, topic_order and items of every topic, also of those without items."""
    spark = df.sparkSession
    known = spark.createDataFrame(list(zip(topics, range(len(topics)), strict=True)), "topic string, topic_order int")
    found = df.groupBy("topic").agg(F.count("*").alias("items"))
    return known.join(found, "topic", "left").select("topic", "topic_order", F.coalesce("items", F.lit(0)).cast("long").alias("items"))
