"""The news digest: landed feeds to ranked, capped sections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import posts, texts, times
from ..operators import classify, dedupe, rank
from ..sources import feeds, registry, sinks


@dataclass
class Digest:
    """What a digest asks for.  reference is the time that ages are taken from; keywords the topics' weighted words."""

    reference: datetime
    keywords: classify.Keywords
    window: str | None = None
    zone: str | None = None
    per_topic: int = 5
    total: int = 20
    topics: Sequence[str] | None = None
    include: dict = field(default_factory=dict)
    exclude: dict = field(default_factory=dict)


def select(items: DataFrame, ask: Digest, similar: float | None = None) -> DataFrame:
    """Articles (with weight) inside the window, one per address, classified, scored and capped: the rows of the digest.

    With ``similar``, articles with titles that alike are merged as well;
    the leader then takes over the mentions of its members.
    """
    since, until = times.day_window(ask.window, ask.zone, ask.reference) if ask.window else (None, None)
    kept = items.where(times.inside(F.col("published_at"), since, until))
    merged = dedupe.leaders(kept)
    members = None
    if similar is not None:
        members = dedupe.greedy_title_groups(merged, threshold=similar).checkpoint()
        merged = _led(merged, members)
    sorted_ = classify.classify(merged, ["title", "summary"], ask.keywords, ask.include, ask.exclude)
    scored = sorted_.withColumn("score", posts.article_score(F.col("published_at"), F.col("weight"), F.col("topic_score"), F.lit(ask.reference)))
    if ask.topics:
        scored = scored.where(F.col("topic").isin(list(ask.topics)))
    names = [*ask.keywords, "other"]
    order = F.create_map(*(x for k, t in enumerate(names) for x in (F.lit(t), F.lit(k))))
    chosen = rank.capped(scored.withColumn("topic_order", order[F.col("topic")]), "topic", "topic_order", ask.per_topic, ask.total, F.desc("score"), F.col("seq"))
    return dedupe.with_mentions(chosen, kept, members)  # of the chosen rows alone


def _led(items: DataFrame, members: DataFrame) -> DataFrame:
    """The leaders of members (seq, leader), each with the first known time among its members."""
    names = [c for c in items.columns if c != "mentions"]
    found = items.select(names).join(members, "seq").groupBy("leader").agg(F.min_by(F.struct(*names), "seq").alias("r"), F.min_by("published_at", F.when(F.col("published_at").isNotNull(), F.col("seq"))).alias("published_at"))
    return found.select(*(F.col("published_at") if c == "published_at" else F.col(f"r.`{c}`") for c in names))


def merge_similar(items: DataFrame, threshold: float, hours: float = 24) -> DataFrame:
    """Items, each of its own address, with like titles as one: the leader, which mentions its members and whom their addresses mention."""
    groups = dedupe.greedy_title_groups(dedupe.leaders(items), threshold=threshold, hours=hours).checkpoint()
    return dedupe.with_mentions(_led(dedupe.leaders(items), groups), items, groups)


def run(landed: DataFrame, sources: DataFrame, ask: Digest, date: str, language: str = "zh", similar: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digest's rows, its Markdown (one row) and a row of counts, from landed feeds (seq, source_id, url, content, success, error)."""
    used = registry.usable(sources)
    mine = landed.join(used.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    items, broken = feeds.parse(mine.where("success"))
    rows = select(registry.with_source(items, used), ask, similar)
    failed = mine.where("NOT success").select("source_id", "url", "error").unionByName(broken)
    counts = mine.agg(F.count_distinct("source_id").alias("sources_queried"), F.count_distinct(F.when(F.col("success"), F.col("source_id"))).alias("sources_succeeded"))
    return rows, sinks.markdown(rows, failed, date, language), counts


def enrich(items: DataFrame, provider: Callable[[list[str], list[str]], list[tuple[str, str] | None]] | None) -> DataFrame:
    """Titles and summaries translated by a provider, called with the titles and summaries of a batch.

    Rows with Chinese text stay.  Without a provider, or where it gives None,
    a row keeps its text and has the flag untranslated once.  provider_error
    holds what a provider raised for the row's batch.
    """
    foreign = ~texts.has_cjk(F.concat_ws(" ", "title", "summary"))
    if provider is None:
        return items.withColumns({"flags": F.when(foreign, texts.add_flag(F.col("flags"), "untranslated")).otherwise(F.col("flags")), "provider_error": F.lit(None).cast("string")})
    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "summary", "error")])

    @F.pandas_udf(kind)
    def translated(titles: pd.Series, summaries: pd.Series) -> pd.DataFrame:
        try:
            found = [(*f, None) if f else (None, None, None) for f in provider(titles.fillna("").tolist(), summaries.fillna("").tolist())]
        except Exception as e:  # whatever it is, it costs the translation and not the row, and is told there
            found = [(None, None, f"{type(e).__name__}: {e}")] * len(titles)
        return pd.DataFrame(found, columns=["title", "summary", "error"])

    out = items.withColumn("__t", F.when(foreign, translated("title", "summary")))
    done = F.col("__t.title").isNotNull()
    return out.withColumns({
        "title": F.coalesce("__t.title", "title"),
        "summary": F.coalesce("__t.summary", "summary"),
        "provider_error": F.col("__t.error"),
        "flags": F.when(foreign & ~done, texts.add_flag(F.col("flags"), "untranslated")).otherwise(F.col("flags")),
    }).drop("__t")
