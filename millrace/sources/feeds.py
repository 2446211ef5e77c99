"""Feeds: RSS, RDF and Atom documents to rows."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts, times, urls

_RAW = "source_id string, feed_url string, item int, title_raw string, link string, published_raw string, summary_raw string, tags array<string>, error string"
CAP = 500
#: Bits of seq that tell a feed's items apart.
ITEM_BITS = 24


def _local(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _text(node) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


def _longest(*candidates: str) -> str:
    return max(candidates, key=len)


def _children(node, *names: str) -> dict[str, list]:
    found: dict[str, list] = {n: [] for n in names}
    for child in node:
        if _local(child.tag) in found:
            found[_local(child.tag)].append(child)
    return found


def _rss(item) -> tuple:
    c = _children(item, "title", "link", "guid", "pubdate", "date", "description", "encoded", "category")
    one = lambda name: _text(c[name][0]) if c[name] else ""
    link = one("link")
    if not link and c["guid"] and c["guid"][0].get("isPermaLink", "true").lower() != "false":
        link = one("guid")
    return one("title"), link, one("pubdate") or one("date"), _longest(one("description"), one("encoded")), [t for t in map(_text, c["category"]) if t][:5]


def _atom(entry) -> tuple:
    c = _children(entry, "title", "link", "published", "updated", "summary", "content", "category")
    one = lambda name: _text(c[name][0]) if c[name] else ""
    links = [x.get("href", "") for x in c["link"] if x.get("rel", "alternate") == "alternate"] or [x.get("href", "") for x in c["link"]]
    tags = [x.get("term", "").strip() for x in c["category"]]
    return one("title"), links[0] if links else "", one("published") or one("updated"), _longest(one("summary"), one("content")), [t for t in tags if t][:5]


def parse_document(content: str | None) -> tuple[list[tuple], str | None]:
    """Items of a feed in order and the error that kept it from being read; items without title or link are left out."""
    try:
        root = ET.fromstring((content or "").lstrip("﻿").strip())
    except ET.ParseError as e:
        return [], f"malformed: {e}"
    kind = _local(root.tag)
    if kind == "feed":
        found = [_atom(e) for e in root if _local(e.tag) == "entry"]
    elif kind in ("rss", "rdf", "channel"):
        found = [_rss(e) for e in root.iter() if _local(e.tag) == "item"]
    else:
        return [], f"not a feed: {kind}"
    return [f for f in found if f[0] and f[1]], None


def parse(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of landed feeds (seq, source_id, url, content), and source_id, url and error of those that aren't feeds.

    An article whose date can't be read has the flag date_unknown.  seq
    orders articles as their feeds and the feeds' items come.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for seq, source, url, content in zip(frame["seq"], frame["source_id"], frame["url"], frame["content"], strict=True):
                items, error = parse_document(content)
                if len(items) >> ITEM_BITS:
                    items, error = [], f"too many items: {len(items)}"
                rows += [(seq, source, url, k, t, link, p, s, tags, None) for k, (t, link, p, s, tags) in enumerate(items)]
                if error:
                    rows.append((seq, source, url, -1, None, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=["feed_seq", *(f.split(" ")[0] for f in _RAW.split(", "))])

    raw = landed.select("seq", "source_id", "url", "content").mapInPandas(run, f"feed_seq long, {_RAW}")
    ts = times.parse(F.col("published_raw"))
    empty = F.array().cast("array<string>")
    title, summary = decoded(F.col("title_raw")), decoded(F.col("summary_raw"))
    items = raw.where("error IS NULL").select(
        (F.shiftleft("feed_seq", ITEM_BITS) + F.col("item")).alias("seq"),
        title.alias("title"),
        urls.normalize(F.col("link"), F.col("feed_url")).alias("url"),
        "source_id",
        F.col("source_id").alias("source_name"),
        title.alias("title_raw"),
        ts.alias("published_at"),
        "published_raw",
        texts.shorten(summary, CAP).alias("summary"),
        texts.shorten(summary, CAP).alias("summary_raw"),
        F.lit(None).cast("string").alias("topic"),
        "tags",
        F.expr("CAST(array() AS array<struct<source_id:string,source_name:string,url:string>>)").alias("mentions"),
        F.lit(0.0).alias("score"),
        F.when(ts.isNull(), F.array(F.lit("date_unknown"))).otherwise(empty).alias("flags"),
    )
    return items, raw.where("error IS NOT NULL").select("source_id", F.col("feed_url").alias("url"), "error")


@F.pandas_udf(T.StringType())
def _decode(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else re.sub(r"\s+", " ", html.unescape(v)).strip())


def decoded(x):
    """Markup stripped with all named and numbered entities decoded; rows without an ampersand stay on the JVM."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))
    return F.when(F.contains(plain, F.lit("&")), _decode(plain)).otherwise(plain)
