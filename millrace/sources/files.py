"""Readers of files: trees of texts, JSON lines, nested JSON, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = ("sql", "md", "markdown", "txt")
MAX_BYTES = 2_000_000


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def text_tree(spark: SparkSession, root: str, suffixes: Sequence[str] = TEXT_SUFFIXES, most: int = MAX_BYTES) -> DataFrame:
    """path and text of all files below a folder with these suffixes; of a long file its first ``most`` bytes."""
    pattern = "{" + ",".join(f"*.{s},*.{s.upper()}" for s in suffixes) + "}"
    return texts_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root), suffixes, most)


@F.pandas_udf(T.StringType())
def _forgiving(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else c.decode("utf-8", "ignore"))


def texts_of(contents: DataFrame, suffixes: Sequence[str] = TEXT_SUFFIXES, most: int = MAX_BYTES) -> DataFrame:
    """path and text of files (path, content) with these suffixes; bytes that aren't UTF-8 are left out."""
    mine = contents.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes))
    cut = F.substring("content", 1, most)
    return mine.select("path", F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")).otherwise(_forgiving(cut)).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and lines that aren't objects are left out.  No file: no rows."""
    return json_objects(spark.read.text(path), schema) if exists(spark, path) else spark.createDataFrame([], schema)


def json_objects(lines: DataFrame, schema: str) -> DataFrame:
    """The objects that lines (value) hold; other lines give no row."""
    lines = lines.where(F.trim("value").rlike(r"^\{.*\}$"))
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL").select("r.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON documents of many lines.  No file: no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def flatten_posts(days: DataFrame) -> DataFrame:
    """A row per post of documents {date, results: [{user_id, username, name, tweets: [...]}]}, with the user's columns."""
    users = days.select("date", F.posexplode("results").alias("user_seq", "u"))
    return users.select("date", "user_seq", "u.user_id", "u.username", "u.name", F.posexplode("u.tweets").alias("post_seq", "t")).select("date", "user_seq", "post_seq", "user_id", "username", "name", "t.*")


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Pages of one listing as one table, missing columns null."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out


def sql_files(spark: SparkSession, path: str) -> DataFrame:
    """path and sql of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("sql"))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, url, title, headings and body text of raw pages; scripts and styles are no text."""
    from ..functions.texts import strip_html

    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    return pages.select(
        "page_id",
        "url",
        F.nullif(strip_html(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"),
        F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), strip_html).alias("headings"),
        strip_html(F.regexp_replace(bare, r"(?is)<title[^>]*>.*?</title>", " ")).alias("body"),
    )


def post_fields(articles: DataFrame) -> DataFrame:
    """Posts of scraped articles (html and whatever tells them apart): address, id, time, author, content and counts; what is missing is null."""
    from ..functions.texts import strip_html

    found = lambda pattern, group=1: F.nullif(F.regexp_extract("html", pattern, group), F.lit(""))
    user = F.regexp_extract("html", r'(?s)data-testid="User-Name"(.*?)(?:data-testid=|\z)', 1)
    spans = F.transform(F.regexp_extract_all(user, F.lit(r"(?s)<span[^>]*>(.*?)</span>"), F.lit(1)), strip_html)
    count = lambda name: F.coalesce(F.regexp_extract("html", rf'data-testid="{name}"[^>]*aria-label="([\d,]+)', 1).try_cast("long"), F.lit(0))
    link = found(r'href="((?:https://[^"/]+)?/[^"/]+/status/\d+)')
    return articles.select(
        *(c for c in articles.columns if c != "html"),
        F.when(link.startswith("/"), F.concat(F.lit("https://x.com"), link)).otherwise(link).alias("url"),
        found(r"/status/(\d+)").alias("id"),
        F.nullif(F.regexp_extract(user, r'href="/([^"/]+)"', 1), F.lit("")).alias("username"),
        F.try_element_at(F.filter(spans, lambda s: (s != "") & ~s.startswith("@") & ~F.contains(s, F.lit("·"))), F.lit(1)).alias("display_name"),
        found(r'<time[^>]*datetime="([^"]*)"').alias("datetime"),
        F.nullif(strip_html(F.regexp_extract("html", r'(?s)data-testid="tweetText"[^>]*>(.*?)</div>', 1)), F.lit("")).alias("content"),
        count("reply").alias("replies"),
        count("retweet").alias("reposts"),
        count("like").alias("likes"),
    )


def block_text(blocks: DataFrame, page: str = "page_id", seq: str = "seq") -> DataFrame:
    """page and text of its blocks (type, text, depth, checked) in order, each with the mark of its type."""
    mark = (
        F.when(F.col("type") == "heading_1", "# ").when(F.col("type") == "heading_2", "## ").when(F.col("type") == "heading_3", "### ").when(F.col("type") == "bulleted_list_item", "- ")
        .when(F.col("type") == "numbered_list_item", "1. ").when(F.col("type") == "quote", "> ").when(F.col("type") == "to_do", F.when(F.coalesce("checked", F.lit(False)), "[x] ").otherwise("[ ] ")).otherwise("")
    )
    line = F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0))), mark, F.coalesce("text", F.lit("")))
    return blocks.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
