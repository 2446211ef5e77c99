"""Static checks of SQL texts against a dialect and a catalog."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from ..session import stored

DIALECTS = ("hive", "hive-legacy", "sparksql", "gaussdb")
#: Words of Hive and Spark that the gaussdb dialect lacks, and words that change data or tables.
HIVE_ONLY = ("lateral view", "explode(", "collect_set(", "from_unixtime(", "unix_timestamp(")
DESTRUCTIVE = re.compile(r"(?i)(?<!\w)(?:drop|truncate|delete|update|insert\s+(?:overwrite|into)|create\s+table|alter\s+table)(?!\w)")
MESSAGES = {
    "destructive": "the text changes data or tables",
    "select-star": "SELECT * returns columns nobody asked for",
    "missing-where": "a partitioned table is read without WHERE",
    "missing-partition-filter": "WHERE doesn't name a partition column",
    "gaussdb-backticks": "this dialect has no names in backticks",
    "gaussdb-hive-only": "a function or clause that only Hive and Spark have",
    "hive-postgres-cast": "casts are written cast(x AS type) here",
    "hive-legacy-postgres-cast": "casts are written cast(x AS type) here",
    "many-joins": "three joins or more without removing duplicates first",
    "hive-orderby-positional": "ORDER BY names columns by number",
    "hive-orderby-not-selected": "ORDER BY names what the SELECT list doesn't give",
    "hive-legacy-scalar-subquery-select": "a subquery in the SELECT list",
    "hive-legacy-scalar-subquery-on": "a subquery in an ON condition",
}


def _dialect_codes(plain: str, found: sqltext.Tokens, dialect: str) -> list[str]:
    low, codes = plain.lower(), []
    if DESTRUCTIVE.search(plain):
        codes.append("destructive")
    if re.search(r"(?i)\bselect\s+(?:distinct\s+)?\*", plain):
        codes.append("select-star")
    if dialect == "gaussdb":
        codes += ["gaussdb-backticks"] * ("`" in plain) + ["gaussdb-hive-only"] * any(w in low for w in HIVE_ONLY)
    elif "::" in plain:
        codes.append("hive-legacy-postgres-cast" if dialect == "hive-legacy" else "hive-postgres-cast")
    if len(found.places["join"]) >= 3 and "row_number" not in low:
        codes.append("many-joins")
    if dialect not in ("hive", "hive-legacy"):
        return codes
    listed, sorts = sqltext.select_list(found, plain), sqltext.order_names(found, plain)
    if any(s.isdigit() for s in sorts):
        codes.append("hive-orderby-positional")
    named = [s for s in sorts if not s.isdigit()]
    if named and not set(named) <= set(sqltext.output_names(listed)):
        codes.append("hive-orderby-not-selected")
    if dialect == "hive-legacy":
        inner = re.compile(r"(?i)\(\s*select\b")
        if inner.search(listed):
            codes.append("hive-legacy-scalar-subquery-select")
        codes += ["hive-legacy-scalar-subquery-on" for c in sqltext.on_clauses(found, plain) if inner.search(c)]
    return codes


def _known(dialects: Sequence[str]) -> None:
    for dialect in dialects:
        if dialect not in DIALECTS:
            raise ValueError(f"no such dialect: {dialect}")


def text_codes(sql: str, dialect: str) -> tuple[list[str], list[str], str]:
    """Codes that the text alone gives, the tables that it reads, and its WHERE."""
    _known([dialect])
    plain = sqltext.without_comments(sql)
    found = sqltext.tokens(plain)
    return _dialect_codes(plain, found, dialect), sqltext.source_tables(found), sqltext.where_text(found, plain).lower()


def check_dialects(texts: DataFrame, dialects: Sequence[str]) -> DataFrame:
    """dialect, path and code of every warning that texts (path, sql) give by themselves; each text is scanned once for all dialects."""
    _known(dialects)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, sql in zip(frame["path"], frame["sql"], strict=True):
                plain = sqltext.without_comments(sql or "")
                found = sqltext.tokens(plain)
                rows += [(dialect, path, code) for dialect in dialects for code in _dialect_codes(plain, found, dialect)]
            yield pd.DataFrame(rows, columns=["dialect", "path", "code"])

    return texts.select("path", "sql").mapInPandas(run, "dialect string, path string, code string")


def check(texts: DataFrame, dialect: str = "hive", catalog: DataFrame | None = None) -> DataFrame:
    """path, code and message of every warning on texts (path, sql).

    With a catalog (name, partition_columns), tables are found by full name,
    else by their last part, where the first name in order counts.
    """
    said = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    if catalog is None:
        return check_dialects(texts, [dialect]).select("path", "code", said[F.col("code")].alias("message"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *text_codes(s or "", dialect)) for p, s in zip(frame["path"], frame["sql"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "codes", "tables", "filter"])

    read = texts.select("path", "sql").mapInPandas(run, "path string, codes array<string>, tables array<string>, filter string")
    read = stored(read, "texts")  # scanned once, though codes and tables both come from it
    out = read.select("path", F.explode("codes").alias("code"))
    known = catalog.where(F.size("partition_columns") > 0).groupBy("name").agg(F.min_by(F.transform("partition_columns", lambda c: F.lower(c["name"])), F.col("layer") if "layer" in catalog.columns else F.lit(0)).alias("parts"))
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    short = known.groupBy(last("name").alias("short")).agg(F.min_by("parts", "name").alias("short_parts"))
    used = read.select("path", "filter", F.explode("tables").alias("name")).withColumn("short", last("name")).join(known, "name", "left").join(short, "short", "left")
    used = used.withColumn("parts", F.coalesce("parts", "short_parts")).where("parts IS NOT NULL")
    hit = F.exists("parts", lambda p: F.regexp_like(F.col("filter"), F.concat(F.lit(r"(?<![A-Za-z0-9_])"), p, F.lit(r"(?![A-Za-z0-9_])"))))
    out = out.unionByName(used.where((F.col("filter") == "") | ~hit).select("path", F.when(F.col("filter") == "", "missing-where").otherwise("missing-partition-filter").alias("code")))
    return out.withColumn("message", said[F.col("code")])
