"""The catalog of a warehouse: definitions and ETL texts to entries, and weighted search over them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sqltext
from ..operators.asof import last_before
from ..schemas import COLUMN, SIGNALS
from ..session import shared_folder, stored

LAYERS = ("ADS", "DWS", "DWT", "DWD", "ODS")
#: Words that a search leaves out, and names that tell little and weigh half.
STOP_WORDS = (
    "select", "from", "where", "join", "left", "right", "inner", "outer", "group", "by", "order", "limit", "and", "or", "as", "on", "in", "is",
    "not", "null", "like", "between", "case", "when", "then", "else", "end", "having", "insert", "into", "table", "create", "drop", "alter", "set",
    "with", "union", "all", "distinct", "true", "false", "the", "of", "for", "查询", "统计", "导出", "获取", "数据", "信息", "明细", "汇总", "报表", "字段", "表", "结果",
    "最近", "按", "各", "所有", "需要", "希望", "帮忙", "帮我", "请", "一下",
)
LOW_INFORMATION = frozenset(("id", "name", "code", "dt", "ds", "type", "status", "flag"))
WEIGHTS = {"name": 5.0, "description": 4.0, "table_comment": 4.0, "column_comments": 4.0, "column_names": 3.0, "partition_names": 3.0, "path": 1.0}


def layer_of(path: Column) -> Column:
    """The first name of a layer in a path that stands between signs that aren't letters, else UNKNOWN."""
    found = F.upper(F.regexp_extract(path, rf"(?i)(?:^|[^a-zA-Z])({'|'.join(LAYERS)})(?:$|[^a-zA-Z])", 1))
    return F.when(found != "", found).otherwise("UNKNOWN")


_LIST = pa.list_(pa.string())
_COLUMNS = pa.list_(pa.struct([(f, pa.string()) for f in ("name", "type", "comment")]))
_SIGNALS = pa.struct([*((f, _LIST) for f in ("source_tables", "group_by", "row_number_keys")), ("has_distinct", pa.bool_()), ("has_row_number", pa.bool_())])
#: What is found in files, and how many of them are held at a time.
_FOUND = pa.schema([("path", pa.string()), ("layer", pa.string()), ("name", pa.string()), ("table_comment", pa.string()), ("columns", _COLUMNS), ("partition_columns", _COLUMNS), ("signals", _SIGNALS), ("is_sql", pa.bool_())])
_HELD = 500


def _found_in(path: str, layer: str, text: str, signals: bool = True) -> list[tuple]:
    """The rows of a file, as _FOUND lists them."""
    sql = path.lower().endswith(".sql")
    found = sqltext.tokens(text) if signals and sql else sqltext.naming_tokens(text)
    created = sqltext.created_tables(found)
    names = created or sqltext.inserted_tables(found) or [path.rpartition("/")[2].rpartition(".")[0]]
    own = sqltext.table_definition(found) if created else {"columns": [], "partition_columns": [], "table_comment": ""}
    seen = sqltext.signals(found, text) if signals and sql and not created else None
    first = (path, layer, names[0], own["table_comment"], own["columns"], own["partition_columns"], seen, sql)
    return [first, *((path, layer, name, "", [], [], seen, sql) for name in names[1:])]


def extract(files: DataFrame, keep_unknown: bool = True, layers: Sequence[str] | None = None, signals: bool = True) -> DataFrame:
    """Entries of files (path, text): a row per table that a file defines or fills, or else is named after.

    Only the first definition of a file has its columns read; they belong to
    that table.  ETL texts give signals, documents only their path.  Which
    layer a file lies in shows in its path, so that those of none, or of other
    layers than are asked for, needn't be scanned where they aren't kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _HELD):
                rows = [row for path, layer, text in zip(*(c.to_pylist() for c in batch.slice(at, _HELD).columns), strict=True) for row in _found_in(path, layer, text or "", signals)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    layered = files.select("path", layer_of(F.col("path")).alias("layer"), "text")
    if not keep_unknown:
        layered = layered.where("layer <> 'UNKNOWN'")
    if layers is not None:
        layered = layered.where(F.col("layer").isin(list(layers)))
    schema = f"path string, layer string, name string, table_comment string, columns array<{COLUMN}>, partition_columns array<{COLUMN}>, signals {SIGNALS}, is_sql boolean"
    title = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^([\x{4e00}-\x{9fff}][\x{4e00}-\x{9fff}\w]*)", 1)
    return layered.mapInArrow(run, schema).withColumn("description", title)


def qualify(entries: DataFrame, most: int = 100_000) -> DataFrame:
    """Short names of filled tables take the full name of the last such table of the layer that an earlier path, or their own, defines.

    Adds the name's last part, ``short``, which names of one table share.
    Entries with up to ``most`` of one are sorted in a window.  Of those with
    more, of which there are at most entries / most, definitions and uses are
    sorted in ranges, see last_before(), so that no task sorts more than
    ``most`` entries of a name.  Both give the same.
    """
    shared_folder(entries.sparkSession)
    keys, dotted = ["layer", "short"], F.contains("name", F.lit("."))
    named = entries.withColumn("short", F.lower(F.element_at(F.split("name", r"\."), -1)))
    full = F.when(dotted & (F.size("columns") > 0), F.col("name"))
    # a path's own definitions come before its uses, the largest name last
    here = Window.partitionBy(*keys).orderBy("path", full.isNull(), full).rowsBetween(Window.unboundedPreceding, 0)
    window = lambda x: x.withColumn("name", F.when(dotted, F.col("name")).otherwise(F.coalesce(F.last(full, ignorenulls=True).over(here), "name")))
    large = named.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys).checkpoint()
    if large.isEmpty():
        return window(named)
    held = named.join(F.broadcast(large), keys, "left_semi")
    facts = held.where(full.isNotNull()).select(*keys, "path", full.alias("full_name"))
    asked = last_before(held.where(~dotted), facts, keys, "path", "full_name").withColumn("name", F.coalesce("full_name", "name")).drop("full_name")
    return window(named.join(F.broadcast(large), keys, "left_anti")).unionByName(held.where(dotted)).unionByName(asked)


def build(files: DataFrame, keep_unknown: bool = False, layers: Sequence[str] | None = None, signals: bool = True) -> DataFrame:
    """One entry per layer and name: the first that isn't empty of each description, all paths, all signals.

    Texts are scanned once, though several steps look at what is found.  Who
    needs some layers only, or no signals, says so here, since what isn't read
    afterwards is scanned for all the same: layers have nothing to do with
    each other, and without signals their column is left out.
    """
    entries = qualify(stored(extract(files, keep_unknown, layers, signals), "catalog"))
    first = lambda c, full: F.min_by(c, F.when(full, F.struct("path", "name")))
    texts = lambda c: F.coalesce(first(c, F.coalesce(F.col(c), F.lit("")) != ""), F.lit(""))
    lists = lambda c: F.coalesce(first(c, F.size(c) > 0), F.expr(f"CAST(array() AS array<{COLUMN}>)"))
    # one list for each kind of what is gathered, from which fields are taken
    files_ = F.collect_list(F.struct("path", "is_sql"))
    paths = lambda which: F.array_distinct(F.array_sort(F.transform(F.filter(files_, which), lambda x: x["path"])))
    signs = F.collect_list(F.when(F.col("signals").isNotNull(), F.struct("path", "signals")))
    union = lambda f: F.array_distinct(F.flatten(F.transform(F.array_sort(F.transform(signs, lambda x: F.struct(x["path"], x["signals"][f].alias("v")))), lambda x: x["v"])))
    told = F.struct(
        *(union(f).alias(f) for f in ("source_tables", "group_by", "row_number_keys")),
        *(F.coalesce(F.bool_or(f"signals.{f}"), F.lit(False)).alias(f) for f in ("has_distinct", "has_row_number")),
    ).alias("signals")
    # the last part is told by the name; with it, entries that were brought together to be qualified needn't move again
    found = entries.groupBy("layer", "short", "name").agg(
        texts("description").alias("description"),
        texts("table_comment").alias("table_comment"),
        paths(lambda x: x["is_sql"]).alias("sql_files"),
        paths(lambda x: ~x["is_sql"]).alias("doc_files"),
        lists("columns").alias("columns"),
        lists("partition_columns").alias("partition_columns"),
        *([told] if signals else []),
    )
    return found.drop("short")


def counts(catalog: DataFrame) -> DataFrame:
    """Tables of each layer, and those with a commented column."""
    return catalog.groupBy("layer").agg(F.count("*").alias("tables"), F.count_if(F.exists("columns", lambda c: F.coalesce(c["comment"], F.lit("")) != "")).alias("commented"))


def query_tokens(query: str) -> list[str]:
    """Words of a question: names whole and in their parts, two signs or more, numbers three; no stop words."""
    plain = re.sub(r"[^0-9a-z_.一-鿿]+", " ", unicodedata.normalize("NFKC", query).lower())
    out = []
    for raw in re.findall(r"[a-z0-9_.]+|[一-鿿]+", plain):
        for word in (raw, *re.split(r"[_.]", raw)):
            if len(word) >= (3 if word.isdigit() else 2) and word not in STOP_WORDS:
                out.append(word)
    return list(dict.fromkeys(out))


def search_fields() -> dict[str, Column]:
    """What a search looks at in an entry, in lower case."""
    empty = F.lit("")
    return {
        "name": F.lower("name"), "description": F.lower(F.coalesce("description", empty)), "table_comment": F.lower(F.coalesce("table_comment", empty)),
        "column_comments": F.lower(F.array_join(F.transform("columns", lambda c: F.coalesce(c["comment"], empty)), "\n")),
        "column_names": F.lower(F.array_join(F.transform("columns", lambda c: c["name"]), "\n")),
        "partition_names": F.lower(F.array_join(F.transform("partition_columns", lambda c: c["name"]), "\n")),
        "path": F.lower(F.array_join(F.concat("sql_files", "doc_files"), "\n")),
    }


def search(catalog: DataFrame, query: str, n: int = 20, prefer: Sequence[str] = ("ADS", "DWS", "DWT"), layers: Sequence[str] | None = None, require_hit: bool = False) -> DataFrame:
    """layer, name and score of the n best entries.

    Each word adds the weights of the fields that contain it, half if it tells
    little; a preferred layer adds 3, 2 or 1, by default also without any
    hit.  The words are literals, so scoring is one pass without a join.
    """
    fields = search_fields()
    score = F.lit(0.0)
    for word in query_tokens(query):
        for field, weight in WEIGHTS.items():
            score = score + F.when(F.contains(fields[field], F.lit(word)), weight * (0.5 if word in LOW_INFORMATION else 1.0)).otherwise(0.0)
    bonus = F.lit(0.0)
    for k, layer in enumerate(prefer):
        bonus = F.when(F.col("layer") == layer, float(max(0, 3 - k))).otherwise(bonus)
    rows = catalog.where(F.col("layer").isin(list(layers))) if layers else catalog
    rows = rows.select("layer", "name", score.alias("hits"), bonus.alias("bonus")).select("layer", "name", (F.col("hits") + F.col("bonus")).alias("score"), "hits")
    return rows.where((F.col("hits") > 0) if require_hit else (F.col("score") > 0)).orderBy(F.desc("score"), "layer", "name").limit(n).drop("hits")
