"""Landed pages of a listing as a data source: a partition for each page or run of small pages, and page numbers as a stream's offsets."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page long, kind string, place long, value string"
_ARROW = pa.schema([("page", pa.int64()), ("kind", pa.string()), ("place", pa.int64()), ("value", pa.string())])


#: Pages up to which each is a task of its own; beyond, pages in a row share one, up to so many of them and so many bytes.
ALONE, RUN_PAGES, RUN_BYTES = 64, 256, 8 << 20


class _Run(InputPartition):
    """Pages in a row, from a number on."""

    def __init__(self, number: int, paths: list[str]) -> None:
        self.number, self.paths = number, paths


def _store(root: str):
    """The file system of a folder, whichever store it is in, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


def _pages(root: str) -> list[tuple[str, int]]:
    """The files of a folder, with their bytes, by name, which is the order of pages; hidden ones and those that writers leave beside them are none."""
    from pyarrow import fs

    store, path = _store(root)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(part.startswith((".", "_")) for part in f.path[len(path) :].split("/")))


def _runs(pages: list[tuple[str, int]], number: int = 0) -> list[_Run]:
    """Pages, of which the first has a number, in runs, so that a listing of very many small pages isn't as many tasks."""
    most = min(RUN_PAGES, -(-len(pages) // ALONE))
    out, held = [], 0
    for k, (path, size) in enumerate(pages, number):
        if not out or len(out[-1].paths) >= most or held + size > RUN_BYTES:
            out.append(_Run(k, []))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def _read(root: str, run: _Run) -> Iterator[pa.RecordBatch]:
    """The rows of a run's pages, a batch for each page."""
    store, _ = _store(root)
    for number, path in enumerate(run.paths, run.number):
        with store.open_input_stream(path) as file:
            yield from _rows(number, file.read().decode("utf-8", "replace"))


def _rows(number: int, body: str) -> Iterator[pa.RecordBatch]:
    """The rows of a page: those of its data, then those of each of its includes by name.  A page that is no JSON object is one row of kind error."""
    try:
        told = json.loads(body)
        if not isinstance(told, dict):
            raise ValueError("no object")
        includes = told.get("includes") or {}
        lists = [("data", told.get("data") or []), *((k, includes[k] or []) for k in sorted(includes))]
        rows = [(number, kind, place, json.dumps(x, ensure_ascii=False)) for kind, values in lists for place, x in enumerate(values)]
    except (ValueError, AttributeError, TypeError):
        rows = [(number, "error", 0, body[:200])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Batch(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> Sequence[InputPartition]:
        return _runs(_pages(self.root))

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        yield from _read(self.root, partition)


class _Stream(DataSourceStreamReader):
    """Offsets count pages, so that a restart goes on with the first page that it hasn't read; pages land under ascending names."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(_pages(self.root))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _runs(_pages(self.root)[start["pages"] : end["pages"]], start["pages"])

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        yield from _read(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    """Option ``path``: a folder of JSON documents {data: [...], includes: {name: [...]}, ...}, one a page."""

    @classmethod
    def name(cls) -> str:
        return "millrace_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def pages(spark: SparkSession, root: str) -> DataFrame:
    """page, kind (data, the name of an include, or error), place and value (JSON) of all rows of landed pages; up to ALONE pages each is read by a task of its own."""
    spark.dataSource.register(PagedListing)
    return spark.read.format(PagedListing.name()).option("path", root).load()


def page_stream(spark: SparkSession, root: str) -> DataFrame:
    """pages() as a stream: each page once, new ones as they land."""
    spark.dataSource.register(PagedListing)
    return spark.readStream.format(PagedListing.name()).option("path", root).load()


def listing(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The data rows of a listing with seq (from 0), their place over all pages, up to ``most`` rows.

    Pages tell how many rows they have, and a page's first seq is the sum of
    those before it, so rows needn't be sorted in one task.
    """
    from pyspark.sql.window import Window

    data = rows.where("kind = 'data'")
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # a row for each page
    first = data.groupBy("page").agg(F.count("*").alias("n")).select("page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    found = data.join(first, "page").withColumn("seq", F.col("first") + F.col("place"))
    return (found if most is None else found.where(F.col("seq") < most)).select("seq", "value")
