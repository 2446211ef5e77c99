"""Streams with state for each key: cursors, listings that end at a known id, thresholds.

The state lives in the query's checkpoint, a value of a few bytes for each
key, so that a restart goes on where the last batch ended and no batch reads
a table to know what came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepared(spark: SparkSession) -> None:
    """State of this kind needs the store that is kept on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _stateful(stream: DataFrame, key: str, more: dict[str, Column], processor: StatefulProcessor) -> DataFrame:
    """The rows that a processor lets by.  It sees them under plain names (rows reach it as named tuples), with ``more`` beside them."""
    _prepared(stream.sparkSession)
    plain = [f"c{k}" for k in range(len(stream.columns))]
    rows = stream.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").alias(p) for c, p in zip(stream.columns, plain, strict=True)), *(c.alias(n) for n, c in more.items()))
    schema = StructType([StructField(p, f.dataType) for p, f in zip(plain, stream.schema, strict=True)])
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "append", "None").toDF(*stream.columns)


class _Newer(StatefulProcessor):
    """Rows with larger ids than the cursor of their user, which is the id of the newest row so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "created string, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.cursor.get() if self.cursor.exists() else None
        newest = held or ("", "")
        least = int(held[1]) if held else None
        for frame in rows:  # one pass, whatever the number of rows; all are held against the cursor of the last batch
            number = frame["id"].map(int)
            new = frame if least is None else frame[number > least]
            if len(new):
                yield new.drop(columns=["key", "created", "id"])
            best = max(zip(frame["created"], number, strict=True))
            if held is None and newest == ("", "") or (best[0], best[1]) > (newest[0], int(newest[1])):
                newest = (best[0], str(best[1]))
        if newest != held:
            self.cursor.update(newest)

    def close(self) -> None:
        pass


def newer_than_cursors(stream: DataFrame, user: str, id_: str, created: str) -> DataFrame:
    """The rows of a stream whose id is larger than their user's cursor; of a user's first batch, all.

    After each batch the cursor is the id of the user's newest row, by
    ``created`` as text, then by number.  Rows without a user or with an id
    that is no number go by; a missing time is the oldest.
    """
    number = F.col(id_).cast("string").try_cast("decimal(38,0)")
    rows = stream.where(F.col(user).isNotNull() & number.isNotNull())
    return _stateful(rows, user, {"id": number.cast("string"), "created": F.coalesce(F.col(created).cast("string"), F.lit(""))}, _Newer())


class _UntilKnown(StatefulProcessor):
    """Listings, newest first, up to the id at which the last one began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["listing", "place"])  # what one batch has of one list
        known = self.known.get()[0] if self.known.exists() else None
        for _, listing in whole.groupby("listing", sort=True):
            ids = listing["id"]
            at = (ids == known).to_numpy().argmax() if known is not None and (ids == known).any() else len(listing)
            if at:
                yield listing.iloc[:at].drop(columns=["key", "listing", "place", "id"])
            known = ids.iloc[0]
        self.known.update((known,))

    def close(self) -> None:
        pass


def until_known(stream: DataFrame, list_: str, listing: str, place: str, id_: str) -> DataFrame:
    """The rows of every listing of a list up to the row at which the listing before began.

    A listing has its rows newest first (``place``); listings of a list come
    in the order of ``listing``, and one listing in one batch.  A known row
    that is gone from the list stops nothing: the listing is then read to its
    end, as a list's first one is.  Rows without a list or an id go by.
    """
    rows = stream.where(F.col(list_).isNotNull() & F.col(id_).isNotNull())
    return _stateful(rows, list_, {"listing": F.col(listing), "place": F.col(place), "id": F.col(id_).cast("string")}, _UntilKnown())


class _Due(StatefulProcessor):
    """Counts labelled rows; tells whenever so many new ones have come, or when some have waited for long."""

    def __init__(self, least: int, patience: int | None) -> None:
        self.least, self.patience = least, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "labelled long, seen long")

    def _told(self, key, marks: list[int], waited: bool) -> Iterator[pd.DataFrame]:
        if marks:
            yield pd.DataFrame({"key": [key[0]] * len(marks), "labelled": marks, "waited": [waited] * len(marks)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        labelled, seen = self.count.get() if self.count.exists() else (0, 0)
        before, marks = labelled, []
        for frame in rows:
            labelled += len(frame)
        while labelled - seen >= self.least:
            seen += self.least
            marks.append(seen)
        self.count.update((labelled, seen))
        if self.patience is not None:
            if marks or before == seen:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if labelled > seen and not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield from self._told(key, marks, False)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        labelled, seen = self.count.get()
        if labelled > seen:
            self.count.update((labelled, labelled))
            yield from self._told(key, [labelled], True)

    def close(self) -> None:
        pass


def due_marks(stream: DataFrame, key: str, label: str, least: int = 20, patience_ms: int | None = None) -> DataFrame:
    """key, labelled and waited: a row whenever a log has ``least`` labelled rows more than at its last mark.

    The marks don't depend on how rows fall into batches: they stand at
    every ``least`` labelled rows.  With ``patience_ms`` a timer also marks a
    log whose new rows have been too few for so long (waited); counting goes
    on from there.  Rows whose label is neither good nor bad don't count.
    """
    from ..plans import qalog

    _prepared(stream.sparkSession)
    rows = stream.where(F.col(key).isNotNull() & (qalog.label_of(F.col(label)) != qalog.UNKNOWN)).select(F.col(key).alias("key"))
    schema = StructType([StructField("key", stream.schema[key].dataType), StructField("labelled", LongType()), StructField("waited", BooleanType())])
    return rows.groupBy("key").transformWithStateInPandas(_Due(least, patience_ms), schema, "append", "None" if patience_ms is None else "ProcessingTime").withColumnRenamed("key", key)
