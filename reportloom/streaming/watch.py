"""Watching the feed: messages that no archive entry follows, files whose status stalls."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

# Fixed value: minutes after which a message should have been batched.
BATCH_MINUTES = 30
#: The state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unbatched(
    messages: DataFrame,
    entries: DataFrame,
    key: str = "key",
    sent: str = "received_at",
    stored: str = "archived_at",
    minutes: int = BATCH_MINUTES,
    late: str = "10 minutes",
) -> DataFrame:
    """Messages of a stream without an archive entry of their key within so many minutes.

    A message is held until the watermarks of both streams, each ``late`` behind its newest
    time, have passed the end of its window, then reported once and forgotten; an entry
    until no message can match it.  So the state holds the messages and entries of the
    window and the lateness.  A message or entry that comes later than that is ignored; a
    message without key has no entry.
    """
    noted = entries.select(F.col(key).alias("_entry"), F.col(stored).alias("_stored")).withWatermark("_stored", late)
    held = messages.withWatermark(sent, late)
    follows = (
        (F.col(key) == F.col("_entry"))
        & (F.col("_stored") >= F.col(sent))
        & (F.col("_stored") <= F.col(sent) + F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    )
    return held.join(noted, follows, "left_outer").filter(F.col("_entry").isNull()).select(*messages.columns)


class _Stall(StatefulProcessor):
    """Per file the newest status, and a timer that runs out when nothing follows it."""

    def __init__(self, after: dt.timedelta, final: Sequence[str]):
        self._after, self._final = after, frozenset(final)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        kinds = StructType([StructField("status", StringType()), StructField("at", TimestampType())])
        self._newest = handle.getValueState("newest", kinds)

    def _forget(self) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self._newest.get() if self._newest.exists() else None
        for frame in rows:
            for status, at in zip(frame["status"], frame["at"]):
                # A final status wins at equal times; what came before the newest is history.
                if newest is None or (at, status in self._final) >= (pd.Timestamp(newest[1]), newest[0] in self._final):
                    newest = (status, at.to_pydatetime())
        self._forget()
        self._newest.update(newest)
        if newest[0] not in self._final:
            due = pd.Timestamp(newest[1], tz="UTC") + self._after
            self._handle.registerTimer(int(due.timestamp() * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at = self._newest.get()
        yield pd.DataFrame({"file_path": [key[0]], "status": [status], "at": [pd.Timestamp(at)]})

    def close(self) -> None:
        pass


def stalled(
    status: DataFrame,
    path: str = "file_path",
    kind: str = "status",
    at: str = "processed_at",
    after: dt.timedelta = dt.timedelta(minutes=30),
    final: Sequence[str] = ("success", "failed"),
    late: str = "10 minutes",
) -> DataFrame:
    """Files of a status stream that have stayed in a status that is not final for too long.

    One row per stall: ``file_path, status, at``, when the watermark, ``late`` behind the
    newest time, passes ``after`` since the newest status.  A file that goes on and stalls again is
    reported again.  The state is a row a file; rows without file, status or time are
    skipped, late ones ignored.  The session needs the state store :data:`ROCKS`.
    """
    rows = status.select(F.col(path).alias("file_path"), F.col(kind).alias("status"), F.col(at).cast("timestamp").alias("at"))
    known = rows.filter("file_path IS NOT NULL AND status IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return known.groupBy("file_path").transformWithStateInPandas(
        _Stall(after, final), "file_path string, status string, at timestamp", "Append", "EventTime"
    )


def with_timers(spark: SparkSession) -> SparkSession:
    """A session on the same context whose streams keep their state where timers work."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session
