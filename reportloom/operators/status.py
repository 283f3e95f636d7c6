"""Ingest status: append-only log, current state, lineage and monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import upsert
from .longitudinal import spine, spine_of
from .windows import latest_status

# States of a file.
STATUS_COLUMNS = ("file_path", "type", "status", "error_message", "processed_at")


def status_rows(
    df: DataFrame,
    path: str,
    status: str | Column,
    kind: str = "HL7",
    error: Column | str | None = None,
    at: Column | None = None,
) -> DataFrame:
    """Status log rows for a set of paths."""
    message = F.lit(error) if not isinstance(error, Column) else error
    return df.select(
        F.col(path).alias("file_path"),
        F.lit(kind).alias("type"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        message.cast("string").alias("error_message"),
        (F.current_timestamp() if at is None else at).alias("processed_at"),
    )


def append_status(df: DataFrame, path: str) -> None:
    """Append to the status log."""
    df.select(*STATUS_COLUMNS).write.mode("append").parquet(path)


def current_status(
    log: DataFrame,
    path: str = "file_path",
    at: str = "processed_at",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Last status written for each path."""
    return latest_status(log, path, at, tiebreak)


def upsert_status(current: DataFrame, batch: DataFrame, path: str = "file_path",
                  at: str = "processed_at", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Fold new log rows into the current states."""
    return upsert(current, latest_status(batch, path, at, tiebreak), path)


def upsert_lineage(
    target: DataFrame, source: DataFrame, key: Sequence[str] = ("log_path", "message_number")
) -> DataFrame:
    """Lineage rows are unique per log and message number; a repeat replaces."""
    return upsert(target, source, key)


def mark_failed(manifest: DataFrame, error: str, path: str = "path", at: Column | None = None) -> DataFrame:
    """Status rows that fail every path of a manifest."""
    return status_rows(manifest, path, "failed", error=error, at=at)


def recent_files(
    status: DataFrame, lineage: DataFrame, path: str = "file_path", lineage_path: str = "hl7_path"
) -> DataFrame:
    """Current status with the log, message number and date it came from."""
    return status.join(
        lineage.withColumnRenamed(lineage_path, path), path
    )


def file_counts(
    recent: DataFrame, day: str = "date", status: str = "status"
) -> DataFrame:
    return recent.groupBy(day, status).agg(F.count(F.lit(1)).alias("files"))


def error_files(recent: DataFrame, status: str = "status", failed: str = "failed") -> DataFrame:
    return recent.filter(F.col(status) == failed)


def daily_series(
    counts: DataFrame,
    start=None,
    end=None,
    day: str = "date",
    status: str = "status",
    files: str = "files",
    failed: str = "failed",
) -> DataFrame:
    """One row per day, failed and other files apart, 0 where there were none.

    Without bounds the series runs from the first to the last day of the counts.
    """
    days = (
        spine(counts.sparkSession, start, end, name=day)
        if start is not None and end is not None
        else spine_of(counts, day)
    )
    is_failed = F.col(status) == failed
    summed = counts.groupBy(day).agg(
        F.sum(F.when(is_failed, F.col(files)).otherwise(0)).alias("failed"),
        F.sum(F.when(is_failed, 0).otherwise(F.col(files))).alias("succeeded"),
    )
    return days.join(summed, day, "left").fillna(0, ["failed", "succeeded"])


def windowed_counts(
    events: DataFrame,
    ts: str,
    width: str,
    slide: str | None = None,
    watermark: str | None = None,
    failed: Column | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Events per time window; works on batches and, with a watermark, on streams."""
    source = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark is not None:
        source = source.withWatermark("_ts", watermark)
    span = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    aggs = [F.count(F.lit(1)).alias("n")]
    if failed is not None:
        aggs.append(F.count_if(failed).alias("failures"))
    return (
        source.groupBy(span.alias("w"), *keys)
        .agg(*aggs)
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *keys,
            "n",
            *(["failures"] if failed is not None else []),
        )
    )


def rates(
    events: DataFrame,
    ts: str,
    width: str = "5 minutes",
    slide: str = "1 minute",
    watermark: str | None = None,
    failed: Column | None = None,
) -> DataFrame:
    """Events per second and success percentage over a sliding window."""
    failed = F.lit(False) if failed is None else failed
    counted = windowed_counts(events, ts, width, slide, watermark, failed)
    seconds = F.unix_timestamp("window_end") - F.unix_timestamp("window_start")
    return counted.select(
        "window_start",
        "window_end",
        "n",
        (F.col("n") / seconds).alias("per_second"),
        (F.lit(100.0) * (F.col("n") - F.col("failures")) / F.col("n")).alias("success_pct"),
    )


def feed_gaps(
    events: DataFrame, ts: str, gap: str = "24 hours", start=None, end: Column | str | None = None
) -> DataFrame:
    """Tumbling windows without any event that are over by ``end``, now if not given.

    So a feed that has stopped is reported.  The first window is that of ``start`` or
    of the first event.  Counts per window come first, so the calendar joins a handful
    of rows per window and not the events.
    """
    seen = windowed_counts(events, ts, gap).select("window_start")
    last = F.current_timestamp() if end is None else end if isinstance(end, Column) else F.lit(str(end))
    step = F.expr(f"INTERVAL {gap}")
    bounds = seen.agg(F.min("window_start").alias("_a"))
    if start is not None:
        bounds = bounds.withColumn("_a", F.lit(str(start)).cast("timestamp"))
    bounds = bounds.withColumn("_b", last.cast("timestamp") - step)
    calendar = bounds.filter("_a <= _b").select(
        F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {gap}"))).alias("window_start")
    )
    return calendar.join(seen, "window_start", "left_anti")


def failures_since(
    events: DataFrame, ts: str, failed: Column, width: str = "15 minutes"
) -> DataFrame:
    """Windows with at least one failure."""
    return windowed_counts(events, ts, width, failed=failed).filter("failures > 0")


def stalled(
    received: DataFrame,
    processed: DataFrame,
    ts: str,
    width: str = "30 minutes",
) -> DataFrame:
    """Windows in which messages arrived but none were processed."""
    arrived = windowed_counts(received, ts, width)
    done = windowed_counts(processed, ts, width).select("window_start")
    return arrived.join(done, "window_start", "left_anti")
