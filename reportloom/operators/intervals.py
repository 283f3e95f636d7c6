"""Joins in time: rows within a window of an event, overlapping intervals, the nearest row before.

Equal keys alone would put all rows of a busy patient into one task and compare each with
each.  Time is cut into bins instead, and rows meet per key and bin.  Bins are as wide as a
window, or as the mean interval, so rows are copied a few times at most, however long the
history.  The nearest earlier row is found in runs of equal size along key and time, and a small
table of edge rows carries the last one of a run into those after it, so one path serves
patients of any size.

NULL keys match nothing; NULL times lie in no window; an interval that ends before it
starts is empty.  Ends count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import in_runs


def _seconds(c: Column) -> Column:
    """Seconds since 1970 of a date or a time, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _bin(seconds: Column, width: Column) -> Column:
    return F.floor(seconds / width).cast("long")


def within(
    df: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str, before: int, after: int = 0
) -> DataFrame:
    """Rows of ``df`` from ``before`` seconds before an event of their key to ``after`` seconds behind it.

    ``index`` has any number of events per key; its other columns come with each match, those
    with names that ``df`` has left out.
    """
    width = F.lit(max(1, before + after))
    at = _seconds(F.col(index_ts))
    more = [c for c in index.columns if c not in df.columns]
    spread = F.sequence(_bin(at - before, width), _bin(at + after, width))  # two bins at most
    events = index.filter(F.col(key).isNotNull() & F.col(index_ts).isNotNull()).select(
        F.col(key).alias("_key"), at.alias("_at"), F.explode(spread).alias("_bin"), *more
    )
    own = _seconds(F.col(ts))
    rows = df.withColumn("_own", own).withColumn("_mine", _bin(F.col("_own"), width))
    met = rows.join(events, (F.col(key) == F.col("_key")) & (F.col("_mine") == F.col("_bin")))
    return met.filter(F.col("_own").between(F.col("_at") - before, F.col("_at") + after)).select(*df.columns, *more)


def overlaps(
    a: DataFrame, b: DataFrame, key: str, start: str, end: str, suffix: str = "_b", width: int | None = None
) -> DataFrame:
    """Pairs of intervals of equal key that share a moment; columns of ``b`` get the suffix.

    ``width`` is that of the bins in seconds, the mean length of an interval if not given:
    then the intervals are copied about three times on average, and a pair is reported in
    the bin where the later one of the two starts.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))

    sides = [usable(a), usable(b)]
    if width is None:
        lengths = [s.select((_seconds(F.col(end)) - _seconds(F.col(start))).alias("n")) for s in sides]
        width = int(lengths[0].union(lengths[1]).agg(F.avg("n")).first()[0] or 0) + 1
    cut = F.lit(width)

    def binned(df: DataFrame, name: str) -> DataFrame:
        first, last = _bin(_seconds(F.col(start)), cut), _bin(_seconds(F.col(end)), cut)
        columns = df.columns if name == "_l" else [f"{c}{suffix}" for c in df.columns]
        return df.select(
            F.col(key).alias(f"{name}_key"),
            first.alias(f"{name}_first"),
            _seconds(F.col(start)).alias(f"{name}_start"),
            _seconds(F.col(end)).alias(f"{name}_end"),
            F.explode(F.sequence(first, last)).alias(f"{name}_bin"),
            *[F.col(c).alias(n) for c, n in zip(df.columns, columns)],
        )

    left, right = binned(sides[0], "_l"), binned(sides[1], "_r")
    met = left.join(right, (F.col("_l_key") == F.col("_r_key")) & (F.col("_l_bin") == F.col("_r_bin")))
    shared = (F.col("_l_start") <= F.col("_r_end")) & (F.col("_r_start") <= F.col("_l_end"))
    once = F.col("_l_bin") == F.greatest("_l_first", "_r_first")
    return met.filter(shared & once).select(*a.columns, *[f"{c}{suffix}" for c in b.columns])


def nearest_before(
    df: DataFrame,
    index: DataFrame,
    key: str,
    ts: str,
    index_ts: str,
    columns: Sequence[str],
    tiebreak: Sequence[str] = (),
    strict: bool = True,
    most: int | None = None,
    runs: int | None = None,
) -> DataFrame:
    """Every event of ``index`` with ``columns`` of the newest row of its key before it.

    ``strict`` leaves out rows of the same time.  Among rows of one time the largest
    ``tiebreak`` wins.  ``runs`` is the number of runs, by the number of rows if not given.  Where no row is found, or it is more than ``most`` seconds
    older, the columns are NULL.  ``columns`` may be names that ``index`` lacks.
    """
    ties = [f"_tie{i}" for i in range(len(tiebreak))]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    # The event as a whole and the row as a whole, one of them NULL.
    rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(ts).alias("_at"),
        F.lit(1 if strict else 0).alias("_side"),
        *[F.col(c).alias(t) for c, t in zip(tiebreak, ties)],
        F.struct(F.col(ts).alias("_when"), *columns).alias("_row"),
    )
    events = index.select(
        F.col(key).alias("_key"),
        F.col(index_ts).alias("_at"),
        F.lit(0 if strict else 1).alias("_side"),
        *[F.lit(None).cast(kinds[c]).alias(t) for c, t in zip(tiebreak, ties)],
        F.struct(*index.columns).alias("_event"),
    )
    order = ["_at", "_side", *ties]
    both = in_runs(rows.unionByName(events, allowMissingColumns=True), ["_key"], order, runs)
    so_far = Window.partitionBy("_key", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_row", ignorenulls=True).over(so_far))
    # Keys that lie in several runs: fewer than runs, with a row for each of their runs.
    spread = both.groupBy("_key").agg(F.min("_run").alias("_a"), F.max("_run").alias("_b")).filter("_a < _b")
    edge = F.max(F.when(F.col("_row").isNotNull(), F.struct(*order, "_row")))
    inner = both.join(F.broadcast(spread.select("_key")), "_key", "left_semi")
    edges = inner.groupBy("_key", "_run").agg(edge["_row"].alias("_edge"))
    earlier = Window.partitionBy("_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("_carried", F.last("_edge", ignorenulls=True).over(earlier)).drop("_edge")
    found = seen.filter(F.col("_event").isNotNull()).join(F.broadcast(carried), ["_key", "_run"], "left")
    last = F.coalesce("_last", "_carried")
    if most is not None:
        last = F.when(_seconds(F.col("_at")) - _seconds(last["_when"]) <= most, last)
    return found.select("_event.*", *[last[c].alias(c) for c in columns])
