"""Ordered operators that stay distributed when one key dominates.

Keeping the first ``n`` rows per key needs no care: Spark limits each group
before the shuffle, so a hot key arrives as at most ``n`` rows per task.  Lags,
leads and row numbers need the whole group in order.  For those, all rows are cut
into runs of equal size along key and order, windows work inside a run, and a small
table with a few edge rows per run carries values across the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_n_per(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str], n: int
) -> DataFrame:
    """The first ``n`` rows per key."""
    w = Window.partitionBy(*_list(keys)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def newest_per(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """One row per key, the first in the given order (make it total)."""
    return first_n_per(df, keys, order, 1)


def stratified(
    df: DataFrame,
    strata: Sequence[str],
    n: int,
    order: Sequence[Column | str],
) -> DataFrame:
    """At most ``n`` rows per stratum; rows with a NULL stratum are left out."""
    known = df
    for s in strata:
        known = known.filter(F.col(s).isNotNull())
    return first_n_per(known, strata, order, n)


def duplicate_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
) -> DataFrame:
    """Flag every row but the first of its key group as ``is_duplicate``.

    The first row is found by a minimum, which combines before the shuffle, and
    compared with null-safe keys; the group itself is never gathered.  ``order``
    must be unique within a group.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys]
    return (
        df.join(first, same, "inner")
        .withColumn("is_duplicate", F.col(order) != F.col("_first"))
        .drop("_first", *[f"_f_{k}" for k in keys])
    )


#: Rows of a run, where the number of runs is not given.
RUN_ROWS = 1_000_000


def runs_for(df: DataFrame, rows: int = RUN_ROWS) -> int:
    """Number of runs of about so many rows; counts the rows."""
    return max(1, -(-df.count() // rows))


def in_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], runs: int | None = None) -> DataFrame:
    """Add ``_run``: the range of key and order a row falls in, all of about equal size.

    Ranges are cut by rank, so neither a key with very many rows nor many equal
    dates make a large one, as long as the order is total.  The rows are written
    once, since two evaluations might draw different ranges.
    """
    runs = runs or runs_for(df)
    if runs == 1:
        return df.withColumn("_run", F.lit(0).cast("bigint"))
    ranged = df.repartitionByRange(runs, *keys, *order)
    return cut(ranged.withColumn("_run", F.spark_partition_id().cast("bigint")))


def with_neighbours(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    lags: dict[str, tuple[str, int]] | None = None,
    leads: dict[str, tuple[str, int]] | None = None,
    number: str | None = None,
    size: str | None = None,
    runs: int | None = None,
) -> DataFrame:
    """Add lags, leads, the row number and the group size per key.

    ``lags`` and ``leads`` map a new column to ``(source column, offset)``.
    ``order`` columns are ascending and should be total.  Equal to the window
    functions of the same names.  ``runs`` is the number of runs; if it is not given it
    follows the number of rows, and where one run holds them all nothing is cut or written
    and the window functions are taken as they are.  A cut falls into at most one key, so at most
    ``runs - 1`` keys have rows in several runs; only those need edges, two rows of
    them for each run at most, which bounds the broadcast sides.
    """
    keys, order = _list(keys), list(order)
    lags, leads = lags or {}, leads or {}
    number_of_runs = runs or runs_for(df)
    if number_of_runs == 1:
        whole = Window.partitionBy(*keys)
        by = whole.orderBy(*order)
        plain = {n: F.lag(c, k).over(by) for n, (c, k) in lags.items()} | {n: F.lead(c, k).over(by) for n, (c, k) in leads.items()}
        if number:
            plain[number] = F.row_number().over(by).cast("bigint")
        if size:
            plain[size] = F.count(F.lit(1)).over(whole)
        return df.withColumns(plain).select(*df.columns, *plain)
    runs = in_runs(df, keys, order, number_of_runs)
    in_run = Window.partitionBy(*keys, "_run").orderBy(*order)
    rows = runs.withColumns(
        {
            "_pos": F.row_number().over(in_run),
            "_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")),
            **{n: F.lag(c, k).over(in_run) for n, (c, k) in lags.items()},
            **{n: F.lead(c, k).over(in_run) for n, (c, k) in leads.items()},
        }
    )

    # A few edge rows per run, so the windows over them stay small.
    depth = max([k for _, k in [*lags.values(), *leads.values()]], default=0)
    carried = sorted({c for c, _ in [*lags.values(), *leads.values()]})
    edge = F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in carried])
    cell = [*keys, "_run"]

    def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
        named = right.select(
            *[F.col(k).alias(f"_j_{k}") for k in on],
            *[c for c in right.columns if c not in on],
        )
        same = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in on]
        found = left.join(F.broadcast(named), same, how)
        return found if how == "left_semi" else found.drop(*[f"_j_{k}" for k in on])

    spread = runs.groupBy(*keys).agg(F.min("_run").alias("_a"), F.max("_run").alias("_b"))
    inner = joined(runs, spread.filter("_a < _b").select(*keys), keys, "left_semi")
    edges = inner.groupBy(*cell).agg(F.count(F.lit(1)).alias("_size"))

    if leads:
        heads = first_n_per(inner, cell, order, depth)
        heads = heads.groupBy(*cell).agg(F.array_sort(F.collect_list(edge)).alias("_head"))
        edges = joined(edges, heads, cell)
    if lags:
        tails = first_n_per(inner, cell, [F.desc(c) for c in order], depth)
        tails = tails.groupBy(*cell).agg(
            F.reverse(F.array_sort(F.collect_list(edge))).alias("_tail")
        )
        edges = joined(edges, tails, cell)

    ahead = Window.partitionBy(*keys).orderBy("_run")
    behind = Window.partitionBy(*keys).orderBy(F.desc("_run"))
    carry = {
        "_before": F.coalesce(
            F.sum("_size").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
        "_total": F.sum("_size").over(Window.partitionBy(*keys)),
    }
    if leads:
        carry["_next"] = F.flatten(F.collect_list("_head").over(ahead.rowsBetween(1, depth)))
    if lags:
        carry["_prev"] = F.flatten(F.collect_list("_tail").over(behind.rowsBetween(1, depth)))
    whole = joined(rows, edges.withColumns(carry), cell, "left")

    out = {}
    for name, (c, k) in lags.items():
        at = F.lit(k) - F.col("_pos")
        out[name] = F.when(at < 0, F.col(name)).otherwise(
            F.get("_prev", at.cast("int"))[f"_v_{c}"]
        )
    for name, (c, k) in leads.items():
        # Rows left in the run after this one, against those needed.
        at = F.lit(k - 1) - (F.col("_rows") - F.col("_pos"))
        out[name] = F.when(at < 0, F.col(name)).otherwise(
            F.get("_next", at.cast("int"))[f"_v_{c}"]
        )
    if number:
        out[number] = (F.coalesce("_before", F.lit(0)) + F.col("_pos")).cast("bigint")
    if size:
        out[size] = F.coalesce("_total", "_rows").cast("bigint")
    return whole.withColumns(out).select(*df.columns, *out)


def tag_new_returning(
    df: DataFrame, patient: str, ts: str, grain: str = "month", out: str = "cohort"
) -> DataFrame:
    """``new`` in the patient's first period, ``returning`` in later ones.

    The first date is a minimum that combines before the shuffle and is joined
    back, so a patient with very many rows does not end up in one task.
    """
    dated = df.filter(F.col(ts).isNotNull())
    first = dated.groupBy(patient).agg(F.min(ts).alias("_first"))
    same_period = F.date_trunc(grain, F.col(ts)) == F.date_trunc(grain, F.col("_first"))
    return (
        dated.join(first.select(F.col(patient).alias("_p"), "_first"), F.col(patient).eqNullSafe(F.col("_p")))
        .withColumn(out, F.when(same_period, "new").otherwise("returning"))
        .drop("_first", "_p")
    )


def bursts(
    df: DataFrame,
    patient: str,
    ts: str,
    k: int = 3,
    months: int = 18,
    tiebreak: Sequence[str] = (),
    runs: int | None = None,
) -> DataFrame:
    """Patients with ``k`` rows within ``months`` full months.

    ``patient, burst_first, burst_last``: the earliest such burst, the shortest
    one where several start together.
    """
    dated = df.select(patient, ts, *tiebreak)
    ahead = with_neighbours(
        dated, patient, [ts, *tiebreak], leads={"_kth": (ts, k - 1)}, runs=runs
    )
    span = F.timestamp_diff("MONTH", F.col(ts).cast("timestamp"), F.col("_kth").cast("timestamp"))
    return (
        ahead.filter(span <= months)
        .groupBy(patient)
        .agg(
            F.min(ts).alias("burst_first"),
            F.min_by("_kth", F.struct(ts, "_kth")).alias("burst_last"),
        )
    )


def latest_status(
    df: DataFrame,
    path: str = "file_path",
    at: str = "processed_at",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The newest status row of each path."""
    return newest_per(df, path, [F.desc(at), *[F.desc(t) for t in tiebreak]])


def display_id(*cols: Column | str) -> Column:
    """Label of a patient: the first identifier that is not NULL."""
    return F.coalesce(*cols)
