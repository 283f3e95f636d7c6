"""Queries along a patient's time line, calendars and padded grids."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cohort import any_listed
from .windows import bursts


def spine(spark: SparkSession, start, end, step: str = "1 day", name: str = "day") -> DataFrame:
    """Every step from ``start`` to ``end``, both included."""
    return spark.range(1).select(
        F.explode(
            F.sequence(
                F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"), F.expr(f"INTERVAL {step}")
            )
        ).alias(name)
    )


def spine_of(df: DataFrame, day: str, step: str = "1 day") -> DataFrame:
    """Every day between the first and the last of the column."""
    return df.agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(
        F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step}"))).alias(day)
    )


def pad_grid(df: DataFrame, axes: dict[str, Sequence], fill: dict[str, object]) -> DataFrame:
    """Every combination of the literal axes, with ``fill`` where ``df`` has no row."""
    names = list(axes)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(
        *[
            F.struct(*[F.lit(v).cast(kinds[n]).alias(n) for n, v in zip(names, values)])
            for values in itertools.product(*axes.values())
        ]
    )
    grid = df.sparkSession.range(1).select(F.inline(cells))
    joined = grid.join(df, names, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()}
    )


def before_index(
    df: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str = "index_dt"
) -> DataFrame:
    """Rows that precede their key's index date; ``index`` has one row per key."""
    dated = index.select(F.col(key).alias("_key"), F.col(index_ts).alias("index_dt"))
    on = (F.col(key) == F.col("_key")) & (F.col(ts) < F.col("index_dt"))
    return df.join(dated, on).drop("_key")


def long_span_patients(
    df: DataFrame,
    patient: str,
    ts: str,
    min_exams: int = 2,
    min_years: int = 5,
) -> DataFrame:
    """Patients with enough exams over enough complete years."""
    years = F.timestamp_diff(
        "YEAR", F.col("earliest").cast("timestamp"), F.col("latest").cast("timestamp")
    )
    return (
        df.groupBy(patient)
        .agg(
            F.count(F.lit(1)).alias("exams"),
            F.min(ts).alias("earliest"),
            F.max(ts).alias("latest"),
        )
        .withColumn("years_span", years)
        .filter((F.col("exams") >= min_exams) & (F.col("years_span") >= min_years))
    )


def surveillance(
    df: DataFrame,
    patient: str,
    ts: str,
    mention: Column,
    k: int = 3,
    months: int = 18,
    tiebreak: Sequence[str] = (),
    runs: int | None = None,
) -> DataFrame:
    """Patients with a burst of exams and at least one exam that mentions a finding."""
    found = bursts(df, patient, ts, k, months, tiebreak, runs)
    totals = df.groupBy(patient).agg(
        F.count(F.lit(1)).alias("total_exams"),
        F.count_if(F.coalesce(mention, F.lit(False))).alias("mentions"),
    )
    return totals.filter("mentions > 0").join(found, patient)


def imaging_before(
    df: DataFrame,
    index_pred: Column,
    patient: str,
    ts: str,
    modality: str = "modality",
) -> DataFrame:
    """Exams before the first exam that satisfies the predicate, summed up per patient."""
    index = df.filter(index_pred).groupBy(patient).agg(F.min(ts).alias("index_dt"))
    prior = before_index(df, index, patient, ts)
    return prior.groupBy(patient).agg(
        F.count(F.lit(1)).alias("prior_reports"),
        F.min(ts).alias("earliest_imaging"),
        F.max(ts).alias("latest_imaging"),
        F.array_sort(F.collect_set(modality)).alias("modalities"),
    )


def patient_history(
    df: DataFrame, ids: DataFrame | Sequence, ts: str, columns: Sequence[str] = ("resolved_epic_mrn",)
) -> DataFrame:
    """Rows of the listed patients in time order; ``ids`` are values or a table with a column ``id``."""
    return any_listed(df, ids, columns).orderBy(ts)
