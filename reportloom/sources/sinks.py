"""Writers: partitioned tables, guarded CSV, cohort exports, batched folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of a cohort export.
EXPORT_COLUMNS = (
    "accession_number",
    "patient_id",
    "epic_mrn",
    "mpi",
    "patient_age",
    "sex",
    "race",
    "ethnic_group",
    "modality",
    "service_name",
    "requested_dt",
    "observation_dt",
    "sending_facility",
)


def write_table(
    df: DataFrame, path: str, partition_by: str | None = "year", mode: str = "append"
) -> None:
    """Append to a parquet table, creating it if absent.

    Rows are first rebalanced on the partition column, so a task writes few
    partitions and a dominant partition value is still written by many tasks.
    """
    if partition_by is None:
        df.write.mode(mode).parquet(path)
        return
    df.hint("rebalance", F.col(partition_by)).write.mode(mode).partitionBy(partition_by).parquet(
        path
    )


def formula_guard(c: Column) -> Column:
    """Prefix a quote to cells a spreadsheet would evaluate."""
    return F.regexp_replace(c.cast("string"), r"^([=+\-@\t\r])", "'$1")


def export_csv(
    df: DataFrame, path: str, guard: bool = True, columns: Sequence[str] | None = None
) -> None:
    """CSV with every cell quoted, NULL as an empty cell and embedded quotes doubled."""
    chosen = df.select(*(columns or df.columns))
    cells = [
        F.coalesce(formula_guard(F.col(c)) if guard else F.col(c).cast("string"), F.lit("")).alias(
            c
        )
        for c in chosen.columns
    ]
    chosen.select(*cells).write.mode("overwrite").option("header", True).option(
        "quoteAll", True
    ).option("escape", '"').option("emptyValue", "").csv(path)


def export_cohort(
    df: DataFrame,
    annotations: DataFrame | None = None,
    include_text: bool = False,
    key: str = "accession_number",
    columns: Sequence[str] = EXPORT_COLUMNS,
    text: str = "report_text",
) -> DataFrame:
    """Export columns, then the reviewer's decision where one was recorded.

    ``annotations`` holds ``key, reviewed, included, notes``.
    """
    out = df.select(*columns, *([text] if include_text else []))
    if annotations is None:
        return out.withColumns(
            {
                "manually_included": F.lit(None).cast("boolean"),
                "manual_review_notes": F.lit(""),
            }
        )
    decided = annotations.filter("reviewed").select(
        key,
        F.col("included").alias("manually_included"),
        F.col("notes").alias("manual_review_notes"),
    )
    return out.join(decided, key, "left").withColumn(
        "manual_review_notes", F.coalesce("manual_review_notes", F.lit(""))
    )


def fold_batches(df: DataFrame, by: str | Sequence[str], **sums: Column) -> DataFrame:
    """Running totals of a large result per group.

    Every task folds the batches it reads into partial sums; only those are shuffled.
    """
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in sums.items()])
