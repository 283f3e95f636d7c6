"""Helpers the operators share: written intermediate tables and text columns."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import give_back, giving_back, scratch_path  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back.

    Cuts the lineage: an executor lost later costs a reread, not a recomputation,
    and several consumers share one run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the cluster drop the shuffle files of plans that nobody refers to any more.

    Spark does so when the driver's JVM collects garbage, which a driver with little
    to do may not for half an hour, while a job of many steps fills the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_text(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Words of a text, as long; a null text has none."""
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")
