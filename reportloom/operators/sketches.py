"""Stored sketches: quantiles and distinct sets that are merged instead of recomputed.

A table of sketches has a row per group, for instance per day, modality and facility.
A chart over any range of days and any coarser grouping reads those rows alone: the
sketches of a group are merged, in part before the shuffle, and never grow beyond their
size.  Rows of a further batch are appended; merging does not care how they were cut.

Quantiles are KLL sketches of whole numbers.  The rank of an estimate is off by no more
than :func:`rank_error` of the rows with 99 % confidence, and small groups are exact.  Sets
are theta sketches: exact up to ``2 ** lg`` values, beyond that within a relative error
of ``2 ** (-lg / 2)`` as a standard deviation.  NULL values are in no sketch; a group of
nothing but NULLs, and an absent one, count 0 and have NULL quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import _list, pct

SKETCH = "sketch"
K = 400
LG = 14


def rank_error(k: int = K) -> float:
    """Largest difference, as a share of the rows, between the rank asked for and that of the estimate."""
    return 2.296 / k**0.9723


def minutes_between(start: str, end: str) -> Column:
    """Whole minutes of a turnaround that ends after it starts, else NULL."""
    minutes = F.timestamp_diff("MINUTE", F.col(start).cast("timestamp"), F.col(end).cast("timestamp"))
    return F.when(F.col(end) > F.col(start), minutes)


def quantile_sketches(df: DataFrame, value: str | Column, by: Sequence[str], k: int = K) -> DataFrame:
    """A sketch of the whole numbers of each group, with their count ``n``."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, value.cast("long").alias("_value")).filter(F.col("_value").isNotNull())
    return rows.groupBy(*by).agg(F.kll_sketch_agg_bigint("_value", k).alias(SKETCH), F.count("*").alias("n"))


def merged_quantiles(
    sketches: DataFrame, probs: dict[str, float], by: str | Sequence[str] | None = None, scale: float | None = None
) -> DataFrame:
    """Count ``n`` and quantiles of coarser groups; ``scale`` divides the values, 60 for hours from minutes."""
    merged = sketches.groupBy(*_list(by)).agg(F.kll_merge_agg_bigint(SKETCH).alias(SKETCH), F.sum("n").alias("n"))
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint(SKETCH, F.array(*[F.lit(p) for p in probs.values()])))
    out = merged.withColumn("_found", found).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    each = [F.col("_found")[i] if scale is None else F.col("_found")[i] / scale for i in range(len(probs))]
    return out.select(*_list(by), "n", *[c.alias(name) for c, name in zip(each, probs)])


def set_sketches(df: DataFrame, value: str | Column, by: Sequence[str], lg: int = LG) -> DataFrame:
    """A sketch of the distinct values of each group."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, value.alias("_value"))
    return rows.groupBy(*by).agg(F.theta_sketch_agg("_value", lg).alias(SKETCH))


def merged_sets(sketches: DataFrame, by: str | Sequence[str] | None = None, lg: int = LG) -> DataFrame:
    """The union of the sets of coarser groups."""
    return sketches.groupBy(*_list(by)).agg(F.theta_union_agg(SKETCH, lg).alias(SKETCH))


def _size(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def set_sizes(sketches: DataFrame, by: str | Sequence[str] | None = None, lg: int = LG) -> DataFrame:
    """Distinct values ``n`` of coarser groups."""
    return merged_sets(sketches, by, lg).select(*_list(by), _size(F.col(SKETCH)).alias("n"))


def compared_sets(a: DataFrame, b: DataFrame, on: str | Sequence[str] | None = None, lg: int = LG) -> DataFrame:
    """Sizes of the sets of two tables and of what they share, for each group of either.

    ``n_a, n_b, n_both, n_only_a, n_only_b, n_either`` and ``pct_kept``, the share of the
    first that is in the second, in per cent.  NULL keys are equal; an absent set is empty.
    """
    keys = _list(on)
    sides = []
    for name, df in (("a", a), ("b", b)):
        merged = merged_sets(df, keys, lg)
        sides.append(merged.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col(SKETCH).alias(f"_{name}")))
    same = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    joined = sides[0].join(sides[1], same if same else F.lit(True), "full_outer")
    x, y = F.col("_a"), F.col("_b")
    held = F.when(x.isNotNull() & y.isNotNull(), F.theta_sketch_estimate(F.theta_intersection(x, y)))
    n_both = F.coalesce(held, F.lit(0).cast("long"))
    only_a = F.when(y.isNull(), _size(x)).when(x.isNotNull(), F.theta_sketch_estimate(F.theta_difference(x, y)))
    only_b = F.when(x.isNull(), _size(y)).when(y.isNotNull(), F.theta_sketch_estimate(F.theta_difference(y, x)))
    either = F.when(x.isNull(), _size(y)).when(y.isNull(), _size(x)).otherwise(F.theta_sketch_estimate(F.theta_union(x, y, lg)))
    zero = F.lit(0).cast("long")
    return joined.select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys],
        _size(x).alias("n_a"),
        _size(y).alias("n_b"),
        n_both.alias("n_both"),
        F.coalesce(only_a, zero).alias("n_only_a"),
        F.coalesce(only_b, zero).alias("n_only_b"),
        F.coalesce(either, zero).alias("n_either"),
        pct(n_both, _size(x)).alias("pct_kept"),
    )
