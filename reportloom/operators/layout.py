"""Clustered layout: rows ordered along a Hilbert curve over several columns.

Sorting by one column lets a filter on it skip row groups; along the curve, rows that are
near in all of several columns lie together, so a filter on any of them skips most.
Each column is first replaced by its rank among cuts drawn from a bounded sample, so
skewed values are spread evenly; equal values get equal ranks.  The rows are then ranged by
their place on the curve.  Filters for single values, such as ids, get Parquet Bloom filters.
The files are plain Parquet: any reader gains, and no list of them is kept.

NULLs rank first.  The order of rows is all that changes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archives import _opened

#: Values of a column that the cuts are drawn from, at most so many in expectation.
SAMPLE = 100_000


def curve(ranks: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points whose coordinates have so many bits."""
    x = [np.asarray(r, dtype=np.int64).copy() for r in ranks]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the finer cubes
        for i in range(len(x)):
            flipped = (x[i] & q) != 0
            swapped = np.where(flipped, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flipped, x[0] ^ (q - 1), x[0] ^ swapped)
            x[i] = x[i] ^ swapped
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | ((c ^ turn) >> b & 1)
    return out


def _comparable(df: DataFrame, name: str) -> Column:
    """The column as text or a number of the same order."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind == "string":
        return c
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return (F.unix_date(c) if kind == "date" else c).cast("double")


def _cuts(df: DataFrame, by: Sequence[str], bits: int, seed: int) -> list[np.ndarray]:
    """At most ``2 ** bits - 2`` cuts of each column at equal shares of a sample; frequent values repeat."""
    share = min(1.0, SAMPLE / max(1, df.count()))
    sampled = df.select(*[_comparable(df, c).alias(c) for c in by]).sample(share, seed).toPandas()
    out = []
    for c in by:
        known = np.sort(sampled[c].dropna().to_numpy())
        at = np.linspace(0, max(0, len(known) - 1), num=min(len(known), (1 << bits) - 2)).astype(np.int64)
        out.append(known[at])
    return out


def clustered(df: DataFrame, by: Sequence[str], partitions: int | None = None, bits: int = 10, seed: int = 5) -> DataFrame:
    """``df`` ranged and sorted along the curve over the columns ``by``."""
    if not by or bits * len(by) > 62:
        raise ValueError("the columns' bits must fit into a number of 62")
    cuts = _cuts(df, by, bits, seed)

    def place(*columns: pd.Series) -> pd.Series:
        ranks = []
        for values, edges in zip(columns, cuts):
            rank = np.zeros(len(values), dtype=np.int64)
            known = values.notna().to_numpy()
            rank[known] = 1 + np.searchsorted(edges, values[known].to_numpy(), side="right")
            ranks.append(rank * ((1 << bits) - 1) // (1 + len(edges)))  # over the whole side of the cube
        return pd.Series(curve(ranks, bits))

    name = "_place"
    while name in df.columns:
        name += "_"
    placed = df.withColumn(name, F.pandas_udf(place, "long")(*[_comparable(df, c) for c in by]))
    ranged = placed.repartitionByRange(partitions, name) if partitions else placed.repartitionByRange(name)
    return ranged.sortWithinPartitions(name).drop(name)


def write_clustered(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    bloom: Sequence[str] = (),
    partitions: int | None = None,
    group_bytes: int | None = None,
) -> None:
    """Write the rows along the curve, with Bloom filters on the columns ``bloom``.

    ``group_bytes`` bounds a row group, what a filter skips at once.
    """
    writer = clustered(df, by, partitions).write
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if group_bytes:
        writer = writer.option("parquet.block.size", str(group_bytes))
    writer.parquet(path)


def groups_read(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """``n_groups, n_read``: row groups of a table, and those whose values may lie in all ranges.

    ``ranges`` maps a column to its least and its greatest wanted value, both included;
    the files' footers are read in the tasks.
    """

    def plain(v):
        return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["path"]:
                with _opened(name) as file:
                    footer = pq.ParquetFile(file).metadata
                    places = {footer.schema.column(i).path: i for i in range(footer.num_columns)}
                    for g in range(footer.num_row_groups):
                        wanted = True
                        for c, (low, high) in ranges.items():
                            found = footer.row_group(g).column(places[c]).statistics
                            if found is None:
                                continue
                            if not found.has_min_max:  # nothing but NULLs
                                wanted = wanted and found.null_count < footer.row_group(g).num_rows
                            else:
                                wanted = wanted and plain(found.min) <= high and low <= plain(found.max)
                        rows.append((int(wanted),))
            yield pd.DataFrame(rows, columns=["wanted"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    found = files.mapInPandas(judged, "wanted int")
    return found.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("wanted"), F.lit(0)).cast("long").alias("n_read"))
