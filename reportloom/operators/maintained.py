"""Aggregates that follow a change log instead of being recomputed.

A change row counts plus one if it is an insert or the image after an update, minus one
if it is a delete or the image before one.  Counts and sums of a batch's signed rows
are the batch's deltas; deltas of all batches add up to the aggregate of the table.  So
a batch reads its own change rows and nothing else.  Distinct counts keep a count per
value and count the values that are left.

Stored deltas are plain Parquet, a folder per commit that a replay overwrites with the same
rows.  ``fold`` adds up the commits so far, after which reading starts there.  Minima and maxima
cannot be taken back and are not offered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import CHANGE_COLUMNS, PREIMAGE, UPSERTS
from .metrics import _list

_KIND, _VERSION, _ = CHANGE_COLUMNS


def sign(kind: str = _KIND) -> Column:
    """What a change row adds to a count."""
    c = F.col(kind)
    return F.when(c.isin(*UPSERTS), F.lit(1)).when(c.isin("delete", PREIMAGE), F.lit(-1)).otherwise(F.lit(0)).cast("long")


def deltas(changes: DataFrame, keys: str | Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``n``, and for each column to add up its sum and its known values, by which each group changes.

    Updates must come with their pre-images.  Groups that stay as they are yield nothing.
    """
    by = sign()
    totals = [F.sum(by).alias("n")]
    for c in sums:
        totals += [
            F.coalesce(F.sum(by * F.col(c)), F.lit(0)).alias(f"sum_{c}"),
            F.sum(F.when(F.col(c).isNotNull(), by).otherwise(0)).alias(f"known_{c}"),
        ]
    grouped = changes.groupBy(*_list(keys)).agg(*totals)
    names = [n for n in grouped.columns if n not in _list(keys)]
    return grouped.filter(" OR ".join(f"`{n}` <> 0" for n in names))


def added_up(parts: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The sum of deltas; groups without rows are gone."""
    totals = [c for c in parts.columns if c not in (*_list(keys), _VERSION)]
    return parts.groupBy(*_list(keys)).agg(*[F.sum(c).alias(c) for c in totals]).filter("n <> 0")


@dataclass
class MaintainedAggregate:
    """Counts, sums and averages by ``keys``, or distinct values of ``distinct``, stored under ``path``."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    sums: Sequence[str] = ()
    distinct: str | None = None

    def _by(self) -> list[str]:
        return [*self.keys, *([self.distinct] if self.distinct else [])]

    def _folder(self, name: str, version: int) -> str:
        return f"{self.path.rstrip('/')}/{name}/{_VERSION}={version}"

    def apply(self, version: int, changes: DataFrame) -> None:
        """Store the deltas of a commit; a replay stores them again."""
        deltas(changes, self._by(), self.sums).write.mode("overwrite").parquet(self._folder("deltas", version))

    def _stored(self, name: str) -> DataFrame | None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(root.toString()) if files.exists(root) else None

    def _parts(self) -> DataFrame:
        """The newest fold and the commits after it."""
        commits, folds = self._stored("deltas"), self._stored("folds")
        if commits is None:
            raise FileNotFoundError(f"no commits in {self.path}")
        if folds is None:
            return commits
        last = folds.agg(F.max(_VERSION)).first()[0]
        if last is None:  # nothing was left to fold
            return commits
        return folds.filter(F.col(_VERSION) == last).unionByName(commits.filter(F.col(_VERSION) > last))

    def fold(self, version: int) -> None:
        """Add up the commits up to ``version``, which must all have been applied for good."""
        parts = self._parts().filter(F.col(_VERSION) <= version)
        added_up(parts, self._by()).write.mode("overwrite").parquet(self._folder("folds", version))

    def read(self) -> DataFrame:
        """``n`` and the sums and averages of each group, as a recomputation gives them."""
        total = added_up(self._parts(), self._by())
        if self.distinct:
            return total.groupBy(*self.keys).agg(F.count(self.distinct).alias("n"))
        out = [*self.keys, "n"]
        for c in self.sums:
            known = F.col(f"known_{c}")
            out += [
                F.when(known > 0, F.col(f"sum_{c}")).alias(f"sum_{c}"),
                F.when(known > 0, F.col(f"sum_{c}") / known).alias(f"avg_{c}"),
            ]
        return total.select(*out)
