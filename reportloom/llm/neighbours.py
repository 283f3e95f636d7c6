"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by distance is the nearest by cosine.
A table hashes a vector by ``hashes`` random projections, shifted and cut into cells of
``width``; the cells together are its bucket.  A query visits its own bucket and those
whose cells differ by one step in some projections, in the order in which they are
likely to hold a near neighbour: the order of the summed squared distances to the cell
borders that would be crossed, taken from a template of their expected values.

Buckets are dealt to shards by a hash, and a shard with many entries to several parts,
by a hash of the vector, so a bucket that holds a third of all vectors is spread.  A
query goes once to every shard in which it has a bucket to visit, with those buckets; a
shard answers with its best candidates only, measured exactly in double precision on
the original vectors, and the tables' answers are merged.  A query that found fewer
than ``k`` candidates is compared with every vector of its length.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null ids; vectors of unlike lengths never meet; rows of
equal id are separate candidates for others, none for itself, and of them the nearest
counts; ties go to the smaller id; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

FOUND = "query_id long, vec_id long, score double"


def probe_template(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of border ranks to cross, by expected success; the empty set, the own bucket, first.

    Rank j is the j-th nearest of a query's ``2 * hashes`` cell borders.  Borders j and
    2 * hashes - 1 - j belong to one projection, so a set holds at most one of them.
    """
    m = hashes
    cost = [
        (j + 1) * (j + 2) / (4 * (m + 1) * (m + 2))
        if j < m
        else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2))
        for j in range(2 * m)
    ]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, ranks = heapq.heappop(heap)
        if all(2 * m - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:  # move the last border on, or cross one more
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], ranks[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + cost[last + 1], ranks + (last + 1,)))
    return out


@dataclass(frozen=True)
class Hashing:
    """Seeded p-stable hash functions for vectors of any length."""

    tables: int
    hashes: int
    width: float
    probes: int
    seed: int

    def _cells(self, unit: np.ndarray) -> np.ndarray:
        """Projections in units of cells: rows by tables by hashes."""
        dim = unit.shape[1]
        rng = np.random.default_rng([self.seed, dim])
        lines = rng.standard_normal((dim, self.tables * self.hashes)) / self.width
        shifts = rng.random(self.tables * self.hashes)
        return (unit @ lines + shifts).reshape(len(unit), self.tables, self.hashes)

    def _keys(self, cells: np.ndarray, table: np.ndarray | int, dim: int) -> np.ndarray:
        """One number for a bucket: table, vector length and cells."""
        key = np.full(cells.shape[:-1], dim, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(table).astype(np.uint64)
        for j in range(cells.shape[-1]):
            key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            key = key + cells[..., j].astype(np.int64).view(np.uint64)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (key ^ (key >> np.uint64(31))).view(np.int64)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        cells = np.floor(self._cells(unit)).astype(np.int64)
        return self._keys(cells, np.arange(self.tables)[None, :], unit.shape[1])

    def visited(self, unit: np.ndarray) -> np.ndarray:
        """Buckets that each query visits: rows by tables by probes."""
        place = self._cells(unit)
        cells = np.floor(place).astype(np.int64)
        below = place - cells
        # Distances to the lower and the upper border of each cell, nearest first.
        order = np.argsort(np.concatenate([below, 1 - below], axis=-1), axis=-1, kind="stable")
        hash_of, step_of = order % self.hashes, np.where(order < self.hashes, -1, 1)
        out = []
        for ranks in probe_template(self.hashes, self.probes):
            moved = cells.copy()
            for r in ranks:
                at = hash_of[..., r : r + 1]
                np.put_along_axis(moved, at, np.take_along_axis(moved, at, -1) + step_of[..., r : r + 1], -1)
            out.append(self._keys(moved, np.arange(self.tables)[None, :], unit.shape[1]))
        return np.stack(out, axis=-1)


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, part in frame.groupby(frame["vec"].map(len), sort=True):
        raw = np.stack(part["vec"].to_numpy()).astype(np.float64)
        yield part, raw


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _index(hashing: Hashing, shards: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, raw in _by_length(frame):
            keys = hashing.buckets(_unit(raw))
            for table in range(hashing.tables):
                own = np.ascontiguousarray(keys[:, table])
                yield pd.DataFrame(
                    {
                        "shard": _shard(own, shards).astype(np.int64),
                        "tab": np.int32(table),
                        "bucket": own,
                        "vec_id": part["vec_id"].to_numpy(),
                        "vec": part["vec"].to_numpy(),
                    }
                )


def _queries(hashing: Hashing, shards: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, raw in _by_length(frame):
            visits = hashing.visited(_unit(raw)).reshape(len(part), -1)
            rows = []
            for query, vec, keys in zip(part["query_id"], part["vec"], visits):
                to = _shard(np.ascontiguousarray(keys), shards)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    rows.append((int(to[order[a]]), query, vec, np.sort(keys[order[a:b]])))
            yield pd.DataFrame(rows, columns=["shard", "query_id", "vec", "buckets"])


def _visit(k: int, query: int, keys, score: np.ndarray, ids: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Places of the ``k`` nearest ids among the entries of the buckets; ties to the smaller id."""
    if keys is None:
        at = np.flatnonzero(ids != query)
    else:
        first = np.searchsorted(buckets, keys, side="left")
        many = np.searchsorted(buckets, keys, side="right") - first
        at = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        at = at[ids[at] != query]
    take = k
    while True:
        some = at
        if take < len(at):
            own = score[at]
            some = at[own >= np.partition(own, len(own) - take)[len(own) - take]]
        some = some[np.lexsort((ids[some], -score[some]))]
        # Rows of one id are one candidate, its nearest row; look further if too few remain.
        _, first_of = np.unique(ids[some], return_index=True)
        if len(first_of) >= k or len(some) == len(at):
            return some[np.sort(first_of)][:k]
        take *= 4


def _nearest(k: int, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The best ``k`` of each query among the entries in its buckets; without buckets, among all."""
    out = []
    if len(queries) and len(entries):
        entries = entries.sort_values("bucket", kind="stable")
        lengths = entries["vec"].map(len).to_numpy()
        for dim, asked in queries.groupby(queries["vec"].map(len)):
            own = entries[lengths == dim]
            if not len(own):
                continue
            raw = np.stack(own["vec"].to_numpy()).astype(np.float64)
            norm, ids, buckets = np.sqrt((raw * raw).sum(axis=1)), own["vec_id"].to_numpy(), own["bucket"].to_numpy()
            for begin in range(0, len(asked), 64):  # bounds the block of scores held at once
                some = asked.iloc[begin : begin + 64]
                q = np.stack(some["vec"].to_numpy()).astype(np.float64)
                near = (q @ raw.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * norm[None, :])
                for row, query, keys in zip(near, some["query_id"], some["buckets"]):
                    best = _visit(k, query, keys, row, ids, buckets)
                    out += [(query, int(ids[i]), float(row[i])) for i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    tables: int = 12,
    hashes: int = 4,
    width: float = 1.0,
    probes: int = 40,
    seed: int = 3,
    shard_entries: int = 40_000,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row."""
    hashing = Hashing(tables, hashes, width, probes, seed)
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"),
        F.col(vector).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    kind = rows.schema["vec"].dataType.simpleString()
    total = rows.count()
    shards = max(1, -(-total * tables // shard_entries))
    entries = staged(
        rows.select("vec_id", "vec").mapInPandas(
            functools.partial(_index, hashing, shards),
            f"shard long, tab int, bucket long, vec_id long, vec {kind}",
        ),
        "entries",
    )
    counts = entries.groupBy("shard").agg(F.ceil(F.count("*") / shard_entries).cast("int").alias("parts"))
    parts = staged(counts, "parts")  # one row a shard
    dealt = entries.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    dealt = dealt.select("shard", "part", "tab", "bucket", "vec_id", "vec")
    asked = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "vec")
    visits = asked.mapInPandas(
        functools.partial(_queries, hashing, shards),
        f"shard long, query_id long, vec {kind}, buckets array<long>",
    )

    def answered(visits: DataFrame, dealt: DataFrame) -> DataFrame:
        sent = visits.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return (
            sent.select("shard", F.col("part").cast("long").alias("part"), "query_id", "vec", "buckets")
            .groupBy("shard", "part")
            .cogroup(dealt.drop("tab").groupBy("shard", "part"))
            .applyInPandas(functools.partial(_nearest, k), FOUND)
        )

    found = staged(_best(answered(visits, dealt), k), "found")
    # Every table holds every vector: the first one's entries are all of them.
    done = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    short = asked.join(done, "query_id", "left_anti").withColumn("shard", everywhere)
    short = short.withColumn("buckets", F.lit(None).cast("array<long>"))
    rest = answered(short.select("shard", "query_id", "vec", "buckets"), dealt.filter("tab = 0"))
    whole = found.drop("rank").join(done, "query_id", "left_semi").unionByName(_best(rest, k).drop("rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return whole.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
