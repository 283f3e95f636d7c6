"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes; every value depends on the last 32 bytes
only.  A chunk ends where the hash is small enough: it must be very small before the
normal size and only fairly small after it, which draws sizes together, and a chunk has
a least and a most size.  Boundaries depend on nearby content alone, so an edit changes
only the chunks around it.

A fingerprint is the set of a text's chunks, each as a 32-bit digest and its length; its
string is base64 of those six bytes each, ascending.  The likeness of two fingerprints is
the length of the chunks they share over the length of the smaller one: how much of one
is contained in the other.

Defined results: a null or empty text has the empty fingerprint; two empty ones are
alike by 1, an empty and another by 0; null ids come first; rows of equal id follow each
other in the order of their texts' hashes; a single row is followed by itself; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import whole_text
from .vocab import text_groups

LEAST, NORMAL, MOST = 8, 32, 128
# A hash below the bar ends a chunk: one in 2 ** 7 before the normal size, one in 2 ** 3 after.
_STRICT, _LOOSE = 1 << 25, 1 << 29
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_FIRST_ID = -(1 << 63)


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks of some bytes; the last is their length."""
    size = len(raw)
    if not size:
        return []
    h = _GEAR[np.frombuffer(raw, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):  # each step doubles the window
        h[s:] += h[:-s] << np.uint32(s)
    loose = np.flatnonzero(h < _LOOSE)
    strict = (loose[h[loose] < _STRICT] + 1).tolist()
    loose = (loose + 1).tolist()
    out, at = [], 0
    while size - at > LEAST:
        end = min(at + MOST, size)
        i = bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] < at + NORMAL:
            end = min(end, strict[i])
        else:
            i = bisect_left(loose, at + NORMAL)
            if i < len(loose):
                end = min(end, loose[i])
        out.append(end)
        at = end
    if at < size:
        out.append(size)
    return out


def fingerprint(text: str) -> np.ndarray:
    """Sorted distinct chunks: digest in the upper, length in the lower 16 of 48 bits."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = boundaries(raw)
    digest, view = xxhash.xxh32_intdigest, memoryview(raw)
    return np.array(
        sorted({digest(view[a:b]) << 16 | (b - a) for a, b in zip([0, *ends], ends)}), dtype=np.uint64
    )


def spelled(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode("ascii")


def parsed(text: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(six, ((0, 0), (0, 2)))).view("<u8").ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the shared chunks over that of the smaller fingerprint."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.uint64(0xFFFF)
    shared = np.intersect1d(a, b, assume_unique=True)
    return float((shared & low).sum()) / float(min((a & low).sum(), (b & low).sum()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_groups(batches):
        found = pa.array([spelled(fingerprint(t)) for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """A text whose last quarter is replaced by as much of the beginning of the next."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and id; the row after a range's last is a copy of the next range's first."""
    columns = [f.split()[0] for f in COMPARED.split(", ")]
    pending = None
    for part, texts in text_groups(batches):
        rows = []
        ranges, copies = part.column(0).to_pylist(), part.column(1).to_pylist()
        for own, copy, doc, text in zip(ranges, copies, part.column(2).to_pylist(), texts):
            if copy and (pending is None or pending[0] != own):
                continue  # a further copy for a range that has ended
            found = fingerprint(text)
            if pending is not None and pending[0] == own:
                _, before, given, have = pending
                changed = edited(given, text)
                new = fingerprint(changed)
                rows.append(
                    (
                        before,
                        len(given),
                        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        spelled(have),
                        spelled(new),
                        likeness(have, new),
                        likeness(have, found),
                    )
                )
            pending = None if copy else (own, doc, text, found)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns_of = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_of, kinds)], names=columns)


def _ranges(bounds, heads, place: pd.Series) -> pd.Series:
    """The range of a row, and for the first of a range also the range before."""
    own = np.searchsorted(bounds.value, place.to_numpy(), side="right")
    return pd.Series([[int(r)] + ([heads.value[p]] if p in heads.value else []) for r, p in zip(own, place.tolist())])


def compare_with_next(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", range_bytes: int = 8_000_000
) -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next row by key.

    Rows go to ranges of ids of about ``range_bytes`` and are walked in order.  The
    first row of a range is also sent to the range before, so that no range waits for
    another.  The driver holds two ids for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        whole_text(text).alias("text"),
        F.coalesce(F.col(key).cast("long"), F.lit(_FIRST_ID)).alias("place"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // range_bytes))
    shares = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx("place", F.lit(shares), F.lit(max(10_000, 10 * n)))).first()[0] if shares else []
    bounds = spark.sparkContext.broadcast(np.array(sorted(set(cuts or [])), dtype=np.int64))

    @F.pandas_udf("int")
    def number(place: pd.Series) -> pd.Series:
        return _number(bounds, place)

    first = rows.groupBy(number("place").alias("own")).agg(F.min("place").alias("place")).collect()
    first = sorted((r.own, r.place) for r in first)
    heads = spark.sparkContext.broadcast({p: first[i - 1][0] for i, (_, p) in enumerate(first)})

    @F.pandas_udf("array<int>")
    def both(place: pd.Series) -> pd.Series:
        return _ranges(bounds, heads, place)

    placed = rows.select("doc_id", "text", "place", F.posexplode(both("place")).alias("copy", "own"))
    ordered = (
        placed.select("own", "copy", "doc_id", "text", "place")
        .repartition("own")
        .sortWithinPartitions("own", "copy", "place", F.xxhash64("text"))
        .drop("place")
    )
    return ordered.mapInArrow(_compare, COMPARED)


def _number(bounds, place: pd.Series) -> pd.Series:
    return pd.Series(np.searchsorted(bounds.value, place.to_numpy(), side="right").astype(np.int32))
