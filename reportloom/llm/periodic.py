"""Periodic runs of words, found by string synchronising sets.

A run is a maximal stretch of words with smallest period q that is at least 2q long.
Everything a task does covers a slice of texts laid out as one array of word numbers, a
number of its own after each text, so that nothing matches across a border.

1. *Small periods.*  Below 24 words equality with the word q places on is looked at
   directly.  This also finds the highly periodic regions that the sets leave out.
2. *Dyadic scales.*  At scale t = 4, 8, 16, ... a synchronising set is chosen: a place
   belongs to it if, among the t + 1 blocks of t words that begin from it on, the block
   with the least hash begins at it or at the last one; blocks of period t/3 or less do not
   count.  Equal contexts of 2t words make equal choices.  A run of period q from 6t to 12t has
   two such places q apart in its first 2q words, unless a root of it lies in a
   highly periodic region.  So places with equal contexts and that distance propose q;
   places whose contexts repeat lie more than t/3 apart, which bounds the proposals of a
   place by 36.
3. *Highly periodic regions* of period p up to t/3 supply the rest: two regions whose ends
   are q apart, and two of one root that touch, which give every q of the fitting
   residue by p.
4. Every proposal is compared word by word in both directions, so the hashes decide
   only what is looked at; a place inside a stretch found for the same q is not looked at
   again.  Of the periods of one stretch the smallest counts.

Slices hold about ``chars`` bytes, a longer text is one of its own; memory follows the
slice.  Defined results: words are split at ASCII blanks and compared as they stand; a
null or blank text has no words and no run; every row is treated for itself, also of
null or repeated id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import whole_text
from .vocab import text_slices

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Periods below this are looked for directly, so the first scale is a sixth of it.
_SMALL = 24


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _extended(w: np.ndarray, low: int, high: int, q: int) -> tuple[int, int]:
    """The places around ``low`` to ``high`` that equal those q further on, ends exclusive."""
    step, end = 64, len(w) - q
    while high < end:
        stop = min(end, high + step)
        differ = w[high:stop] != w[high + q : stop + q]
        at = int(differ.argmax())
        if differ[at]:
            high += at
            break
        high, step = stop, 4 * step
    step = 64
    while low > 0:
        stop = max(0, low - step)
        differ = (w[stop:low] != w[stop + q : low + q])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            low -= at
            break
        low, step = stop, 4 * step
    return low, high


def _direct(w: np.ndarray, q: int) -> np.ndarray:
    """Starts and ends of the stretches of period q that are at least 2q long."""
    if len(w) <= q:
        return np.zeros((0, 2), dtype=np.int64)
    edges = np.flatnonzero(np.diff((w[:-q] == w[q:]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    edges = edges.reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= q]
    edges[:, 1] += q
    return edges


def _synchronising(blocks: np.ndarray, masked: np.ndarray, t: int) -> np.ndarray:
    """Places of the set of scale t, given hashes of the blocks of t words and which do not count."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    n = len(blocks) - t  # places with t + 1 blocks
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    counted = np.where(masked, none, blocks >> np.uint64(1))
    least, width = counted, 1
    while width < t:  # least of 2 * width blocks
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], counted[t:])
    return np.flatnonzero((least != none) & ((least == counted[:n]) | (least == counted[t:])))


class _Found:
    """Stretches by period, and by extent with the smallest period."""

    def __init__(self, w: np.ndarray):
        self._w = w
        self._done: dict[int, list[tuple[int, int]]] = {}
        self.smallest: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, q: int) -> None:
        known = self.smallest.get((start, end))
        if known is None or q < known:
            self.smallest[start, end] = q

    def propose(self, q: int, low: int, high: int) -> int:
        """Look at q around places known to match; the end of the places that do."""
        low, high = _extended(self._w, low, high, q)
        if high - low >= q:
            self.add(low, high + q, q)
        return high

    def propose_places(self, q: int, places: np.ndarray) -> None:
        """Look at q around each of some sorted places, once per stretch."""
        at = 0
        while at < len(places):
            place = int(places[at])
            high = self.propose(q, place, place)
            at += max(1, int(np.searchsorted(places[at:], high)))

    def regions(self, period: int, length: int) -> np.ndarray:
        """Start, end and period of stretches of at most this period and at least this length."""
        rows = [(s, e, p) for (s, e), p in self.smallest.items() if p <= period and e - s >= length]
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)


def _touching(w: np.ndarray, left: np.ndarray, right: np.ndarray) -> int | None:
    """Least q >= 1 by which the left region's phase becomes the right one's; None for other roots."""
    p, end = int(left[2]), int(left[1])
    root = w[end - p : end]
    for y in right[0] + np.flatnonzero(w[right[0] : right[0] + p] == root[0]):
        if np.array_equal(w[y : y + p], root):
            return int((y - (end - p) - 1) % p + 1)
    return None


def _periodic(found: _Found, w: np.ndarray, t: int) -> None:
    """Periods from 6t to 12t whose root lies in highly periodic regions."""
    regions = found.regions(t // 3, 6 * t - 1)
    if len(regions) < 2:
        return
    by_end = regions[np.argsort(regions[:, 1], kind="stable")]
    for lag in (1, 2, 3):
        q = by_end[lag:, 1] - by_end[:-lag, 1]
        for i in np.flatnonzero((q >= 6 * t) & (q < 12 * t) & (by_end[lag:, 2] == by_end[:-lag, 2])):
            end = int(by_end[i, 1])
            found.propose(int(q[i]), end, end)
    for left, right in zip(regions[:-1], regions[1:]):
        p = int(left[2])
        if right[2] != p or not left[1] - p < right[0] <= left[1]:
            continue
        residue = _touching(w, left, right)
        if residue is None:
            continue
        first = residue + -(-(6 * t - residue) // p) * p
        for q in range(first, min(12 * t, int(right[1] - left[0]) // 2 + p + 1), p):
            low, high = max(int(left[0]), int(right[0]) - q), min(int(left[1]), int(right[1]) - q)
            if low < high:
                found.propose(q, low, high)


def _proposals(places: np.ndarray, contexts: np.ndarray, t: int) -> Iterator[tuple[int, np.ndarray]]:
    """Distances from 6t to 12t of places with equal contexts, with the places."""
    order = np.lexsort((places, contexts))
    places, contexts = places[order], contexts[order]
    distance, first = [], []
    for lag in range(1, len(places)):
        gap = places[lag:] - places[:-lag]
        close = (contexts[lag:] == contexts[:-lag]) & (gap < 12 * t)
        if not close.any():
            break
        far = close & (gap >= 6 * t)
        distance.append(gap[far])
        first.append(places[:-lag][far])
    if distance:
        distance, first = np.concatenate(distance), np.concatenate(first)
        order = np.lexsort((first, distance))
        distance, first = distance[order], first[order]
        cuts = np.flatnonzero(np.diff(distance)) + 1
        for own, q in zip(np.split(first, cuts), distance[np.concatenate([[0], cuts])] if len(distance) else ()):
            yield int(q), own


def _covered(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the stretches given by start and end."""
    marks = np.zeros(n + 1, dtype=np.int32)
    np.add.at(marks, rows[:, 0], 1)
    np.add.at(marks, rows[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


def _array_runs(w: np.ndarray, longest: int) -> np.ndarray:
    """Start, end and smallest period of all stretches of ``w`` at least twice their period long."""
    found = _Found(w)
    for q in range(1, min(_SMALL - 1, longest // 2) + 1):
        for s, e in _direct(w, q).tolist():
            found.add(s, e, q)
    t, blocks, width = _SMALL // 6, _mixed(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while 12 * t <= longest:
        while width < t:
            blocks = _mixed(blocks[:-width] * np.uint64(3) + blocks[width:])
            width *= 2
        regions = found.regions(t // 3, t)
        starts = np.stack([regions[:, 0], regions[:, 1] - t + 1], axis=1)  # of the blocks inside a region
        places = _synchronising(blocks, _covered(len(blocks), starts), t)
        contexts = _mixed(blocks[places] * np.uint64(3) + blocks[places + t]) if len(places) else blocks[:0]
        for q, own in _proposals(places, contexts, t):
            found.propose_places(q, own)
        _periodic(found, w, t)
        t *= 2
    return np.array(sorted((s, e, q) for (s, e), q in found.smallest.items()), dtype=np.int64).reshape(-1, 3)


def runs_of(numbers: list[np.ndarray], least: int) -> list[np.ndarray]:
    """Start, length and smallest period of the runs of each sequence, by start, then period.

    Long sequences and short ones are laid out apart, so a scale passes only over
    those that can hold its periods.
    """
    out = [np.zeros((0, 3), dtype=np.int64)] * len(numbers)
    sizes = np.array([len(x) for x in numbers], dtype=np.int64)
    levels = np.frexp(sizes)[1]
    for level in np.unique(levels[sizes > 1]):
        own = np.flatnonzero(levels == level)
        ends = np.cumsum(sizes[own] + 1)
        flat = np.empty(int(ends[-1]), dtype=np.int64)
        for k, i in enumerate(own):
            flat[ends[k] - 1 - sizes[i] : ends[k] - 1] = numbers[i]
            flat[ends[k] - 1] = -1 - k  # a border equals nothing
        rows = _array_runs(flat, int(sizes[own].max()))
        rows = rows[rows[:, 1] - rows[:, 0] >= least]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        of = np.searchsorted(ends, rows[:, 0], side="right")
        cuts = np.searchsorted(of, np.arange(len(own) + 1))
        for k, i in enumerate(own):
            mine = rows[cuts[k] : cuts[k + 1]]
            out[i] = np.stack([mine[:, 0] - (ends[k] - 1 - sizes[i]), mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
    return out


def _rows(least: int, chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for part, texts in text_slices(batches, chars=chars):
        place: dict[bytes, int] = {}
        found = [t.split() for t in texts.cast(pa.binary()).to_pylist()]
        numbers = [np.array([place.setdefault(w, len(place)) for w in own], dtype=np.int64) for own in found]
        runs, collapsed = runs_of(numbers, least), []
        for own, rows in zip(found, runs):
            if len(rows):
                tails = np.stack([rows[:, 0] + rows[:, 2], rows[:, 0] + rows[:, 1]], axis=1)
                own = [own[i] for i in np.flatnonzero(~_covered(len(own), tails))]
            collapsed.append(b" ".join(own))
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        flat = np.concatenate(runs)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(part.schema.get_field_index("doc_id")),
                pa.array([len(own) for own in found], pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind))
                ),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def runs(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 12, chars: int = 4_000_000
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``runs`` are the runs of at least ``least`` words as (start, length, period), by
    start, then period; ``collapsed`` is the text without the words that follow the first
    period of some run, joined by single blanks.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(functools.partial(_rows, least, chars), RUNS)
