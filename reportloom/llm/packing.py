"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids with an end id; only longer ones are cut, into pieces of
the sequence length.  How many pieces there are of each length is all the program
needs: at most ``capacity`` numbers, whatever the corpus.

The configuration program asks for the fewest sequences, a variable for each way to
fill one.  Multiplicative weights solve it: every length has a price, and a knapsack
over the capacity finds, for every length, the configuration of the highest total price
that holds it.  Those near the best of all are taken until the scarcest of their lengths
is used up, and the prices of the lengths they used fall; then the rest is priced again,
so every length is priced until it is placed.  What no configuration takes whole any
more, few pieces in a hundred, is filled best-fit, longest piece first.  Prices also
bound the least number of sequences from below.  While the solution is more than ``GAP``
above that bound, lengths that lie in sequences with room left become dearer, and the
program is solved again, ``rounds`` times at most; the best solution is used.

The plan is a list of (configuration, how many), bounded by the number of pricing
steps.  Pieces get their place from their rank within their length, counted per
(length, chunk) and shifted by the counts of the chunks before, so no task sees all
pieces of a length.

Defined results: a null or empty text is its end id alone; null ids and repeated rows
are packed like other rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged
from .vocab import encoder, text_slices

#: Pieces a worker remembers; less than the encoder's default, since packing often
#: follows other stages in the same worker.
REMEMBERED = 350_000
#: A solution this near its lower bound is good enough.
GAP = 0.005
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(path: str, capacity: int, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, REMEMBERED).encode
    for part, texts in text_slices(batches):
        flat, begins = encode(texts)
        flat = np.insert(flat, begins[1:], np.uint32(end))  # after each document's last id
        begins = begins + np.arange(len(begins))
        counts = -(-np.diff(begins) // capacity)
        row = np.repeat(np.arange(len(counts)), counts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = begins[row] + piece * capacity
        last = np.minimum(first + capacity, begins[row + 1])
        raw = memoryview(flat.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(row)),
                pa.array(piece.astype(np.int32)),
                pa.array(piece * capacity),
                pa.array(last - first),
                pa.array(crc, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(functools.partial(_cut, tokenizer, capacity, end_id), PIECES)


def dearest(price: np.ndarray) -> list[int]:
    """The lengths of the configuration of the highest total price: a knapsack.

    ``price[l]`` is the price of length l, ``price[0]`` is not used; ``len(price) - 1``
    is the capacity.  Lengths may repeat.
    """
    _, used = _knapsack(price)
    return sorted(_filled(used, len(price) - 1), reverse=True)


def _knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest total price in every room, and a length that is in it (0: as in a place less)."""
    capacity = len(price) - 1
    best, used = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(price[1:] > 0) + 1
    costs, fitting = price[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        if n := fitting[room]:
            total = costs[:n] + best[room - lengths[:n]]
            # of equal totals the longest length, which leaves more to the others
            at = n - 1 - int(np.argmax(total[::-1]))
            best[room], used[room] = total[at], lengths[at]
        if best[room] < best[room - 1] or not used[room]:
            best[room], used[room] = best[room - 1], 0
    return best, used


def _filled(used: np.ndarray, room: int) -> list[int]:
    """The lengths that ``_knapsack`` puts into a room."""
    out = []
    while room > 0:
        if used[room]:
            out.append(int(used[room]))
            room -= out[-1]
        else:
            room -= 1
    return out


def solve(counts: np.ndarray, price: np.ndarray, steps: int, rate: float = 0.5, slack: float = 0.05):
    """Configurations and how many of each, the pieces they leave, and a lower bound of all sequences.

    At most ``steps`` pricings; a configuration is taken if its price is within ``slack``
    of the dearest.
    """
    capacity, left, out, bound = len(counts) - 1, counts.copy(), [], 0.0
    for step in range(steps):
        some = np.flatnonzero(left)
        if not len(some):
            break
        now = np.zeros(capacity + 1)
        now[some] = price[some] * np.exp(-rate * (1 - left[some] / counts[some]))
        best, used = _knapsack(now)
        if not step:  # no sequence is worth more than the dearest
            bound = float(counts @ now / best[capacity])
        near = some[now[some] + best[capacity - some] >= (1 - slack) * best[capacity]]
        before = left.sum()
        for length in near[::-1].tolist():
            if left[length]:
                config = tuple(sorted([length, *_filled(used, capacity - length)], reverse=True))
                lengths, times = np.unique(config, return_counts=True)
                many = int((left[lengths] // times).min())
                if many:
                    left[lengths] -= many * times
                    out.append((config, many))
        if left.sum() == before:
            break
    return out, left, bound


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence it fits; equal ones at once."""
    capacity = len(counts) - 1
    # open sequences by room left: configuration -> how many
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left, room = int(counts[length]), length
        while left and room <= capacity:
            while left and rooms[room]:
                config, many = rooms[room].popitem()
                use = min(many, left)
                if many > use:
                    rooms[room][config] = many - use
                new = config + (length,)
                rooms[room - length][new] = rooms[room - length].get(new, 0) + use
                left -= use
            room += 1
        if left:
            per = capacity // length
            for config, many in (((length,) * per, left // per), ((length,) * (left % per), int(left % per > 0))):
                if many:
                    room = capacity - length * len(config)
                    rooms[room][config] = rooms[room].get(config, 0) + many
    return [(config, many) for room in rooms for config, many in room.items()]


def plan(counts: np.ndarray, steps: int = 300, rounds: int = 12) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences of each; uses every piece exactly once."""
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    capacity = len(counts) - 1
    price = np.where(counts > 0, np.arange(capacity + 1) / capacity, 0.0)
    chosen, made, bound, rate, dear = [], np.inf, 0.0, 1.0, None
    for _ in range(rounds):
        configs, left, below = solve(counts, price, steps)
        configs = configs + best_fit(left)
        total = sum(many for _, many in configs)
        if total < made:
            chosen, made = configs, total
        if below > bound:
            bound, dear, room = below, price, np.zeros(capacity + 1)
            for config, many in configs:
                np.add.at(room, list(config), many * (1 - sum(config) / capacity))
        else:  # a step too far
            rate /= 2
        if made <= max((1 + GAP) * bound, np.ceil(bound - 1e-6)):
            break
        price = dear * np.exp(rate * room / np.maximum(counts, 1))
    return chosen


class Places:
    """Where the n-th piece of each length goes, by one sorted list of stretches."""

    def __init__(self, configs: list[tuple[tuple[int, ...], int]], capacity: int):
        by_length: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        sequence = 0
        for config, many in configs:
            at = 0
            lengths, times = np.unique(config, return_counts=True)
            for length, per in zip(lengths[::-1].tolist(), times[::-1].tolist()):
                by_length[length].append((many * per, sequence, per, at))
                at += length * per
            sequence += many
        flat = [s for group in by_length for s in group]
        table = np.array(flat, dtype=np.int64).reshape(-1, 4)
        self.begin = np.concatenate([[0], np.cumsum(table[:, 0])])[:-1]
        self.sequence, self.per, self.at = table[:, 1], table[:, 2], table[:, 3]
        sizes = [sum(s[0] for s in group) for group in by_length]
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.first[length] + rank
        s = np.searchsorted(self.begin, place, side="right") - 1
        nth = place - self.begin[s]
        return self.sequence[s] + nth // self.per[s], self.at[s] + nth % self.per[s] * length


def _place(places: Places, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sequence, offset = places.of(frame["length"].to_numpy(), frame.pop("rank").to_numpy())
        yield frame.assign(sequence_id=sequence, offset=offset)


def pack(cut: DataFrame, *, capacity: int = 2048, chunk_rows: int = 50_000, steps: int = 300) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    places = Places(plan(counts, steps), capacity)
    chunks = max(1, -(-int(counts.sum()) // chunk_rows))
    rows = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("length", "chunk")
        .agg(F.count("*").alias("n"))
        .select("length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        rows.withColumn("nth", F.row_number().over(within))
        .join(before, ["length", "chunk"])
        .select(*cut.columns, (F.col("before") + F.col("nth") - 1).alias("rank"))
    )
    return ranked.mapInPandas(functools.partial(_place, places), PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, steps: int = 300, **options) -> DataFrame:
    """Pieces of all rows with their sequence and the place in it."""
    cut = staged(pieces(docs, tokenizer, capacity=capacity, **options), "pieces")
    return pack(cut, capacity=capacity, steps=steps)
