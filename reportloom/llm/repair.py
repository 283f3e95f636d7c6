"""Token-id output compressed by a Re-Pair grammar per shard.

The ids of a shard's documents form one sequence.  Its most frequent adjacent pairs are
replaced by new symbols, again and again, until no pair occurs ``least`` times (six); a pair never
crosses the end of a document.  A round replaces many pairs at once: an occurrence is
taken when its pair is more frequent than the pairs it overlaps, so the occurrences
taken in a round never overlap.  There is no cap on rounds, rules or their nesting.

File format: Parquet, one row per shard, written through Spark's committer to a shared
folder.  Columns: ``part, shard`` (their order is the order of the shards), ``n_ids``,
``doc_ids``, ``starts`` (ids before each document, and the total), ``places`` (symbols
before each document, and the total), ``rules`` (two unsigned 32-bit symbols each;
rule r is symbol ``base + r``), ``sizes`` (ids each rule expands to), ``symbols``
(unsigned 32-bit).  ``places`` and ``sizes`` let a reader decode one document, or some
ids of it, without the others.

Defined results: a null or empty text is its end id alone; null ids come first; rows of
equal id follow each other in the order of their texts; other columns are ignored; an
empty table writes no shards.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import giving_back, keep_freed
from .vocab import encoder, text_slices

FILE = (
    "part int, shard int, n_ids long, base long, doc_ids array<long>, starts binary, "
    "places binary, rules binary, sizes binary, symbols binary"
)
READ = "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


# Rank of a place whose pair is not to be replaced.
_NEVER = np.int32(np.iinfo(np.int32).max)


def _seconds(follow: np.ndarray, at: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Every second one of the places, numbered ``equal`` in ``at``, of each run of one symbol."""
    goes_on = np.zeros(len(equal), dtype=bool)
    goes_on[1:] = (np.diff(equal) == 1) & (follow[equal[:-1]] == at[equal[1:]])
    nth = np.arange(len(equal))
    nth -= np.maximum.accumulate(np.where(goes_on, 0, nth))
    return equal[nth % 2 == 1]


def _frequent(symbols: np.ndarray, after: np.ndarray | None, at: np.ndarray, least: int, rank_at: np.ndarray, sieve: bool):
    """Places that may have a pair that occurs ``least`` times without overlap, and these pairs by rank.

    ``at`` holds every place that may count, ascending; ``rank_at``, by place + 1, takes
    the ranks.  In a run of one symbol every second place counts; the numbers of the
    others are returned as well.  ``sieve`` first counts buckets of pairs: where fewer
    than ``least`` places fall into one, all its pairs are rare.
    """
    follow = at + 1 if after is None else after[at]
    left, right = symbols[at], symbols[follow]
    if sieve:
        bucket = left * np.uint32(0x9E3779B1)
        bucket += right
        bucket *= np.uint32(0x85EBCA6B)
        bucket >>= np.uint32(32 - max(len(at).bit_length() - 1, 1))
        maybe = np.flatnonzero((np.bincount(bucket) >= least)[bucket])
        at, follow, left, right = at[maybe], follow[maybe], left[maybe], right[maybe]
    if not len(at):
        return None
    none = int(max(left.max(), right.max())) + 1  # a symbol above all; its pairs sort last
    equal = np.flatnonzero(left == right)
    other = _seconds(follow, at, equal) if len(equal) else equal  # places of a run follow each other
    left[other] = right[other] = none
    # The pair's symbols and its place in one number, where they fit: sorted without an index.
    wide, far = none.bit_length(), len(rank_at).bit_length()
    fits = 2 * wide + far <= 64
    wide = wide if fits else 32
    code = left.astype(np.uint64)
    code <<= np.uint64(wide)
    code |= right
    if fits:
        code <<= np.uint64(far)
        code |= at.view(np.uint64)
        code.sort()
        by = (code & np.uint64((1 << far) - 1)).view(np.int64)
        code >>= np.uint64(far)
    else:
        order = np.argsort(code, kind="stable")
        code, by = code[order], at[order]
    edge = np.ones(len(code) + 1, dtype=bool)
    np.not_equal(code[1:], code[:-1], out=edge[1:-1])
    first = np.flatnonzero(edge)
    times, first = np.diff(first), first[:-1]
    often = times >= least
    if len(other):
        often[-1] = False
    order = np.flatnonzero(often)
    if not len(order):
        return None
    order = order[np.argsort(-times[order], kind="stable")]
    rank_of = np.full(len(first), _NEVER)
    rank_of[order] = np.arange(len(order), dtype=np.int32)
    rank_at[by + 1] = np.repeat(rank_of, times)
    pairs = code[first[order]]
    return at, follow, other, (pairs >> np.uint64(wide)) << np.uint64(32) | pairs & np.uint64((1 << wide) - 1)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, *, least: int = 6):
    """Symbols, the last-of-document marks that go with them, rules and their sizes.

    ``ends`` marks the last id of each document; ``base`` is above every id.  Ends when
    no pair occurs ``least`` times without overlap; with six, a rule (16 bytes with its
    size) is smaller than what it saves.

    A place of a rare pair is left alone until one of its symbols is replaced, so a round
    costs as much as there are places left.  While these are many, the sequence is written
    anew after each round and neighbours lie side by side; then it is a linked list over
    its places (``after``, ``before``, ``live``).  A pair can become frequent again where a
    rule is used in several rounds: when no place is left, all are looked at once more,
    until that finds none.
    """
    symbols, marks = ids.astype(np.uint32), ends.copy()
    marks[-1:] = True  # no pair goes on behind a document's end, nor behind the last id
    after = before = live = None
    rank_at = np.full(len(symbols) + 2, _NEVER)  # by place + 1
    halves: list[np.ndarray] = []
    sizes = [np.zeros(0, dtype=np.int64)]
    known, known_as = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)  # rules that may come again
    made = 0
    at, every = np.flatnonzero(~marks), True
    while True:
        found = _frequent(symbols, after, at, least, rank_at, made > 0) if len(at) else None
        if found is None:
            if every:
                break
            if after is not None:
                symbols, marks, after = symbols[live], marks[live], None
                rank_at = rank_at[: len(symbols) + 2]
            at, every = np.flatnonzero(~marks), True
            continue
        every = False
        at, follow, other, pairs = found
        n = len(symbols)
        if after is None and 4 * len(at) < n:
            after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
            live = np.ones(n, dtype=bool)
        rank = rank_at[at + 1]
        stays = rank < _NEVER
        stays[other] = stays[other - 1]  # the others of a run live as long as those that count
        # More frequent than the pairs it overlaps.
        if after is None:
            free = (rank_at[1:-1] < rank_at[:-2]) & (rank_at[1:-1] < rank_at[2:])
            taken = np.flatnonzero(free)
            which = rank_at[taken + 1]
            rank_at.fill(_NEVER)
        else:
            free = (rank < rank_at[before[at] + 1]) & (rank < rank_at[follow + 1])
            taken, which = at[free], rank[free]
            rank_at[at + 1] = _NEVER
        # A pair that its neighbours leave too few places waits; the most frequent never does.
        spot = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
        is_known = known[spot] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
        ready = is_known | (np.bincount(which, minlength=len(pairs)) >= least)
        go = ready[which]
        taken, which = taken[go], which[go]
        fresh = np.flatnonzero(ready & ~is_known)
        symbol = np.zeros(len(pairs), dtype=np.uint32)
        symbol[is_known] = known_as[spot[is_known]]
        symbol[fresh] = np.arange(base + made, base + made + len(fresh), dtype=np.uint32)
        made += len(fresh)
        new = np.stack([pairs[fresh] >> np.uint64(32), pairs[fresh] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        so_far = np.concatenate(sizes)
        halves.append(new)
        sizes = [so_far, sum(_size(new[:, k], base, so_far) for k in (0, 1))]
        known, known_as = np.concatenate([known, pairs[fresh]]), np.concatenate([known_as, symbol[fresh]])
        by = np.argsort(known)
        known, known_as = known[by], known_as[by]
        symbols[taken] = symbol[which]
        gone = taken + 1 if after is None else after[taken].astype(np.int64)
        marks[taken] = marks[gone]
        if after is None:
            watch, kept = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
            watch[at] = stays
            watch[taken] = True
            watch[taken[taken > 0] - 1] = True
            kept[gone] = False
            kept = np.flatnonzero(kept)
            symbols, marks = symbols[kept], marks[kept]
            at = np.flatnonzero(watch[kept] & ~marks)
            rank_at = rank_at[: len(symbols) + 2]
        else:
            live[gone] = False
            follow = after[gone]
            after[taken] = follow
            inside = follow < n
            before[follow[inside]] = taken[inside]
            ahead = before[taken]
            at = np.concatenate([at[stays], taken, ahead[ahead >= 0]])
            at = np.sort(at[live[at] & ~marks[at]])
            at = at[np.diff(at, prepend=-1) > 0]
    if after is not None:
        symbols, marks = symbols[live], marks[live]
    marks[-1:] = ends[-1:]
    rules = np.concatenate(halves) if halves else np.zeros((0, 2), dtype=np.uint32)
    return symbols, marks, rules, np.concatenate(sizes)


def _size(symbols: np.ndarray, base: int, sizes: np.ndarray) -> np.ndarray:
    """Ids that each symbol expands to."""
    out = np.ones(len(symbols), dtype=np.int64)
    made = symbols >= base
    out[made] = sizes[symbols[made] - base]
    return out


def _unfold(symbols: np.ndarray, rules: np.ndarray, base: int, sizes: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for; a round splits what is still folded."""
    long = _size(symbols, base, sizes)
    at = np.cumsum(long) - long
    out = np.zeros(int(long.sum()), dtype=np.uint32)
    while len(symbols):
        folded = symbols >= base
        out[at[~folded]] = symbols[~folded]
        at = at[folded]
        left, right = rules[symbols[folded].astype(np.int64) - base].T
        symbols = np.concatenate([left, right])
        at = np.concatenate([at, at + _size(left, base, sizes)])
    return out


def _sizes(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to."""
    sizes, todo = np.zeros(len(rules), dtype=np.int64), np.arange(len(rules))
    while len(todo):
        halves = [_size(rules[todo, k], base, sizes) for k in (0, 1)]
        done = (halves[0] > 0) & (halves[1] > 0)
        sizes[todo[done]] = (halves[0] + halves[1])[done]
        todo = todo[~done]
    return sizes


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; many of them by unfolding each rule once."""
    sizes = _sizes(rules, base) if sizes is None else sizes
    pooled = int(sizes.sum()) + base
    if len(symbols) < len(rules) or pooled > _size(symbols, base, sizes).sum() + (1 << 16):
        return _unfold(symbols, rules, base, sizes)
    every = np.arange(base, base + len(rules), dtype=np.uint32)
    pool = np.concatenate([np.arange(base, dtype=np.uint32), _unfold(every, rules, base, sizes)])
    long = np.concatenate([np.ones(base, dtype=np.int32), sizes.astype(np.int32)])
    begin = np.cumsum(long, dtype=np.int64) - long
    times = long[symbols]
    reach = np.cumsum(times, dtype=np.int64)
    total = int(reach[-1]) if len(reach) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    shift = (begin[symbols] - (reach - times)).astype(kind)
    return pool[np.repeat(shift, times) + np.arange(total, dtype=kind)]


def _array(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind)


def read_ids(shard, doc: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``begin`` to ``end`` of the shard's document number ``doc``, decoding no others.

    Sizes of the document's symbols tell which of them cover the ids asked for.
    """
    places, base = _array(shard["places"], "<i8"), int(shard["base"])
    symbols = _array(shard["symbols"], "<u4")[places[doc] : places[doc + 1]]
    rules = _array(shard["rules"], "<u4").reshape(-1, 2)
    reach = np.cumsum(_size(symbols, base, _array(shard["sizes"], "<i8")))
    total = int(reach[-1]) if len(reach) else 0
    end = total if end is None else min(end, total)
    if begin >= end:
        return np.zeros(0, dtype=np.uint32)
    a = int(np.searchsorted(reach, begin, side="right"))
    b = int(np.searchsorted(reach, end, side="left")) + 1
    skipped = int(reach[a - 1]) if a else 0
    return expand(symbols[a:b], rules, base, _array(shard["sizes"], "<i8"))[begin - skipped : end - skipped]


def _shard(part: int, shard: int, docs: list, lengths: list[np.ndarray], ids: list[np.ndarray], base: int, options: dict) -> dict:
    flat = np.concatenate(ids)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    ends = np.zeros(len(flat), dtype=bool)
    ends[starts[1:] - 1] = True
    symbols, marks, rules, sizes = compress(flat, ends, base, **options)
    places = np.concatenate([[0], np.flatnonzero(marks) + 1])
    return {
        "part": part,
        "shard": shard,
        "n_ids": len(flat),
        "base": base,
        "doc_ids": docs,
        "starts": starts.astype("<i8").tobytes(),
        "places": places.astype("<i8").tobytes(),
        "rules": rules.astype("<u4").tobytes(),
        "sizes": sizes.astype("<i8").tobytes(),
        "symbols": symbols.astype("<u4").tobytes(),
    }


_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("base", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("starts", "places", "rules", "sizes", "symbols")]
)


def _write(path: str, end: int, shard_ids: int, options: dict, batches: Iterator[pa.RecordBatch]):
    keep_freed()
    code = encoder(path)
    base, part, shard, docs, lengths, ids, held = code.size, 0, 0, [], [], [], 0
    for rows, texts in text_slices(batches, chars=4 * shard_ids):
        part = rows.column(2)[0].as_py()
        flat, begins = code.encode(texts)
        ids.append(np.insert(flat, begins[1:], np.uint32(end)))  # after each document's last id
        lengths.append(np.diff(begins) + 1)
        docs += rows.column(0).to_pylist()
        held += len(ids[-1])
        if held >= shard_ids:
            yield pa.RecordBatch.from_pylist([_shard(part, shard, docs, lengths, ids, base, options)], schema=_ARROW)
            shard, docs, lengths, ids, held = shard + 1, [], [], [], 0
    if docs:
        yield pa.RecordBatch.from_pylist([_shard(part, shard, docs, lengths, ids, base, options)], schema=_ARROW)


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    partitions: int | None = None,
    shard_ids: int = 1_000_000,
    **options,
) -> None:
    """Write the ids of all rows to ``path``, ascending by key, in the format above."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    by = ["doc_id"] if partitions is None else [partitions, "doc_id"]
    ordered = (
        rows.repartitionByRange(*by)
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .withColumn("part", F.spark_partition_id())
    )
    write = functools.partial(_write, tokenizer, end_id, shard_ids, options)
    ordered.mapInArrow(giving_back(write), FILE).write.parquet(path)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for shard in frame.to_dict("records"):
            starts, places = _array(shard["starts"], "<i8"), _array(shard["places"], "<i8")
            rules, base = _array(shard["rules"], "<u4").reshape(-1, 2), int(shard["base"])
            symbols = _array(shard["symbols"], "<u4")
            rule_sizes = _array(shard["sizes"], "<i8")
            ids = expand(symbols, rules, base, rule_sizes).astype("<u4", copy=False)
            reach = np.concatenate([[0], np.cumsum(_size(symbols, base, rule_sizes))])[places]
            if not np.array_equal(reach, starts):
                raise ValueError("a shard's sizes do not fit its documents")
            raw = ids.tobytes()
            yield pd.DataFrame(
                {
                    "part": np.int32(shard["part"]),
                    "shard": np.int32(shard["shard"]),
                    "doc_id": pd.array(list(shard["doc_ids"]), dtype="Int64"),
                    "start": starts[:-1],
                    "n_tokens": np.diff(starts),
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])],
                }
            )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    shards = spark.read.schema(FILE).parquet(path)
    earlier = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # One small row per shard of a million ids.
    before = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    columns = ["part", "shard", "base", "doc_ids", "starts", "places", "rules", "sizes", "symbols"]
    rows = shards.select(columns).mapInPandas(_read, READ)
    return rows.join(before, ["part", "shard"]).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
