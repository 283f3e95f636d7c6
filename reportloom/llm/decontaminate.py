"""Benchmark decontamination: word windows of test items found in training texts.

A window is ``window`` consecutive words of an item; an item of fewer words, but not
none, is one window.  The windows of the items become a hash set that every task gets by
broadcast.  A task looks up the windows of its texts, verifies each hit word by word, and
marks the words inside it.  Documents never meet and nothing is shuffled.

The set is broadcast only up to ``broadcast_bytes`` of item text, which is measured
first.  A larger benchmark is dealt to as many slices as it needs, and the corpus, written
between, passes them one after the other: memory stays the same, hits add up.  Long items
are cut to pieces that overlap by ``window - 1`` words, which have the same windows.

Defined results: words are maximal runs of letters, digits and characters beyond ASCII
after lower-casing A-Z; a null or wordless text has no words and no hits, such an item no
window; rows of equal item id are one item; the windows of an item of null id count as
hits but name no item; every document row is judged for itself, repeated ones alike; an
empty table gives no rows, an empty benchmark no hits; other columns stay as they are.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import staged, whole_text
from .vocab import text_slices

#: Words of a text in lower case, and of one that is not.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPAN = "array<struct<start:int,end:int>>"
#: ``words`` are hit stretches by word number, ``spans`` the same by code point, ends exclusive.
FOUND = f"struct<n_words:long,n_hit:long,words:{_SPAN},spans:{_SPAN},items:array<string>>"
_PIECE = 4096
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_LOWER).split()


def _hashes(ids: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of the ``length`` ids from each start."""
    out = np.full(len(starts), seed, dtype=np.uint64)
    for j in range(length):
        out ^= out >> np.uint64(31)
        out = (out + ids[starts + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


class _Windows:
    """Distinct windows of one length: sorted hashes, a place of each, the items that hold it."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int):
        self.length, self.seed = length, 0
        while True:
            hashes = _hashes(ids, starts, length, self.seed)
            order = np.argsort(hashes, kind="stable")
            new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
            first = starts[order][new]
            run = np.cumsum(new) - 1
            same = all(np.array_equal(ids[starts[order] + j], ids[first[run] + j]) for j in range(length))
            if same:  # else two windows share a hash: take another
                break
            self.seed += 1
        self.hashes, self.first = hashes[order][new], first
        pairs = np.unique(np.stack([run, items[order]]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        self.items = pairs[1]
        self.ends = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        self.shift = np.uint64(64 - max(10, int(len(first)).bit_length() + 4))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def find(self, flat: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in ``flat`` of windows, and their numbers.  ``known``: words of items so far."""
        at = np.flatnonzero(known[self.length :] - known[: -self.length] == self.length)
        hashes = _hashes(flat, at, self.length, self.seed)
        keep = self.maybe[(hashes >> self.shift).astype(np.int64)]
        at, hashes = at[keep], hashes[keep]
        number = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        keep = self.hashes[number] == hashes
        at, number = at[keep], number[keep]
        for j in range(self.length):
            keep = flat[at + j] == ids[self.first[number] + j]
            at, number = at[keep], number[keep]
        return at, number


class Benchmark:
    """Windows of a bounded number of items, by length."""

    def __init__(self, pieces: Iterable[tuple[str | None, str]], window: int):
        names: dict[str, int] = {}
        self.vocabulary: dict[bytes, int] = {}
        flat, sizes, owner = [], [], []
        for item, text in pieces:
            own = words(text.encode())
            flat.extend(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own)
            sizes.append(len(own))
            owner.append(-1 if item is None else names.setdefault(item, len(names)))
        self.names = list(names)
        self.ids = np.array(flat, dtype=np.int32)
        sizes, owner = np.array(sizes, dtype=np.int64), np.array(owner, dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        self.windows = []
        for length in np.unique(np.minimum(sizes[sizes > 0], window)):
            own = np.flatnonzero(np.minimum(sizes, window) == length)
            count = sizes[own] - length + 1
            of = np.repeat(own, count)
            starts = begins[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            self.windows.append(_Windows(self.ids, starts, owner[of], int(length)))

    def match(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Words of every text; hit marks of all words, texts divided by one more; items of every text."""
        found = [words(t) for t in texts]
        sizes = np.array([len(w) for w in found], dtype=np.int64)
        get, ends = self.vocabulary.get, np.cumsum(sizes + 1)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)  # 0: no word of an item, or a border
        for own, end in zip(found, ends):
            flat[end - 1 - len(own) : end - 1] = np.fromiter(map(get, own, itertools.repeat(0)), np.int32, len(own))
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        marks = np.zeros(len(flat) + 1, dtype=np.int64)
        named = []
        for w in self.windows:
            if w.length >= len(known):
                continue
            at, number = w.find(flat, self.ids, known)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + w.length, -1)
            pairs = np.unique(np.stack([np.searchsorted(ends, at, side="right"), number]), axis=1)
            size = w.ends[pairs[1] + 1] - w.ends[pairs[1]]
            place = np.repeat(w.ends[pairs[1]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            named.append(np.unique(np.stack([np.repeat(pairs[0], size), w.items[place]]), axis=1))
        items: list[list[str]] = [[] for _ in texts]
        if named:
            for doc, item in np.unique(np.concatenate(named, axis=1), axis=1).T:
                items[doc].append(self.names[item])
        return sizes, np.cumsum(marks[:-1]) > 0, items


def _stretches(marks: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true marks, as rows."""
    return np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def _by_characters(text: str, stretches: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words as code points of the text."""
    found = [m.span() for m in _ANY_CASE.finditer(text)]
    return [(found[a][0], found[b - 1][1]) for a, b in stretches]


def _scan(
    sent: Broadcast, text: str, name: str, keep: list[str], chars: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Rows with what the items of one slice, and of those before it, hit in them."""
    items = sent.value
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("words", pair), ("spans", pair), ("items", pa.list_(pa.string()))]
    )
    for part, texts in text_slices(batches, text, chars):
        raw = texts.cast(pa.binary()).to_pylist()
        sizes, marks, named = items.match(raw)
        before = part.column(name).to_pylist() if name in part.schema.names else [None] * len(raw)
        out, at = [], 0
        for i, n in enumerate(sizes.tolist()):
            own = marks[at : at + n]
            at += n + 1
            for s in before[i]["words"] if before[i] else ():
                own[s["start"] : s["end"]] = True
            stretches = _stretches(own)
            pieces = _by_characters(raw[i].decode("utf-8", "replace"), stretches) if len(stretches) else []
            out.append(
                {
                    "n_words": n,
                    "n_hit": int((stretches[:, 1] - stretches[:, 0]).sum()),
                    "words": [{"start": int(a), "end": int(b)} for a, b in stretches],
                    "spans": [{"start": a, "end": b} for a, b in pieces],
                    "items": sorted({*named[i], *(before[i]["items"] if before[i] else ())}),
                }
            )
        columns = [part.column(c) for c in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[*keep, name])


def _free(names: list[str], wanted: str = "leak") -> str:
    """A column name that no case-insensitive match takes."""
    taken = {n.lower() for n in names}
    return next(n for n in itertools.chain([wanted], (f"{wanted}_{i}" for i in itertools.count())) if n not in taken)


def _marked(
    docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, broadcast_bytes: int, chars: int, keep: list[str]
) -> tuple[DataFrame, str]:
    """``docs`` with the columns to keep and one of :data:`FOUND`; its name."""
    spark, name = docs.sparkSession, _free(docs.columns)
    found = F.regexp_extract_all(F.translate(whole_text(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    pieces = (
        benchmark.select(F.col(item).cast("string").alias("item"), found.alias("words"))
        .filter(F.size("words") > 0)
        .select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(_PIECE))).alias("at"))
        .select("item", F.array_join(F.slice("words", F.col("at") + 1, _PIECE + window - 1), " ").alias("text"))
    )
    total = benchmark.agg(F.sum(F.octet_length(item_text) + 16)).first()[0] or 0
    slices = max(1, -(-int(total) // broadcast_bytes))
    if slices > 1:
        pieces = staged(pieces, "items")
    for k in range(slices):
        # At most ``broadcast_bytes`` come to the driver, but for the hash's unevenness.
        own = pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k) if slices > 1 else pieces
        sent = spark.sparkContext.broadcast(Benchmark(((r.item, r.text) for r in own.toLocalIterator()), window))
        last = k == slices - 1
        kept = keep if last else [c for c in docs.columns if c != name]
        fields = [docs.schema[c] for c in kept]
        schema = T.StructType([*fields, T.StructField(name, T.DataType.fromDDL(FOUND))])
        docs = docs.mapInArrow(functools.partial(_scan, sent, text, name, kept, chars), schema)
        if not last:
            docs = staged(docs, "marked")
    return docs, name


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    broadcast_bytes: int = 32_000_000,
    chars: int = 4_000_000,
) -> DataFrame:
    """``doc_id, n_words, n_hit, words, spans, items`` of every row.

    ``words`` and ``spans`` are the hit stretches by word number and by code point, ends
    exclusive; ``items`` the sorted ids, as text, of the items with a window in the text.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found, name = _marked(rows, benchmark, "text", item, item_text, window, broadcast_bytes, chars, ["doc_id"])
    return found.select("doc_id", f"{name}.*")


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    mark: str = "",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    broadcast_bytes: int = 32_000_000,
    chars: int = 4_000_000,
) -> DataFrame:
    """``docs`` with every hit stretch of the text replaced by ``mark``."""
    found, name = _marked(docs, benchmark, text, item, item_text, window, broadcast_bytes, chars, docs.columns)
    body, start = F.col(text), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state, s):
        gap = F.substring(body, state["at"] + 1, s["start"] - state["at"])
        return F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(gap, F.lit(mark))).alias("out"))

    clean = F.aggregate(
        F.col(name)["spans"],
        start,
        step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(body, s["at"] + 1, F.length(body))),
    )
    return found.withColumn(text, F.when(F.size(F.col(name)["spans"]) > 0, clean).otherwise(body)).select(docs.columns)


def drop_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    most: float = 0.0,
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    broadcast_bytes: int = 32_000_000,
    chars: int = 4_000_000,
) -> DataFrame:
    """``docs`` without rows of which more than the share ``most`` of their words is hit."""
    found, name = _marked(docs, benchmark, text, item, item_text, window, broadcast_bytes, chars, docs.columns)
    return found.filter(F.col(name)["n_hit"] <= most * F.col(name)["n_words"]).select(docs.columns)
