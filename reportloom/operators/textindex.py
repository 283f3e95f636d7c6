"""Text search by an inverted index of trigrams, instead of a scan of all texts.

The index is a folder of two Parquet tables.  ``keys`` numbers the rows in the order of
their key.  ``postings`` holds, per trigram and block of 65,536 numbers, the numbers of
the texts with it, as deltas in a variable number of bytes; it is ranged by trigram and
block, so a hot trigram spreads over files and a lookup reads the row groups of its
trigrams.  Texts are folded first, so that letters which match in either case are equal.

A search asks what trigrams a pattern requires: its literal stretches, with the
alternatives of a group or a branch; gaps, classes and optional parts require nothing.
Each block answers with its texts that have them, and only the rows with those keys are
read and given to the regular expression, which alone decides.  A pattern that
requires no trigram is a scan.

Rows without text are in no posting and match nothing; rows of equal key are candidates
together; a null key is a key.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import FLAGS, any_of
from ..session import scratch_path

BLOCK_BITS = 16
#: Alternatives of one literal stretch that are followed; beyond, the stretch ends.
_ALTERNATIVES = 32
_POSTINGS = "gram long, block long, n long, numbers binary"

#: What a pattern requires: a trigram, ("and" | "or", parts), or None for nothing.
Required = int | tuple | None


#: Escapes that the engine reads in another way than the standard library.
_OTHER_ESCAPES = re.compile(r"(?<!\\)(?:\\\\)*\\(?:v|0|b\{)")


def _folded(text: str) -> str:
    """Letters that a pattern takes for equal in either case made equal."""
    return text.replace("İ", "i").upper().lower().replace("ς", "σ")


def _grams(text: str) -> np.ndarray:
    """Distinct trigrams of a text, each as the 63 bits of its code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(codes) < 3:
        return codes[:0]
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])


def _encoded(numbers: np.ndarray) -> bytes:
    """Ascending numbers below 65,536 as deltas of one to three bytes."""
    deltas = np.diff(numbers, prepend=0).astype(np.int64)
    parts = np.stack([deltas & 127 | 128, deltas >> 7 & 127 | 128, deltas >> 14], axis=1)
    size = 1 + (deltas > 127) + (deltas > 16383)
    parts[np.arange(len(deltas)), size - 1] &= 127
    return parts[np.arange(3) < size[:, None]].astype(np.uint8).tobytes()


def _decoded(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).astype(np.int64)
    last = parts < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(parts)) - np.repeat(first, np.diff(np.concatenate([first, [len(parts)]])))
    return np.cumsum(np.add.reduceat((parts & 127) << 7 * place, first))


def _post(pairs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the rows of a task, whose numbers ascend."""
    grams: list[np.ndarray] = []
    numbers: list[int] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        gram = np.concatenate(grams)
        number = np.repeat(np.array(numbers, dtype=np.int64), [len(g) for g in grams])
        order = np.lexsort((number, gram))
        gram, number = gram[order], number[order]
        block = number >> BLOCK_BITS
        starts = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        ends = np.append(starts[1:], len(gram))
        low = number & ((1 << BLOCK_BITS) - 1)
        raw = [_encoded(low[a:b]) for a, b in zip(starts, ends)]
        columns = [gram[starts], block[starts], ends - starts, raw]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], names=["gram", "block", "n", "numbers"]
        )

    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _grams(_folded(text))
            if not len(found):
                continue
            grams.append(found)
            numbers.append(number)
            held += len(found)
            if held >= pairs:
                yield flushed()
                grams, numbers, held = [], [], 0
    if grams:
        yield flushed()


def _and(parts: Sequence[Required]) -> Required:
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _or(parts: Sequence[Required]) -> Required:
    if not parts or any(p is None for p in parts):
        return None
    kept = list(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_literals(found: Sequence[str]) -> Required:
    """One of these strings occurs."""
    return _or([_and([int(g) for g in _grams(_folded(s))]) for s in found])


def _literals(node) -> list[str] | None:
    """All strings a part of a pattern stands for, where they are few and fixed."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return [chr(value)]
    if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
        return [chr(c) for _, c in value]
    if kind == "AT" or kind in ("ASSERT", "ASSERT_NOT"):
        return [""]  # matches between two characters, which stay neighbours
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        found = [_sequence(part) for part in value[1]]
        if all(f is not None for f in found):
            return sum(found, [])
    return None


def _sequence(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        found = _literals(node)
        if found is None or len(out) * len(found) > _ALTERNATIVES:
            return None
        out = [a + b for a in out for b in found]
    return out


def _required(nodes) -> Required:
    """What a sequence of parts requires."""
    parts: list[Required] = []
    run = [""]
    for node in nodes:
        found = _literals(node)
        if found is not None and len(run) * len(found) <= _ALTERNATIVES:
            run = [a + b for a in run for b in found]
            continue
        parts.append(_of_literals(run))
        run = [""] if found is None or len(found) > _ALTERNATIVES else found
        kind, value = str(node[0]), node[1]
        if kind == "SUBPATTERN":
            parts.append(_required(value[-1]))
        elif kind == "BRANCH":
            parts.append(_or([_required(part) for part in value[1]]))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            parts.append(_required(value[2]))
        elif kind == "ATOMIC_GROUP":
            parts.append(_required(value))
    parts.append(_of_literals(run))
    return _and(parts)


def required(pattern: str) -> Required:
    """Trigrams without which the pattern cannot match; None where none is known.

    The standard library's reader of patterns takes it apart; what it does not know
    of the engine's syntax requires nothing.
    """
    if _OTHER_ESCAPES.search(pattern):
        return None
    try:
        return _required(re._parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None


def _named(query: Required) -> set[int]:
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(_named, query[1]))


def _answers(query: Required):
    """Function of a block's postings: the numbers whose texts have what the query requires."""

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lists: dict[int, np.ndarray] = {}
        for gram, own in frame.groupby("gram")["numbers"]:
            lists[int(gram)] = np.unique(np.concatenate([_decoded(raw) for raw in own]))

        def found(part) -> np.ndarray:
            if isinstance(part, int):
                return lists.get(part, np.zeros(0, dtype=np.int64))
            some = [found(p) for p in part[1]]
            return functools.reduce(np.union1d if part[0] == "or" else np.intersect1d, some)

        return pd.DataFrame({"number": found(query).astype(np.int64) + (int(key[0]) << BLOCK_BITS)})

    return answer


@dataclass
class TextIndex:
    """An index stored under ``path``, over the column ``text`` of rows named by ``key``."""

    spark: SparkSession
    path: str
    key: str
    text: str

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, key: str, text: str, pairs: int = 4_000_000) -> TextIndex:
        """Index ``docs`` under ``path``; ``pairs`` of trigram and text bound what a task holds."""
        spark, path = docs.sparkSession, path.rstrip("/")
        order = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        ranged = order.repartitionByRange("key").sortWithinPartitions("key")
        held = scratch_path(spark, "texts")  # numbers are drawn once
        ranged.select(F.monotonically_increasing_id().alias("number"), "key", "text").write.parquet(held)
        texts = spark.read.parquet(held)
        texts.select("number", "key").write.parquet(f"{path}/keys")
        posted = texts.filter(F.length("text") >= 3).select("number", "text").mapInArrow(functools.partial(_post, pairs), _POSTINGS)
        posted.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/postings")
        return cls(spark, path, key, text)

    def _keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/keys")

    def candidates(self, patterns: Sequence[str]) -> DataFrame | None:
        """``number, key`` of the texts that some pattern may match; None for all of them."""
        query = _or([required(p) for p in patterns]) if patterns else None
        if query is None:
            return None
        postings = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("gram").isin(*sorted(_named(query))))
        numbers = postings.groupBy("block").applyInPandas(_answers(query), "number long")
        return numbers.join(self._keys(), "number")

    def search(self, docs: DataFrame, patterns: str | Sequence[str]) -> DataFrame:
        """Rows of ``docs`` whose text some pattern matches, ignoring case, across lines."""
        patterns = [patterns] if isinstance(patterns, str) else list(patterns)
        matched = any_of([F.col(self.text).rlike(FLAGS + p) for p in patterns])
        found = self.candidates(patterns)
        if patterns and found is not None:
            # No row is kept for its key alone: the pattern decides below.
            keys = found.select(F.col("key").alias("_key")).distinct()
            docs = docs.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
        return docs.filter(matched)

    def share_read(self, patterns: Sequence[str]) -> DataFrame:
        """``n_texts, n_read``: texts of the index, and those that a search reads."""
        all_ = self._keys().select("number")
        found = self.candidates(list(patterns))
        read = all_ if found is None else found.select("number")
        both = all_.select(F.lit(1).alias("t"), F.lit(0).alias("r")).union(read.select(F.lit(0), F.lit(1)))
        return both.agg(F.sum("t").alias("n_texts"), F.sum("r").alias("n_read"))
