"""Many literal terms in one pass: an Aho-Corasick automaton over the texts.

The automaton of all terms is built once in a Python worker and reads each text once,
however many terms there are.  A hit carries the characters before it, so whether it is
negated is decided by the engine's regular expressions, as for single patterns, and
spans equal those of :func:`reportloom.functions.text.match_spans` over the same terms.

Letters are compared in either case, one character for one, so offsets stay those of the
text.  Terms are trimmed, empty and repeated ones left out; a null text has no hits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import FLAGS
from ..functions.text import NEGATION_PHRASES

HIT = "array<struct<term:int,start:int,end:int,negated:boolean>>"
_RAW = "array<struct<term:int,start:int,end:int,before:string>>"
_NAME = "_dictionary_hits"


@functools.cache
def _cases() -> dict[int, str]:
    """What the characters become that have an upper or a lower case, one for one."""

    def one(c: str, changed: str) -> str:
        return changed if len(changed) == 1 else c

    out = {}
    for code in range(0x110000):
        c = chr(code)
        low = one(c, one(c, c.upper()).lower())
        if low != c:
            out[code] = low
    return out | {0x130: "i"}


def fold(text: str) -> str:
    """Characters that match in either case made equal; the length stays."""
    return text.lower() if text.isascii() else text.translate(_cases())


class Terms:
    """The automaton of some terms, numbered in the order given."""

    def __init__(self, terms: Sequence[str]):
        self._automaton = ahocorasick.Automaton()
        numbers: dict[str, int] = {}
        for i, term in enumerate(terms):
            numbers.setdefault(fold(term), i)
        for term, i in numbers.items():
            self._automaton.add_word(term, (i, len(term)))
        self._automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Number, start and end of every hit, those of one term not overlapping each other."""
        last: dict[int, int] = {}
        if not len(self._automaton):
            return
        for at, (term, size) in self._automaton.iter(text):
            start = at + 1 - size
            if start >= last.get(term, 0):
                last[term] = at + 1
                yield term, start, at + 1


def leftmost(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Hits that do not overlap: the earliest start wins, then the longer one."""
    out, edge = [], 0
    for hit in sorted(hits, key=lambda h: (h[1], -h[2])):
        if hit[1] >= edge:
            out.append(hit)
            edge = hit[2]
    return out


@functools.cache
def _automaton(terms: tuple[str, ...]) -> Terms:
    return Terms(terms)


def _find(
    sent: Broadcast, text: str, apart: bool, window: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    terms = _automaton(sent.value)
    kind = pa.list_(
        pa.struct([("term", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string())])
    )
    for batch in batches:
        out = []
        for body in batch.column(batch.schema.get_field_index(text)).to_pylist():
            flat = fold(body or "")
            found = list(terms.hits(flat))
            out.append(
                [
                    {"term": i, "start": a, "end": b, "before": flat[max(0, a - window) : a]}
                    for i, a, b in (leftmost(found) if apart else found)
                ]
            )
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, _NAME])


def usable_terms(terms: Sequence[str]) -> list[str]:
    """Trimmed distinct terms, empty ones left out; of those equal but for the case the first."""
    kept: dict[str, str] = {}
    for t in terms:
        if t and t.strip():
            kept.setdefault(fold(t.strip()), t.strip())
    return list(kept.values())


def _hits(df: DataFrame, text: str, terms: list[str], negations: Sequence[str], window: int, apart: bool) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(_NAME, T.DataType.fromDDL(_RAW))])
    sent = df.sparkSession.sparkContext.broadcast(tuple(terms))  # a list the caller holds anyway
    found = df.mapInArrow(functools.partial(_find, sent, text, apart, window), schema)
    negation = FLAGS + "|".join(negations)
    judged = F.transform(
        _NAME,
        lambda h: F.struct(
            h["term"].alias("term"), h["start"].alias("start"), h["end"].alias("end"), h["before"].rlike(negation).alias("negated")
        ),
    )
    return found.withColumn(_NAME, judged)


def with_spans(
    df: DataFrame,
    terms: Sequence[str],
    text: str = "report_text",
    name: str = "spans",
    negations: Sequence[str] = NEGATION_PHRASES,
    window: int = 50,
) -> DataFrame:
    """``df`` with the non-overlapping hits of all terms as ``array<struct<term, start, end, negated>>``.

    ``term`` is the place in :func:`usable_terms`; offsets are 0-based, ends exclusive.
    Where hits overlap the earliest start wins, then the longer one.  A hit is negated if
    a negation phrase lies in the ``window`` characters before it.
    """
    kept = [c for c in df.columns if c != name]
    found = _hits(df.select(*kept), text, usable_terms(terms), negations, window, True)
    return found.withColumnRenamed(_NAME, name)


def with_positive(
    df: DataFrame,
    terms: Sequence[str],
    text: str = "report_text",
    name: str = "positive",
    negations: Sequence[str] = NEGATION_PHRASES,
    window: int = 50,
) -> DataFrame:
    """``df`` with the terms that have a hit without negation, as ``array<int>`` of their places.

    Hits of different terms do not hide each other.
    """
    kept = [c for c in df.columns if c != name]
    found = _hits(df.select(*kept), text, usable_terms(terms), negations, window, False)
    plain = F.filter(_NAME, lambda h: ~h["negated"])
    return found.withColumn(name, F.array_sort(F.array_distinct(F.transform(plain, lambda h: h["term"])))).drop(_NAME)


def mentions_any(df: DataFrame, terms: Sequence[str], text: str = "report_text", positive: bool = False) -> DataFrame:
    """Rows whose text holds some term, or one that is not negated."""
    kept = df.columns
    found = _hits(df, text, usable_terms(terms), NEGATION_PHRASES, 50, False)
    hit: Column = F.exists(_NAME, lambda h: ~h["negated"]) if positive else F.size(_NAME) > 0
    return found.filter(hit).select(kept)
