"""Token counts by byte-pair merging over a heap and a linked list.

A text is pre-tokenized as byte-level tokenizers do.  Every pre-token starts as its
bytes in a linked list; a heap holds the adjacent pairs that have a merge rank.  The
lowest-ranked pair, leftmost first, is popped; if both symbols are still in place they
become one and the two new neighbours enter the heap.  The count is the number of
initial symbols minus the number of merges: no ids are emitted.

Special strings in a text count as one token each and split it, as the library does by
default.  Counts of short pieces are remembered per worker, in bounded memory.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id is kept as
it is; repeated rows are counted each; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import whole_text
from .vocab import BYTE_LEVEL, LATIN_END, LONGEST, REMEMBERED, byte_level_fits, byte_symbols, cut_byte_level, numbered, text_slices

@functools.cache
def _newer_letters() -> regex.Pattern:
    """Letters and numbers that the pattern library knows and Unicode 15, as in vocabularies, does not."""
    known = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in range(0x250, 0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    return regex.compile("[" + "".join(f"\\U{c:08x}" for c in new) + "]" if new else r"(?!)")


class MergeCounter:
    """Counts tokens by the merge ranks of a tokenizers file with byte-level BPE."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]]
        if odd or spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError(f"{path}: only plain byte-level vocabularies are counted")
        self._prefix = spec["pre_tokenizer"]["add_prefix_space"]
        vocab = spec["model"]["vocab"]
        self._first = [vocab[s] for s in byte_symbols()]
        self._base = base = len(vocab) + 1
        self._ranks: dict[int, int] = {}
        self._made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._ranks[vocab[left] * base + vocab[right]] = rank
            self._made.append(vocab[left + right])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self._split = regex.compile(BYTE_LEVEL).findall
        self._known: dict[str, int] = {}

    def merged(self, raw: bytes) -> int:
        """Symbols that remain of one pre-token."""
        n, base, ranks = len(raw), self._base, self._ranks
        symbols = [self._first[b] for b in raw]
        # An entry is the rank and, below it, the place of the left symbol.
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] * base + symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made, merges = self._made, 0
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            # The place may have been merged since: then its pair has another rank.
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] * base + symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = made[rank], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(symbols[i] * base + symbols[k])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] * base + symbols[i])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | h)
        return n - merges

    def piece(self, text: str) -> int:
        """Tokens of a text without special strings."""
        parts = self._split(text)
        if not (text.isascii() or max(text) < LATIN_END) and _newer_letters().search(text):
            # split as if they were unassigned, then take the text's own characters
            parts, at = self._split(_newer_letters().sub("\u0378", text)), 0
            for i, part in enumerate(parts):
                parts[i], at = text[at : at + len(part)], at + len(part)
        return sum(self.merged(p.encode("utf-8")) for p in parts)

    def count(self, text: str) -> int:
        """Tokens of a text, special strings as one each."""
        parts = self._special.split(text) if self._special.search(text) else [text]
        total = len(parts) - 1
        for part in parts:
            if self._prefix and part and not part[0].isspace():
                part = " " + part
            total += self.piece(part)
        return total

    def _new(self, pieces: list[str]) -> dict[str, int]:
        """Counts of pieces that are not remembered; short ones are from now on."""
        known, aside = self._known, {}
        for p in pieces:
            # Letters, with at most a space before them, are one pre-token.
            body = p[1:] if p[:1] == " " else p
            if body.isalpha() and (p.isascii() or max(p) < LATIN_END):
                n = self.merged(p.encode("utf-8"))
            else:
                n = self.piece(p)
            (known if len(p) <= LONGEST else aside)[p] = n
        return aside

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text; a piece that occurs often in the group is looked up once."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        fits = byte_level_fits(texts, self.special).to_numpy(zero_copy_only=False)
        if self._prefix:
            fits = np.zeros(len(texts), dtype=bool)
        pieces, codes, offsets = numbered(texts, fits, cut_byte_level)
        found = list(map(known.get, pieces))
        if None in found:
            aside = self._new([p for p, n in zip(pieces, found) if n is None])
            found = [(known[p] if p in known else aside[p]) if n is None else n for p, n in zip(pieces, found)]
        reach = np.concatenate([[0], np.cumsum(np.array(found, dtype=np.int64)[codes])])
        out = np.zeros(len(texts), dtype=np.int64)
        out[fits] = np.diff(reach[offsets])
        for i in np.flatnonzero(~fits):
            out[i] = self.count(texts[int(i)].as_py())
        return out


@functools.cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = counter(path).counts
    for part, texts in text_slices(batches):
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(counts(texts), pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``tokenizer`` is the path of a tokenizers file, the same on every executor.
    """
    body = whole_text(text)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text")
    )
    counted = rows.mapInArrow(functools.partial(_count, tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
