"""Public tokenizers inside tasks: texts are cut where no token can cross, and the
short pieces between the cuts are encoded once and remembered.

The cuts are safe for the pre-tokenizers named below, so joining the pieces' ids gives
exactly the ids of the whole text; texts that do not fit the rule are encoded whole by
the library.  A new piece of Latin letters is split into pre-tokens, which the
library's model encodes; any other goes through the whole library.  The memory of a
worker holds at most ``remembered`` pieces of at most ``LONGEST`` characters and is
emptied when full, so it is bounded for any corpus.
"""

from __future__ import annotations

import functools
import json
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

REMEMBERED = 1_200_000
LONGEST = 100

# Two blanks that meet, one of them a space or a line break: no cut is safe in there.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_MEETING = rf"{_BLANK}[ \n]|\n{_BLANK}"
# Arrow takes the first for blanks, the tokenizers do not; the last becomes two in lower case.
_CONTROL = r"[\x1c-\x1f\x{130}]"
# Below this code point no letters compose, and lower case is letter by letter.
LATIN_END = "\u0250"
# The pre-tokenizations of the public vocabularies: fixed patterns.
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def byte_level_fits(texts: pa.Array, special: Iterable[str]) -> pa.Array:
    """Texts that may be cut for a byte-level vocabulary."""
    odd = pc.match_substring_regex(texts, _MEETING)
    for s in special:  # a special string ends the text before it, which changes how blanks are taken
        odd = pc.or_(odd, pc.match_substring(texts, s))
    return pc.invert(odd)


def numbered(texts: pa.Array, fits: np.ndarray, cut) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of the texts that fit, the number of each piece in order, and where each text begins."""
    lists = cut(texts.filter(pa.array(fits))) if fits.any() else pa.array([], pa.list_(pa.string()))
    coded, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), offsets - offsets[0]


# Letters and what is not a letter never share a pre-token, but for an apostrophe.
_STOP = r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?])"


def _bytes_in(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars.encode("ascii"), np.uint8))


_LETTERS, _STOPS = _bytes_in(string.ascii_letters), _bytes_in(".,;:!?")


def cut_byte_level(texts: pa.Array) -> pa.Array:
    """Pieces of texts between cuts no byte-level token crosses; none is empty.

    A cut falls before every space, around every line break and between a letter and
    a stop.  It is safe where blanks never meet, because the pre-tokenizer then takes
    a space with the word after it and a line break alone.  The cuts are found on the
    bytes, and the pieces share those of the texts.
    """
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low, high = int(offsets[0]), int(offsets[-1])
    data = pa.py_buffer(b"") if data is None else data
    raw = np.frombuffer(data, np.uint8)[low:high]
    begins, lines = raw == ord(" "), raw == ord("\n")
    begins |= lines
    begins[1:] |= lines[:-1]
    stops = np.flatnonzero(_STOPS[raw])
    stops = stops[stops > 0]
    last, lead = raw[stops - 1], raw[np.maximum(stops - 2, 0)].astype(np.int32)
    wide = (last & 0xC0) == 0x80  # of a letter of two bytes, or of a longer character
    point = ((lead - 0xC0) << 6) + (last & 0x3F)
    wide &= (point >= 0xC0) & (point < ord(LATIN_END)) & (point != 0xD7) & (point != 0xF7)
    begins[stops[_LETTERS[last] | wide]] = True
    begins[offsets[:-1][offsets[:-1] < high] - low] = True
    starts = np.flatnonzero(begins).astype(np.int32) + np.int32(low)
    firsts = np.searchsorted(starts, offsets).astype(np.int32)
    ends = pa.py_buffer(np.append(starts, np.int32(high)))
    return pa.ListArray.from_arrays(pa.array(firsts), pa.StringArray.from_buffers(len(starts), ends, data))


def _cut_words(texts: pa.Array) -> pa.Array:
    """Words and the stops behind them, for a vocabulary that lowers letters and drops blanks."""
    return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _STOP, r"\1 \2"))


class PieceEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizers file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self._remembered = remembered
        spec = json.load(open(path, encoding="utf-8"))
        self._library = Tokenizer.from_file(path)
        self._tokenize = self._library.model.tokenize
        self._library.no_truncation()
        self._library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        kinds = json.dumps(spec["pre_tokenizer"])
        odd = any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec["added_tokens"])
        byte_level = spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]
        self._cut, self._lower, self._split = None, False, None
        if byte_level and not odd and not spec["normalizer"] and not spec["pre_tokenizer"]["add_prefix_space"]:
            self._cut, self._split = cut_byte_level, regex.compile(BYTE_LEVEL).findall
        elif (
            not odd
            and '"Removed"' in kinds
            and "[^\\\\s\\\\p{L}\\\\p{N}]+" in kinds
            and "Lowercase" in json.dumps(spec["normalizer"])
        ):
            self._cut, self._lower, self._split = _cut_words, True, regex.compile(WORD_LEVEL).findall
        self._symbols = dict(enumerate(byte_symbols()))
        self._known: dict[str, bytes] = {}

    def _fits(self, texts: pa.Array) -> pa.Array:
        """Texts that may be cut."""
        if not self._lower:
            return byte_level_fits(texts, self.special)
        odd = pc.match_substring_regex(texts, _CONTROL)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        return pc.invert(odd)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        if not part.isascii() or not part.isalpha():
            part = part.encode("utf-8").decode("latin-1").translate(self._symbols)
        return array("I", [t.id for t in self._tokenize(part)]).tobytes()

    def _new(self, pieces: list[str], known: dict[str, bytes]) -> dict[str, bytes]:
        """Ids of pieces that are not remembered; short ones are from now on."""
        lower, split, part, others = self._lower, self._split, self._part, []
        tokenize, space = self._tokenize, self._symbols[ord(" ")]
        for piece in pieces:
            if len(piece) > LONGEST or not (piece.isascii() or max(piece) < LATIN_END):
                others.append(piece)
                continue
            text = piece.lower() if lower else piece
            # Letters, with at most a space before them, need no pattern.
            if text.isalpha():
                known[piece] = part(text)
            elif text[:1] == " " and text[1:].isalpha():
                known[piece] = array("I", [t.id for t in tokenize(space + text[1:])]).tobytes() if text.isascii() else part(text)
            else:
                known[piece] = b"".join(map(part, split(text)))
        found = dict(zip(others, self._whole(others)))
        known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        return found

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > self._remembered:
            known.clear()
        found = list(map(known.get, pieces))
        if None in found:
            new = self._new([p for p, ids in zip(pieces, found) if ids is None], known)
            found = [(known[p] if p in known else new[p]) if ids is None else ids for p, ids in zip(pieces, found)]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins, with the end last.

        Without begin, end or added special tokens.  Pieces are numbered first, so a
        piece that occurs often in the group is looked up once.
        """
        fits = self._fits(texts).to_numpy(zero_copy_only=False) if self._cut else np.zeros(len(texts), dtype=bool)
        pieces, codes, offsets = numbered(texts, fits, self._cut)
        ids = self._ids_of(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        reach = np.concatenate([[0], np.cumsum(each)])
        kind = np.int32 if max(reach[-1], len(pool)) < 1 << 31 else np.int64
        flat = pool[np.arange(reach[-1], dtype=kind) + np.repeat((starts[codes] - reach[:-1]).astype(kind), each)]
        begins = reach[offsets]
        if fits.all():
            return flat, begins
        others = iter(self._whole(texts.filter(pa.array(~fits)).to_pylist()))
        parts, k = [], 0
        for fit in fits:
            if fit:
                parts.append(flat[begins[k] : begins[k + 1]])
                k += 1
            else:
                parts.append(np.frombuffer(next(others), "<u4"))
        begins = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return np.concatenate(parts) if parts else flat, begins

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as bytes."""
        flat, begins = self.encode(pa.array(texts, pa.string()))
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(begins, begins[1:])]

    @property
    def size(self) -> int:
        """Above every id."""
        return max(self._library.get_vocab(with_added_tokens=True).values()) + 1


@functools.cache
def encoder(path: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """One encoder for each worker process and file."""
    return PieceEncoder(path, remembered)


def text_slices(
    batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = 4_000_000
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of batches of about ``chars`` bytes of text, with their texts, null as empty.

    A longer text is a slice of its own, so memory is bounded by the longest text.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        sizes = np.asarray(pc.binary_length(column), dtype=np.int64)
        if not len(sizes):
            continue
        group = (np.cumsum(sizes) - sizes) // chars
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(a, b - a), column.slice(a, b - a)


def text_groups(
    batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = 1_000_000
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """As ``text_slices``, with the texts as a list."""
    for part, texts in text_slices(batches, text, chars):
        yield part, texts.to_pylist()
