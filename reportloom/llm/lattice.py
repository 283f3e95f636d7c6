"""Language-model scores: the probability of a text over all its subword segmentations.

An existing vocabulary gives the pieces and their scores.  A word's lattice has an edge
for every piece that matches at every place; a forward recursion in log space adds up
all paths.  Pieces never cross blanks, so a text's log probability is the sum over its
words and its end: each distinct word is scored once, in the task of its hash range.
Vocabularies of merge ranks (scores 0, -1, -2, ...) are read as Zipf's law, the piece of
rank r in proportion to 1 / (r + 2.7); scores of a unigram vocabulary are log
probabilities as they stand.  Characters without a piece fall back to their bytes, which
share ``byte_mass``.

With ``rounds`` the model is learned from the training rows.  Expectation maximisation over
the distinct training words, each once, fits the pieces' probabilities, starting from the
vocabulary's, whose prior counts ``prior`` pieces.  A word of count c among T training
tokens then has the probability (max(c - discount, 0) + m * lattice) / (T + 1), where m is
the mass the discount leaves, discount times the distinct words, plus one; a text's end
has that of its count.  A round sends 32,000 sums; words stay in their hash ranges.

Beside it stands a smoothed word unigram learned from the training rows, whose counts
cover every training document: blocks of rows send each hash range the words they hold
with their counts, once per block, and the range answers with the counts of all
documents and the words' lattice scores.

Defined results: words are split at ASCII blanks after lower-casing A-Z; a null or
empty text is its end alone; rows of null id are scored and not learned from; repeated
rows count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import giving_back, release, staged, whole_text
from .vocab import text_groups

SENT = "key long, block long, bucket long, " + ", ".join(f"b{i} binary" for i in range(6))
MERGED = SENT + ", n_train long, n_distinct long"
SUMS = "doc_id long, learned boolean, words long, known long, base double, model double"
_NAMES = ["key", "block", "bucket", *(f"b{i}" for i in range(6))]
_BASE = np.uint64(0x100000001B3)
_SPACE = "▁"  # how the vocabulary writes the blank before a word


class Lattice:
    """Log10 probabilities of words by a sentencepiece vocabulary."""

    def __init__(self, path: str, byte_mass: float = 1e-3):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, scores, end = [], [], 0.0
        for i in range(model.get_piece_size()):
            if i == model.eos_id():
                end = model.get_score(i)
            elif not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        scores = np.array([*scores, end], dtype=np.float64)
        if np.array_equal(scores, np.round(scores)):  # ranks, not log probabilities
            scores = -np.log(scores.max() - scores + 2.7)
        scores -= np.log(np.exp(scores).sum())
        scores += np.log1p(-byte_mass)
        self.end = float(scores[-1] / np.log(10))
        self._byte = float(np.log(byte_mass / 256))
        hashes = np.array([self._hash(p) for p in plain], dtype=np.uint64)
        order = np.argsort(hashes)
        self._hashes, self.scores = hashes[order], scores[:-1][order]
        self.pieces = [plain[i] for i in order]
        self._longest = max(map(len, plain))
        self._maybe = np.zeros(1 << 22, dtype=bool)
        self._maybe[self._slot(self._hashes)] = True

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _pieces(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes belong to pieces, and to which."""
        at = np.flatnonzero(self._maybe[self._slot(hashes)])
        place = np.minimum(np.searchsorted(self._hashes, hashes[at]), len(self._hashes) - 1)
        hit = self._hashes[place] == hashes[at]
        return at[hit], place[hit]

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Start, end, rows and pieces of the edges by ascending end; for bytes their number instead of pieces."""
        rows, length = codes.shape
        size = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        hashes = [np.zeros(rows, dtype=np.uint64) for _ in range(min(length, self._longest))]
        for end in range(1, length + 1):
            code = codes[:, end - 1].astype(np.uint64) + np.uint64(1)
            # hashes[k]: of the k + 1 characters that end here
            for k in range(min(end, self._longest) - 1, 0, -1):
                hashes[k] = hashes[k - 1] * _BASE + code
            hashes[0] = code
            for k in range(min(end, self._longest)):
                at, place = self._pieces(hashes[k])
                if k == 0:
                    rest = np.ones(rows, dtype=bool)
                    rest[at] = False
                    rest = np.flatnonzero(rest)
                    if len(rest):
                        yield end - 1, end, rest, size[rest, end - 1], None
                if len(at):
                    yield end - 1 - k, end, at, size[at, 0], place

    def _same_length(self, codes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of words given as rows of code points."""
        rows, length = codes.shape
        alpha = np.full((length + 1, rows), -np.inf)
        alpha[0] = 0
        for start, end, at, size, place in self._edges(codes):
            own = size * self._byte if place is None else scores[place]
            alpha[end, at] = np.logaddexp(alpha[end, at], own + alpha[start, at])
        return alpha[length]

    def _expected(self, codes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How often each piece is expected in these words, given that each word occurs."""
        rows, length = codes.shape
        edges = list(self._edges(codes))
        own = [size * self._byte if place is None else scores[place] for _, _, _, size, place in edges]
        alpha, beta = np.full((length + 1, rows), -np.inf), np.full((length + 1, rows), -np.inf)
        alpha[0] = beta[length] = 0
        for (start, end, at, _, _), x in zip(edges, own):
            alpha[end, at] = np.logaddexp(alpha[end, at], x + alpha[start, at])
        # By descending start every edge that leaves the end has been added.
        places, weights = [], []
        for i in sorted(range(len(edges)), key=lambda i: -edges[i][1]):
            start, end, at, _, place = edges[i]
            through = own[i] + beta[end, at]
            beta[start, at] = np.logaddexp(beta[start, at], through)
            if place is not None:
                places.append(place)
                weights.append(np.exp(alpha[start, at] + through - alpha[length, at]))
        if not places:
            return np.zeros(len(scores))
        return np.bincount(np.concatenate(places), np.concatenate(weights), len(scores))

    def _grids(self, words: list[str], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length each time, after a blank: which, and their code points."""
        lengths = np.array([len(w) for w in words], dtype=np.int64) + 1
        order = np.argsort(lengths, kind="stable")
        sorted_lengths, at = lengths[order], 0
        while at < len(order):
            length = sorted_lengths[at]
            end = min(int(np.searchsorted(sorted_lengths, length, side="right")), at + max(1, cells // int(length)))
            own = order[at:end]
            raw = "".join(_SPACE + words[i] for i in own).encode("utf-32-le", "surrogatepass")
            yield own, np.frombuffer(raw, "<u4").reshape(len(own), length)
            at = end

    def words(self, words: list[str], scores: np.ndarray | None = None, cells: int = 500_000) -> np.ndarray:
        """Log10 probability of each word after a blank, over all its segmentations."""
        scores, out = self.scores if scores is None else scores, np.zeros(len(words))
        for own, codes in self._grids(words, cells):
            out[own] = self._same_length(codes, scores)
        return out / np.log(10)

    def expected(self, words: list[str], scores: np.ndarray, cells: int = 200_000) -> np.ndarray:
        """Expected number of every piece in the words, each taken once."""
        out = np.zeros(len(scores))
        for _, codes in self._grids(words, cells):
            out += self._expected(codes, scores)
        return out

    def refitted(self, counts: np.ndarray, prior: float) -> np.ndarray:
        """Scores from expected counts and the vocabulary's own as ``prior`` pieces; bytes and the end keep theirs."""
        own = np.exp(self.scores)
        shares = counts + prior * own / own.sum()
        return np.log(shares / shares.sum() * own.sum())


@functools.cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _send(buckets: int, chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each block for their hash ranges; the block's own record."""
    task, number = TaskContext.get().partitionId(), 0
    for part, texts in text_groups(batches, chars=chars):
        block, number = task << 32 | number, number + 1
        learned = np.array([bool(x) for x in part.column(2).to_pylist()], dtype=bool)
        place: dict[bytes, int] = {}
        given = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        flat = np.array([place.setdefault(w, len(place)) for words in given for w in words], dtype=np.int64)
        of = np.repeat(np.arange(len(given)), [len(w) for w in given])
        words = list(place)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        new = np.empty(len(words), dtype=np.int64)
        new[order] = np.arange(len(words))
        flat = new[flat]
        times = np.bincount(flat[learned[of]], minlength=len(words))
        pairs, counts = np.unique(of * max(1, len(words)) + flat, return_counts=True)
        of, flat = pairs // max(1, len(words)), pairs % max(1, len(words))
        ids = part.column(0)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        record = [
            known.tobytes(),
            np.array(ids.is_null().to_pylist(), dtype=np.uint8).tobytes(),
            learned.astype(np.uint8).tobytes(),
            np.bincount(of, minlength=len(given)).astype("<u4").tobytes(),
            flat.astype("<u4").tobytes(),
            counts.astype("<u4").tobytes(),
        ]
        rows = [(-2 - block, block, -1, *record)]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)):
            mine = order[edges[b] : edges[b + 1]]
            own = b" ".join([words[i] for i in mine])
            rows.append((int(b), block, int(b), own, times[edges[b] : edges[b + 1]].astype("<u4").tobytes(), *[None] * 4))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows))], names=_NAMES
        )


def _merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One hash range as a row: distinct words, training counts, blocks and which words each has; records as they are."""
    if key[0] < 0:
        return frame.assign(n_train=None, n_distinct=None)
    place: dict[bytes, int] = {}
    given = [np.array([place.setdefault(w, len(place)) for w in b.split(b" ")], dtype="<u4") for b in frame["b0"]]
    total = np.zeros(len(place), dtype="<i8")
    for at, times in zip(given, frame["b1"]):
        total[at] += np.frombuffer(times, "<u4")  # a block names a word once
    row = {
        "key": int(key[0]),
        "block": None,
        "bucket": int(key[0]),
        "b0": b" ".join(place),
        "b1": total.tobytes(),
        "b2": frame["block"].to_numpy("<i8").tobytes(),
        "b3": np.array([len(at) for at in given], dtype="<u4").tobytes(),
        "b4": np.concatenate(given).tobytes(),
        "b5": None,
        "n_train": int(total.sum()),
        "n_distinct": int(np.count_nonzero(total)),
    }
    return pd.DataFrame([row])


def _words(row) -> tuple[list[str], np.ndarray]:
    return [w.decode("utf-8", "surrogatepass") for w in row.b0.split(b" ")], np.frombuffer(row.b1, "<i8")


@giving_back
def _expect(path: str, scores: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expected numbers of the pieces in the training words of the task's hash ranges."""
    model, sums = lattice(path), np.zeros(len(scores))
    for batch in batches:
        for row in batch.itertuples():
            words, total = _words(row)
            sums += model.expected([w for w, n in zip(words, total) if n], scores)
    at = np.flatnonzero(sums)
    yield pd.DataFrame({"piece": at, "n": sums[at]})


def _learned(path: str, merged: DataFrame, rounds: int, prior: float) -> np.ndarray:
    """Scores of the pieces after some rounds of expectation maximisation over the training words."""
    model = lattice(path)
    scores, given = model.scores, merged.filter("n_distinct > 0").select("b0", "b1")
    for _ in range(rounds):
        found = given.mapInPandas(functools.partial(_expect, path, scores), "piece long, n double")
        sums = found.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(scores))
        counts[sums["piece"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
        scores = model.refitted(counts, prior)
    return scores


@giving_back
def _answer(
    path: str, scores: np.ndarray, discount: float, tokens: int | None, left: float, batches: Iterator[pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """For every block the counts and scores of its words in one hash range; records as they are."""
    model = lattice(path)
    for batch in batches:
        yield batch[batch["key"] < 0][_NAMES]
        for row in batch[batch["key"] >= 0].itertuples():
            words, total = _words(row)
            logs = model.words(words, scores)
            if tokens is not None:
                with np.errstate(divide="ignore"):
                    seen = np.log(np.maximum(total - discount, 0))
                logs = (np.logaddexp(seen, np.log(left) + logs * np.log(10)) - np.log(tokens + 1)) / np.log(10)
            sizes = np.frombuffer(row.b3, "<u4").astype(np.int64)
            ends, places = np.cumsum(sizes), np.frombuffer(row.b4, "<u4")
            answer = pd.DataFrame({"key": int(row.key), "block": np.frombuffer(row.b2, "<i8"), "bucket": int(row.key)})
            parts = [places[end - size : end] for end, size in zip(ends, sizes)]
            answer["b0"] = [total[at].astype("<i8").tobytes() for at in parts]
            answer["b1"] = [logs[at].astype("<f8").tobytes() for at in parts]
            for i in range(2, 6):
                answer[f"b{i}"] = None
            yield answer


def _sums(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of each document of a block over its words."""
    frame = frame.sort_values("bucket")
    record, answers = frame.iloc[0], frame.iloc[1:]
    counts = np.frombuffer(b"".join(answers["b0"]), "<i8")
    scores = np.frombuffer(b"".join(answers["b1"]), "<f8")
    per = np.frombuffer(record["b3"], "<u4")
    at, times = np.frombuffer(record["b4"], "<u4"), np.frombuffer(record["b5"], "<u4").astype(np.float64)
    of = np.repeat(np.arange(len(per)), per)
    add = lambda x: np.bincount(of, weights=x * times, minlength=len(per))
    ids = pd.array(np.frombuffer(record["b0"], "<i8"), dtype="Int64")
    ids[np.frombuffer(record["b1"], np.uint8).astype(bool)] = pd.NA
    return pd.DataFrame(
        {
            "doc_id": ids,
            "learned": np.frombuffer(record["b2"], np.uint8).astype(bool),
            "words": add(np.ones(len(at))).astype(np.int64),
            "known": add((counts[at] > 0).astype(np.float64)).astype(np.int64),
            "base": add(np.log10(counts[at] + 0.1)),
            "model": add(scores[at]),
        }
    )


def score(
    docs: DataFrame,
    vocabulary: str,
    train: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    rounds: int = 0,
    discount: float = 0.75,
    prior: float = 1000.0,
    bucket_bytes: int = 12_000_000,
    block_chars: int = 6_000_000,
) -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``vocabulary`` is the path of a sentencepiece model, the same on every executor; with
    ``rounds`` of learning ``score`` is the learned model's, else the vocabulary's own;
    the last two parameters bound what one task holds.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        whole_text(text).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    sized = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.sum(F.col("train").cast("long")).alias("docs")).first()
    buckets, ends = max(1, -(-int(sized.n or 0) // bucket_bytes)), int(sized.docs or 0)
    sent = rows.mapInArrow(functools.partial(_send, buckets, block_chars), SENT)
    merged = staged(sent.groupBy("key").applyInPandas(_merge, MERGED), "words")
    release(docs.sparkSession)
    totals = merged.agg(F.sum("n_train").alias("n"), F.sum("n_distinct").alias("kinds")).first()
    tokens, distinct, model = int(totals.n or 0) + ends, int(totals.kinds or 0), lattice(vocabulary)
    kinds = distinct + (ends > 0)
    scores = _learned(vocabulary, merged, rounds, prior)
    answering = functools.partial(
        _answer, vocabulary, scores, discount, tokens if rounds else None, discount * distinct + 1.0
    )
    sums = merged.mapInPandas(answering, SENT).groupBy("block").applyInPandas(_sums, SUMS)
    end = float(np.log10((ends + 10**model.end) / (tokens + 1))) if rounds else model.end
    n_tokens = F.col("words") + 1
    each = float(np.log10(tokens + 0.1 * (kinds + 1)))
    return sums.select(
        "doc_id",
        "learned",
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 0.1)) - n_tokens * each).alias("base_score"),
        (F.col("model") + end).alias("score"),
    )
