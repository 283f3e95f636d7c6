"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three letters of the lower-cased text; anything
that is not a letter is one blank.  They are weighted by sublinear term frequency and
inverse document frequency and scaled to length 1.  Document frequencies count every
training document.  Weights are learned online by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of the training documents: at most
``sample_per_class`` of each language, those of the smallest seeded hash.  A share of
the sample is held back to find the temperature that calibrates the probabilities.

The model is ``2 ** bits`` rows by one column for each language, fixed in size for any
corpus; the driver sees it and the sample's features, nothing else.

Defined results: a text that is null or has no letter is ``und`` with score 0; a null
label is not learned; without any labelled text everything is ``und``; null ids and
repeated rows are predicted like others; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import giving_back
from .vocab import text_groups

UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, 0 if it is no letter, else its own number; built once a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32)
    return _LETTERS


def ngram_counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs; empty without letters."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letters()[raw]
    # Runs of other characters become one blank, with one at either end.
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    mixed = (codes + np.uint32(1)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    grams, found = mixed[1:-1], []
    for n in (1, 2, 3):
        if n == 2:
            grams = mixed[:-1] * np.uint32(0x85EBCA6B) + mixed[1:]
        elif n == 3:
            grams = grams[:-1] * np.uint32(0xC2B2AE35) + mixed[2:]
        g = (grams ^ (grams >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        found.append((g >> np.uint32(32 - bits)).astype(np.int32))
    counts = np.bincount(np.concatenate(found), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of a document's features, of length 1."""
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Ftrl:
    """Follow-the-regularised-leader for a multinomial model over sparse examples."""

    features: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros((self.features, self.classes))
        self.n = np.zeros((self.features, self.classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        """Closed-form weights: exactly 0 where the penalty outweighs the evidence."""
        z, n = self.z[at], self.n[at]
        return np.where(
            np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        )

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        grad = x[:, None] * error[None, :]
        n = self.n[at]
        self.z[at] += grad - (np.sqrt(n + grad**2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + grad**2


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest, by golden section.

    Labels are smoothed by one in their number, so few of them never prove certainty.
    """
    goal = np.full(logits.shape, 1 / (len(labels) + 2) / max(1, logits.shape[1] - 1))
    goal[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        return -float((goal * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))).sum(axis=1).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    classes: list[str]
    bits: int
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = ngram_counts(text or "", self.bits)
        if not len(at) or not self.classes:
            return UNKNOWN, 0.0
        p = softmax(tf_idf(at, counts, self.idf) @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))  # of equal ones the first in code point order
        return self.classes[best], float(p[best])


@giving_back
def _frequencies(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of one partition, its number of documents last."""
    total = np.zeros((1 << bits) + 1, dtype=np.int64)
    for _, texts in text_groups(batches):
        for text in texts:
            at, _ = ngram_counts(text, bits)
            total[at] += 1
        total[-1] += len(texts)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["feature", "df"])


@giving_back
def _features(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_groups(batches):
        found = [ngram_counts(t, bits) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array([at.astype("<i4").tobytes() for at, _ in found], pa.binary()),
                pa.array([c.astype("<f4").tobytes() for _, c in found], pa.binary()),
            ],
            names=["lang", "turn", "at", "counts"],
        )


#: Parts of a label's rows that are looked through side by side.
_SHARES = 8


def fit(
    docs: DataFrame,
    train: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    bits: int = 15,
    sample_per_class: int = 1000,
    epochs: int = 3,
    calibrate_share: float = 0.2,
    seed: int = 11,
) -> LanguageModel:
    """Model of the rows where ``train`` holds and the label is not null.

    ``sample_per_class`` bounds the rows of a label whose features reach the driver; rows of
    equal id and label count once there.  The labels are the classes of the model, which has
    a weight for each of them and each of ``2 ** bits`` features: a fixed, small set.
    """
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    named = rows.select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit(seed), key).alias("turn")
    )
    df = np.zeros((1 << bits) + 1, dtype=np.int64)
    counted = named.select("text").mapInArrow(functools.partial(_frequencies, bits), "feature long, df long")
    for r in counted.groupBy("feature").agg(F.sum("df").alias("df")).collect():  # 2 ** bits + 1 rows at most
        df[r.feature] = r.df
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1.0
    # The bounded sample is chosen on (label, hash) alone, then joined to its texts.  A label
    # may hold most rows, so its first ones are found among its shares, then among those.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("turn"), F.lit(_SHARES))).orderBy("turn")
    whole = Window.partitionBy("lang").orderBy("turn")
    chosen = (
        named.select("lang", "turn")
        .distinct()
        .withColumn("nth", F.row_number().over(share))
        .filter(F.col("nth") <= sample_per_class)
        .withColumn("nth", F.row_number().over(whole))
        .filter(F.col("nth") <= sample_per_class)
        .groupBy("lang")
        .agg(F.max("turn").alias("last"))
    )
    bars = {r.lang: r.last for r in chosen.collect()}  # one row a language
    classes = sorted(bars)
    if not classes:
        return LanguageModel([], bits, idf, np.zeros((1 << bits, 0)), 1.0)
    below = functools.reduce(
        lambda a, b: a | b, [(F.col("lang") == c) & (F.col("turn") <= F.lit(bars[c])) for c in classes]
    )
    sample = (
        named.filter(below)
        .groupBy("lang", "turn")  # copies of a row count once, before they are sent
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .mapInArrow(functools.partial(_features, bits), "lang string, turn long, at binary, counts binary")
        .collect()
    )
    number = {c: i for i, c in enumerate(classes)}
    data = []
    for r in sorted(sample, key=lambda r: (r.turn, r.lang, bytes(r.at))):
        at = np.frombuffer(r.at, "<i4")
        if len(at):
            data.append((at, tf_idf(at, np.frombuffer(r.counts, "<f4").astype(np.float64), idf), number[r.lang]))
    held = int(len(data) * calibrate_share)
    train_rows, held_rows = data[held:], data[:held]
    model = Ftrl(1 << bits, len(classes))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(train_rows)):
            model.learn(*train_rows[i])
    weights = model.weights()
    heat = 1.0
    if held_rows:
        logits = np.array([x @ weights[at] for at, x, _ in held_rows])
        heat = temperature(logits, np.array([label for _, _, label in held_rows]))
    return LanguageModel(classes, bits, idf, weights, heat)


@giving_back
def _predict(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model.value
    for part, texts in text_groups(batches):
        found = [model.predict(t) for t in texts]
        columns = [c for name, c in zip(part.schema.names, part.columns) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=[n for n in part.schema.names if n != "text"] + ["lang_pred", "score"],
        )


def predict(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row, from its text alone."""
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 ** bits by languages
    return rows.mapInArrow(functools.partial(_predict, shared), f"`{key}` {kind}, lang_pred string, score double")


@giving_back
def _keep(model, column: str, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model.value
    for part, texts in text_groups(batches, column):
        judged = [model.predict(t) for t in texts]
        yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in judged], pa.bool_()))


def keep_known(docs: DataFrame, model: LanguageModel, *, text: str = "text", least: float = 0.0) -> DataFrame:
    """Rows of ``docs`` whose language is known, with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(functools.partial(_keep, shared, text, least), docs.schema)
