"""What is sent, sampled and kept, and every column of the thin queries."""

import hashlib
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportloom.llm import jaccard, language, queries, secret_scan

from .fixtures import documents, texts
from .test_texts import all_spans

FOLDER = "/root/testdata/sf0.001"


def exchanged(monkeypatch, rows, buckets, chars=4000):
    """The classes of all blocks after one exchange, run in this process; the bytes sent."""
    monkeypatch.setattr(jaccard, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(rows))), "text": pa.array(rows)})
    sent = pd.concat([b.to_pandas() for b in jaccard._send(5, buckets, chars, iter([batch]))])
    size = sum(len(v) for c in sent.columns[3:] for v in sent[sent["key"] >= 0][c] if v is not None)
    answers = pd.concat([jaccard._answer(buckets, (k,), own.reset_index(drop=True)) for k, own in sent.groupby("key")])
    classes = [jaccard._classes(75, own.reset_index(drop=True)) for _, own in answers.groupby("block")]
    return pd.concat(classes), size


def some_texts():
    given = [t or "" for t in texts(3)]
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    given += [" ".join(rng.choice(words, 300)) for _ in range(200)]
    return given + [given[-1] + " x", given[-2] + " y"]


def test_what_is_sent_does_not_grow_with_the_ranges(monkeypatch):
    given = some_texts()
    seen, sizes = [], []
    for buckets in (10, 2500, 10_000):
        found, size = exchanged(monkeypatch, given, buckets, 400_000)
        sizes.append(size)
        seen.append(shape_of(found))
    assert all(s == seen[0] for s in seen)
    assert max(sizes) <= 1.1 * sizes[0]
    few = [*given[:12], given[0] + " end", given[3]]
    assert shape_of(exchanged(monkeypatch, few, 1)[0]) == shape_of(exchanged(monkeypatch, few, 1 << 17)[0])


def shape_of(found):
    """The classes and how often their shared shingles occur, whatever these are called."""
    names, shape = Counter(), []
    for r in found.sort_values(["n_shingles", "digest"], key=lambda c: c.map(str)).itertuples():
        shared = np.frombuffer(r.shared, "<u8").tolist() if r.shared else []
        shape.append((r.digest, r.n_shingles, tuple(r.doc_ids), len(shared)))
        names.update(shared)
    return shape, sorted(names.values())


def test_steps_of_any_width():
    for numbers in ([], [0], [0, 0, 3, 254, 509, 510, 5000, 5000], list(range(0, 100_000, 255))):
        assert jaccard._stepped(jaccard._steps(np.array(numbers, dtype=np.int64))).tolist() == numbers
    bits = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    buckets = 1 << 20
    high = [jaccard._high(int(b), buckets) for b in jaccard._bucket(bits, buckets)]
    assert high == (bits >> np.uint64(48)).tolist() and (jaccard._name(bits, buckets) == bits).all()


def test_other_texts_of_a_kept_id_stay(spark):
    same, other, third = "one two three four five six seven eight", "another text that nobody else has at all", "and one more of the same id here"
    rows = [(1, same, 1), (1, other, 2), (1, other, 3), (2, same, 4), (3, third, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect())
    assert kept == Counter({(1, same): 1, (1, other): 1, (3, third): 1})
    assert sorted(jaccard.keep_one(docs).collect()) == sorted(jaccard.keep_one(docs.orderBy(F.desc("n"))).collect())


def test_redacting_leaves_the_users_columns(spark):
    docs = spark.createDataFrame([(1, "token=q8Zk3LmP0xVb7Rt2Yw9N", 5, "z"), (2, None, None, None)], "doc_id int, text string, spans int, secret_spans_0 string")
    clean = secret_scan.redact(docs)
    assert clean.schema == docs.schema
    assert sorted(map(tuple, clean.collect())) == [(1, "[secret]", 5, "z"), (2, None, None, None)]


def test_the_sample_is_bounded(spark, monkeypatch):
    learned = []

    class Counting(language.Ftrl):
        def learn(self, at, x, label):
            learned.append(label)
            super().learn(at, x, label)

    monkeypatch.setattr(language, "Ftrl", Counting)
    rows = [(i, t, lang) for i in range(40) for lang, t in (("a", "some words here"), ("b", "andere hier sind"))] * 30
    rows += [(None, "no id", "a")] * 500 + [(1, "a second text of the same id", "a")] * 20 + [(100, "rare", "c")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(7)
    model = language.fit(docs, F.lit(True), sample_per_class=10, epochs=1, calibrate_share=0.0)
    assert Counter(learned) == {0: 10, 1: 10, 2: 1} and model.classes == ["a", "b", "c"]
    again = language.fit(docs.repartition(3), F.lit(True), sample_per_class=10, epochs=1, calibrate_share=0.0)
    assert np.array_equal(model.weights, again.weights)


def plain_ftrl(rows, features, classes, alpha, beta, l1, l2):
    """Follow the regularised leader, a weight at a time."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weight(i, k):
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * l1) / ((beta + np.sqrt(n[i, k])) / alpha + l2)

    for at, x, label in rows:
        w = np.array([[weight(i, k) for k in range(classes)] for i in at])
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        for k in range(classes):
            miss = p[k] - (k == label)
            for j, i in enumerate(at):
                g = miss * x[j]
                sigma = (np.sqrt(n[i, k] + g * g) - np.sqrt(n[i, k])) / alpha
                z[i, k] += g - sigma * w[j, k]
                n[i, k] += g * g
    return np.array([[weight(i, k) for k in range(classes)] for i in range(features)])


def test_the_learner_is_the_plain_one():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        at = np.sort(rng.choice(20, 6, replace=False))
        rows.append((at, rng.random(6), int(rng.integers(3))))
    model = language.Ftrl(20, 3)
    for r in rows:
        model.learn(*r)
    options = {k: getattr(model, k) for k in ("alpha", "beta", "l1", "l2")}
    assert np.allclose(model.weights(), plain_ftrl(rows, 20, 3, **options))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def test_every_column_of_the_secret_query(spark, docs):
    found = queries.op8_secret_scan(spark, FOLDER).collect()
    assert sum(r.n_assign + r.n_access + r.n_hex for r in found) > 0
    for r in found:
        spans = [s for s in all_spans(docs[r.doc_id]).split(",") if s]
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        kinds = Counter(s.split(":")[0] for s in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans == ",".join(spans)


@pytest.mark.parametrize("name,folds", [("op3_language_id", 5), ("op9_lattice_score", 10)])
def test_held_out_rows(spark, docs, name, folds):
    found = queries.QUERIES[name](spark, FOLDER).collect()
    assert {r.doc_id: r.held_out for r in found} == {d: fold(d, folds) for d in docs}


def test_word_scores_of_the_score_query(spark, docs):
    words = {d: [w.decode() for w in t.encode().lower().split()] for d, t in docs.items()}
    counts, ends = Counter(), 0
    for d, own in words.items():
        if not fold(d, 10):
            counts.update(own)
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    for r in queries.op9_lattice_score(spark, FOLDER).collect():
        own = words[r.doc_id]
        seen = [counts[w] for w in own] + [ends]
        want = sum(np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in seen)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own) + 1, sum(c > 0 for c in seen), total)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))


def test_the_last_block_of_a_source_is_cut_until_it_is_small(spark, monkeypatch):
    from reportloom.llm import mixing

    walked = []
    real = mixing._cut_again

    def seen(tail, held, *rest):
        out = real(tail, held, *rest)
        walked.append((held, out[1]))
        return out

    monkeypatch.setattr(mixing, "_cut_again", seen)
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 20 + 1).cast("int")), " ").alias("text"),
    )
    found = mixing.draws(rows, block_words=60, max_blocks=4, shards=4).collect()
    assert len(walked) >= 3 and all(w <= 60 for w in walked[-1][1].values())
    for source in ("a", "b", None):
        own = [r for r in found if r.source == source]
        assert len(own) == 2000
        taken = sum(r.size * len(r.shards) for r in own)
        assert abs(taken - own[0].target) <= 20  # a document, however large the blocks
    again = mixing.draws(rows.repartition(5), block_words=60, max_blocks=4, shards=4).collect()
    assert sorted((r.id, r.shards) for r in again) == sorted((r.id, r.shards) for r in found)
    # One id that holds all of a block cannot be cut.
    same = spark.range(500).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("a").alias("source"))
    assert mixing.draws(same.unionByName(rows.limit(5)), block_words=10, max_blocks=4, shards=2).count() > 0


def test_mixing_leaves_the_users_columns(spark):
    from reportloom.llm import mixing

    docs = documents(spark).withColumnsRenamed({"size": "mix_words", "spans": "mixedid", "row": "mix_shard"})
    mixed = mixing.mix(docs, block_words=300, shards=4)
    assert mixed.columns == [c for c in docs.columns if c != "mix_shard"] + ["mix_copy", "mix_shard", "mix_order"]
    assert {(r.mix_words, r.mixedid) for r in mixed.collect()} <= {("s", 1), (None, None)}


def test_draws_are_split_as_they_would_fall(spark):
    from reportloom.llm.mixing import split_tree

    quotas, shards, rng = np.array([12, 5, 3], dtype=np.int64), 4, np.random.default_rng(2)
    found = np.array([split_tree(quotas, shards, rng) for _ in range(4000)])
    assert (found.sum(axis=1) == quotas).all() and (found.sum(axis=2) == 5).all()
    # Each shard's draws of a source are hypergeometric: their mean and variance, and how sources compete.
    total, take = quotas.sum(), 5
    for i, have in enumerate(quotas):
        mean = take * have / total
        var = mean * (1 - have / total) * (total - take) / (total - 1)
        assert np.allclose(found[:, :, i].mean(axis=0), mean, atol=0.08) and np.allclose(found[:, :, i].var(axis=0), var, atol=0.12)
    cov = -take * 12 * 5 / total**2 * (total - take) / (total - 1)
    assert abs(np.cov(found[:, 0, 0], found[:, 0, 1])[0, 1] - cov) < 0.1


def walked_chunks(raw):
    """Chunk ends found byte by byte."""
    from reportloom.llm import chunks

    out, start = [], 0
    for end in range(1, len(raw) + 1):
        h = 0
        for b in raw[max(0, end - 32) : end]:  # what came earlier has left the 32 bits
            h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        size, last = end - start, end == len(raw)
        bar = 0 if size < chunks.LEAST else chunks._STRICT if size < chunks.NORMAL else chunks._LOOSE
        if h < bar or size == chunks.MOST or last:
            out.append(end)
            start = end
    return out


def test_chunks_are_those_of_a_walk_over_the_bytes():
    from reportloom.llm import chunks

    rng = np.random.default_rng(6)
    given = [b"", b"a", b"abcdefgh", bytes(300), bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), "é日本 ".encode() * 200]
    given += [(t or "").encode() for t in texts(5)[:40]]
    for raw in given:
        assert chunks.boundaries(raw) == walked_chunks(raw)
        found = {raw[a:b] for a, b in zip([0, *walked_chunks(raw)], walked_chunks(raw))}
        own = chunks.fingerprint(raw.decode("latin-1")) if raw.isascii() else None
        if own is not None:
            assert sorted(int(x) & 0xFFFF for x in own) == sorted(map(len, found))
