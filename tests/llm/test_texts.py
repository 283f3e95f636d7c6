"""Joins, fingerprints, secrets, languages, scores and mixes against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reportloom.llm import chunks, jaccard, language, lattice, mixing, neighbours, secret_scan
from reportloom.llm.graph import components

from .fixtures import documents, empty

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return (text or "").encode().lower().split()


def shingle_sets(rows):
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(r.text)) else frozenset() for r in rows]


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500, "block_chars": 2000, "task_classes": 3, "task_shingles": 200}])
def test_join_finds_every_link(spark, options):
    docs = documents(spark)
    rows = docs.collect()
    sets, parent = shingle_sets(rows), {r.doc_id: r.doc_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b, ids = sets[j], (rows[i].doc_id, rows[j].doc_id)
            if a and b and None not in ids and 100 * len(a & b) >= 75 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted(map(root, ids))
                parent[y] = x
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((r.doc_id, len(s), None if r.doc_id is None else root(r.doc_id), links[i]) for i, (r, s) in enumerate(zip(rows, sets))), key=key)
    found = jaccard.join(docs, **options).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, found), key=key) == want
    kept = Counter(r.doc_id for r in jaccard.keep_one(docs, **options).collect())
    assert kept == Counter({None: 2}) + Counter({d for d in parent if d is not None and root(d) == d})


def test_join_of_nothing(spark):
    assert jaccard.join(empty(spark)).count() == 0
    assert jaccard.keep_one(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_chunks_cover_the_text_and_resist_shifts():
    rng = np.random.default_rng(5)
    raw = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    ends = chunks.boundaries(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= chunks.MOST and sizes[:-1].min() >= chunks.LEAST
    a, b = (chunks.fingerprint(t.decode()) for t in (raw, b"shifted by this" + raw))
    assert chunks.likeness(a, b) > 0.97 and chunks.likeness(a, chunks.fingerprint("other text")) == 0
    assert (chunks.parsed(chunks.spelled(a)) == a).all()
    assert chunks.likeness(a[:0], a[:0]) == 1 and chunks.likeness(a, a[:0]) == 0


@pytest.mark.parametrize("range_bytes", [8_000_000, 300])
def test_rows_are_compared_with_the_next(spark, range_bytes):
    docs = documents(spark).dropDuplicates(["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    found = chunks.compare_with_next(docs, range_bytes=range_bytes).collect()
    found.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    for i, r in enumerate(found):
        text, after = rows[i].text or "", rows[(i + 1) % len(rows)].text or ""
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, new, other = map(chunks.fingerprint, (text, changed, after))
        assert (r.fingerprint, r.edited_fingerprint) == (chunks.spelled(own), chunks.spelled(new))
        assert (r.near_edited, r.near_next) == (chunks.likeness(own, new), chunks.likeness(own, other))
    assert chunks.compare_with_next(empty(spark)).count() == 0
    assert chunks.compare_with_next(documents(spark), range_bytes=300).count() == documents(spark).count()
    assert chunks.compare_with_next(docs.filter("doc_id = 0")).first().near_next == 1


def entropy_spans(text):
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        value = m.group()
        if any(re.search(a, value) for a in secret_scan.ALLOWED):
            continue
        kind, least = next((k, t) for k, (p, t) in secret_scan.CLASSES.items() if re.search(p, value))
        spans = []
        for i in range(len(value) - secret_scan.WINDOW + 1):
            window = Counter(value[i : i + secret_scan.WINDOW])
            bits = -sum(c / secret_scan.WINDOW * math.log2(c / secret_scan.WINDOW) for c in window.values())
            if bits >= least - 1e-9:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + secret_scan.WINDOW
                else:
                    spans.append([i, i + secret_scan.WINDOW])
        out += [(m.start() + a, secret_scan.KINDS.index(f"entropy_{kind}"), m.start() + b) for a, b in spans]
    return out


def all_spans(text):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out + entropy_spans(text)))


def test_secrets_as_by_hand(spark):
    import random

    rnd = random.Random(5)
    some = ["token", "Secret", "=", ":", " ", '"', "api_key", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef"]
    some += ["é", "日", "\n", "x9K/", "aB3", "passwd", "==", "ſecret", "apiKey", "😀", "9f8e7d6c5b4a39281706"]
    given = ["".join(rnd.choices(some, k=rnd.randint(0, 50))) for _ in range(400)] + ["", None, "token=secret: abcdefghijklmnop"]
    given += [" ".join(["token=q8Zk3LmP0xVb7Rt2Yw9N"] * 300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(given)], "doc_id long, text string, spans int")
    found = {r.doc_id: r.s for r in secret_scan.scan(docs).select("doc_id", secret_scan.spelled(F.col("spans")).alias("s")).collect()}
    assert found == {i: all_spans(t or "") for i, t in enumerate(given)}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    for i, text in enumerate(given):
        at, want = 0, []
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in found[i].split(",") if s)
        for a, b in spans:
            if a >= at:
                want += [text[at:a], "[secret]"]
            at = max(at, b)
        assert clean[i] == (None if text is None else "".join(want) + text[at:])
    assert secret_scan.scan(empty(spark)).count() == 0 == secret_scan.redact(empty(spark)).count()
    assert "Python" not in secret_scan.scan(docs)._jdf.queryExecution().toString()


def test_the_allow_list_hides_no_key_beside_it(spark):
    key, letters = "q8Zk3LmP0xVb7Rt2Yw9N", "qGZkWLmPcxVbJRtdYwhN"
    found = ["api/sample/" + key, "example-key=" + key, key + "_dummy", "2024-01-31/" + key, letters, "key_" + letters]
    plain = ["internationalizationOfUserInterfaces", "path/to/some/example/file-name", "your-api-key-goes-right-here-1"]
    plain += ["example_" + key[:10], "EXAMPLE" + key, "abcdefghijklmnopqrstuvwxyz0123456789", "2024-01-31_2024-02-28_00"]
    docs = spark.createDataFrame(list(enumerate(found + plain)), "doc_id int, text string")
    rows = secret_scan.scan(docs).select("doc_id", "text", "spans").collect()
    for r in rows:
        spans = [(s.start, s.end) for s in r.spans if s.kind.startswith("entropy")]
        secret = next((k for k in (key, letters) if k in r.text), None) if r.doc_id < len(found) else None
        at = r.text.find(secret) if secret else None
        assert any(a <= at and at + len(secret) <= b for a, b in spans) if secret else not spans, r.text


def test_language_of_odd_rows_and_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = language.fit(table, train, sample_per_class=150)
    found = language.predict(table, model).join(table, "doc_id").filter(~train).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert np.mean([r.score for r in found]) > 0.9 and all(0 <= r.score <= 1 for r in found)
    docs = documents(spark)
    odd = {r.doc_id: r for r in language.predict(docs.dropDuplicates(["doc_id"]), model).collect()}
    for r in docs.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        if r.doc_id is not None:
            assert (odd[r.doc_id].lang_pred != "und") == lettered
    kept = language.keep_known(docs, model).collect()
    assert len(kept) == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    nothing = language.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_online_learner_is_sparse_and_calibrated():
    rng, model = np.random.default_rng(1), language.Ftrl(50, 2, l1=0.5)
    for _ in range(400):
        label = int(rng.integers(2))
        model.learn(np.array([label, int(rng.integers(10, 50))]), np.array([1.0, 0.3]), label)
    weights = model.weights()
    assert weights[0, 0] > 0 > weights[1, 0] and (weights[10:] == 0).mean() > 0.5
    logits = rng.standard_normal((5000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits / 2.5)])
    assert language.temperature(logits, labels) == pytest.approx(2.5, rel=0.15)


def test_scores_of_odd_rows(spark):
    docs = documents(spark)
    train = F.col("doc_id") % 10 != 0
    found = lattice.score(docs, PIECES, train, bucket_bytes=2000, block_chars=3000).collect()
    rows, counts, model = docs.collect(), Counter(), lattice.Lattice(PIECES)
    for r in rows:
        if r.doc_id is not None and r.doc_id % 10:
            counts.update([*words(r.text), None])
    n, v, want = sum(counts.values()), len(counts), []
    for r in rows:
        own = [*words(r.text), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        full = model.words([w.decode() for w in own[:-1]]).sum() + model.end
        want.append((r.doc_id, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6), round(full, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert lattice.score(empty(spark), PIECES, train).count() == 0


def test_a_learned_lattice_fits_texts_it_has_not_seen(spark):
    stems = ["inter", "anti", "over", "pre", "trans", "sub", "auto", "micro"]
    tails = ["formation", "graphic", "national", "stellar", "active", "marine", "mission", "scope"]
    made = [(i, " ".join(stems[(i + k) % 8] + tails[i * (k + 1) % 7] + " the" * 3 for k in range(9))) for i in range(200)]
    made += [(203, None), (204, "\x00\u65e5 " + "q" * 900), (None, "autoscope")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    train = F.col("doc_id") % 10 != 0
    plain, learned = (
        {r.doc_id: r for r in lattice.score(docs, PIECES, train, rounds=n, bucket_bytes=3000, block_chars=3000).collect()}
        for n in (0, 3)
    )
    assert len(learned) == len(made) and all(math.isfinite(r.score) for r in learned.values())
    held = [r for i, r in learned.items() if i is not None and i < 200 and not r.learned]
    assert sum(r.score for r in held) > 1.15 * sum(r.base_score for r in held)
    assert all(r.score > 0.5 * plain[r.doc_id].score for r in held)
    nothing = lattice.score(docs, PIECES, F.lit(False), rounds=2).collect()
    assert all(math.isfinite(r.score) for r in nothing) and len(nothing) == len(made)
    assert lattice.score(empty(spark), PIECES, train, rounds=2).count() == 0


def test_expected_pieces_add_up_to_the_words():
    model = lattice.Lattice(PIECES)
    counts = model.expected(["the", "thontiwh", "hello,"], model.scores)
    sizes = np.array([len(p) for p in model.pieces])
    assert float(counts @ sizes) == pytest.approx(len("_the_thontiwh_hello,"), abs=1e-6)


def test_lattice_adds_up_all_segmentations():
    import sentencepiece

    model, vocabulary = lattice.Lattice(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [i for i in range(32000) if not (vocabulary.is_byte(i) or vocabulary.is_control(i) or vocabulary.is_unknown(i))]
    share = {i: 1 / (2.7 - vocabulary.get_score(i)) for i in [*plain, 2]}
    total = sum(share.values())
    known = {vocabulary.id_to_piece(i): (1 - 1e-3) * share[i] / total for i in plain}

    def probability(word):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, len(word) + 1):
            p = known.get(word[:k]) or ((1e-3 / 256) ** len(word[:1].encode()) if k == 1 else 0)
            out += p and p * probability(word[k:])
        return out

    given = ["the", "thontiwh", "é日", "a", "hello,", "𐍈b"]
    assert model.words(given) == pytest.approx([math.log10(probability("▁" + w)) for w in given])


def test_targets_and_tree():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    capped = mixing.targets([100, 0, 1], [1, 2, 3])
    assert capped == pytest.approx([98, 0, 3]) and sum(capped) == pytest.approx(101)
    quotas = np.array([7, 0, 100, 3])
    leaves = mixing.split_tree(quotas, 5, np.random.default_rng(1))
    assert leaves.shape == (5, 4) and (leaves.sum(axis=0) == quotas).all() and np.ptp(leaves.sum(axis=1)) <= 1


def test_mix_of_odd_rows(spark):
    docs = documents(spark)
    rows = docs.collect()
    drawn = mixing.draws(docs, block_words=300, shards=4).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [1, 2, 3, 1])))
    taken = Counter()
    assert sum(r.copies_of for r in drawn) == len(rows)
    for r in drawn:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and len(r.shards) <= 3
        taken[r.source] += r.size * r.copies_of * len(r.shards)
    for s in names:
        longest = max(r.size * r.copies_of for r in drawn if r.source == s)
        assert abs(goal[s] - taken[s]) <= longest / 2
    again = mixing.draws(docs.repartition(7), block_words=300, shards=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn))
    mixed = mixing.mix(docs, block_words=300, shards=4)
    assert mixed.count() == sum(r.copies_of * len(r.shards) for r in drawn) and mixed.columns[:10] == docs.columns
    assert mixing.draws(empty(spark)).count() == 0 == mixing.mix(empty(spark)).count()


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((10, 32))
    vectors = [(i, (centres[i % 10] + rng.standard_normal(32)).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[0][1]) for i in range(8)] + [vectors[50]]
    odd = [(700, None), (750, [0.0] * 32), (800, [float("nan")] * 32), (850, [None] * 32), (900, []), (None, [1.0] * 32)]
    odd += [(950, [1.0, 2.0]), (951, [2.0, 4.0])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1))
    found = neighbours.search(table, F.col("vec_id") % 50 == 0, shard_entries=500).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x, ids = np.array([v for _, v in vectors]), np.array([i for i, _ in vectors])
    norm, hits = np.sqrt((x * x).sum(axis=1)), 0
    queries = [i for i in dict.fromkeys(ids.tolist()) if i % 50 == 0]
    for q in queries:
        k = int(np.flatnonzero(ids == q)[0])
        score = dict(zip(ids.tolist(), x @ x[k] / (norm * norm[k])))
        best = sorted((i for i in score if i != q), key=lambda i: (-score[i], i))[:5]
        hits += len(set(best) & {i for i, _ in by[q]})
        assert [s for _, s in by[q]] == pytest.approx([score[i] for i, _ in by[q]]) and len(by[q]) == 5
    assert hits / (5 * len(queries)) >= 0.9
    assert [i for i, _ in by[0]] == [600, 601, 602, 603, 604]
    assert by[950] == [(951, pytest.approx(1))] and set(by) == {*queries, 950}
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0


def test_probes_come_in_order_and_cross_no_cell_twice():
    template = neighbours.probe_template(4, 60)
    assert template[0] == () and template[1] == (0,) and len(set(template)) == 60
    assert all(7 - r not in s for s in template for r in s)


def test_fixed_folds():
    assert zlib.crc32(b"7") % 5 != 0  # as crc32 of the id as text in the queries
