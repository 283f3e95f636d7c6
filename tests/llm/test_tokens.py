"""Token counts, packing and token files against the tokenizers library."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reportloom.llm import packing, repair, vocab
from reportloom.llm.token_counts import MergeCounter, token_counts
from reportloom.llm.vocab import PieceEncoder

from .fixtures import documents, empty, texts

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts(n=3000):
    rnd = random.Random(3)
    some = [" ", "  ", "\n", "\t", "a", "B", "é", "12", "'s", "<|endoftext|>", "!", ".", "日", "\x1c", "\0", "\x01", "İ", "Σ"]
    any_of = lambda: chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(32, 126), rnd.randint(1, 0xD7FF)]))
    return ["".join(rnd.choice([rnd.choice(some), any_of()]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def library(path, given):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in given], add_special_tokens=False)
    return [np.array(e.ids, dtype="<u4") for e in found]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path):
    given = odd_texts() + [t or "" for t in texts()]
    assert PieceEncoder(path).ids(given) == [x.tobytes() for x in library(path, given)]


def test_merging_counts_as_the_library():
    given, counter = odd_texts() + [t or "" for t in texts()], MergeCounter(BYTES)
    want = [len(x) for x in library(BYTES, given)]
    assert [counter.count(t) for t in given] == want
    assert counter.counts(pa.array(given)).tolist() == want == counter.counts(pa.array(given)).tolist()


def test_token_counts_of_odd_rows(spark):
    docs = documents(spark)
    rows = token_counts(docs, BYTES).collect()
    given = [r.text or "" for r in docs.collect()]
    want = sorted((len(t.encode()), len(x)) for t, x in zip(given, library(BYTES, given)))
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert token_counts(empty(spark), BYTES).count() == 0


def test_plan_uses_every_piece_once_and_comes_near_the_least():
    rng, size = np.random.default_rng(1), 256
    for n in (0, 1, 40, 20_000):
        counts = np.bincount(np.clip(rng.lognormal(4, 1, n).astype(int), 1, size), minlength=size + 1)
        configs, used = packing.plan(counts, steps=60), np.zeros(size + 1, dtype=int)
        for config, many in configs:
            assert sum(config) <= size and many > 0
            np.add.at(used, list(config), many)
        assert (used == counts).all()
        made, least = sum(m for _, m in configs), -(-(counts @ np.arange(size + 1)) // size)
        assert made <= max(least * 1.05, sum(m for _, m in packing.best_fit(counts)))


def test_the_program_places_nearly_all_pieces_near_its_bound():
    rng, size = np.random.default_rng(6), 512
    for lengths in (rng.lognormal(5, 1, 200_000), rng.integers(1, size + 1, 200_000)):
        counts = np.bincount(np.clip(lengths.astype(int), 1, size), minlength=size + 1)
        placed_late, best_fit = [], packing.best_fit
        try:
            packing.best_fit = lambda left: placed_late.append(left.sum()) or best_fit(left)
            configs = packing.plan(counts)
        finally:
            packing.best_fit = best_fit
        assert placed_late[-1] <= 0.02 * counts.sum()
        volume = counts @ np.arange(size + 1) / size
        assert sum(many for _, many in configs) <= (1 + packing.GAP) * volume + 1
    # The volume is no good bound here: two of the long ones never share a sequence.
    counts = np.zeros(101, dtype=int)
    counts[60], counts[45] = 5000, 1000
    price = np.zeros(101)
    price[60], price[45] = 1.0, 0.5
    assert packing.solve(counts, price, 300)[2] == sum(many for _, many in packing.plan(counts)) == 5500


def test_dearest_is_the_best_knapsack():
    rng = np.random.default_rng(2)
    for _ in range(20):
        price = rng.random(31) * (rng.random(31) < 0.4)
        best = np.zeros(31)
        for room in range(1, 31):
            best[room] = max([best[room - 1], *(price[n] + best[room - n] for n in range(1, room + 1))])
        found = packing.dearest(price)
        assert sum(found) <= 30 and sum(price[found]) == pytest.approx(best[30])


def test_packing_of_odd_rows(spark):
    docs = documents(spark)
    rows = packing.pack_documents(docs, WORDS, capacity=64, steps=30).collect()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for (doc, _), ids in zip(given, library(WORDS, [t for _, t in given])):
        ids = np.append(ids, np.uint32(0)).astype("<u4")
        want += [(doc, k, 64 * k, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 64)) for p in [ids[64 * k : 64 * k + 64]]]
    key = lambda r: tuple((x is None, x or 0) for x in r[:5])
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty(spark), WORDS, steps=5).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 90, rng.integers(1, 7)) for _ in range(40)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 40, rng.integers(1, 60))]).astype(np.uint32) for _ in range(50)]
    docs += [np.zeros(1, np.uint32), np.full(500, 7, np.uint32)]
    lengths = [np.array([len(d) for d in docs])]
    shard = repair._shard(0, 0, list(range(len(docs))), lengths, docs, 100, {"least": 3})
    assert len(shard["symbols"]) < 4 * sum(map(len, docs)) and len(shard["rules"])
    rules, symbols = (np.frombuffer(shard[c], "<u4") for c in ("rules", "symbols"))
    whole = np.concatenate(docs).astype("<u4")
    sizes = np.frombuffer(shard["sizes"], "<i8")
    assert (repair.expand(symbols, rules.reshape(-1, 2), 100, sizes) == whole).all()
    assert (repair.expand(symbols, rules.reshape(-1, 2), 100) == whole).all()
    for k, doc in enumerate(docs):
        assert (repair.read_ids(shard, k) == doc).all()
        a, b = sorted(rng.integers(0, len(doc) + 1, 2))
        assert (repair.read_ids(shard, k, int(a), int(b)) == doc[a:b]).all()


def test_grammar_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 5000, 1000)
    parts = [np.concatenate([rng.integers(0, 5000, 3), passage, rng.integers(0, 5000, 3), [5000]]) for _ in range(300)]
    parts += [np.append(np.full(20_000, 7), 5000), rng.integers(0, 5000, 2000), rng.integers(0, 3, 5000)]
    ids = np.concatenate(parts).astype(np.uint32)
    ends = np.zeros(len(ids), dtype=bool)
    ends[np.cumsum([len(p) for p in parts]) - 1] = True
    symbols, marks, rules, sizes = repair.compress(ids, ends, 5001, least=6)
    assert (repair.expand(symbols, rules, 5001, sizes) == ids).all() and marks.sum() == len(parts)
    assert sizes.max() >= 1000  # the passage is one symbol, and so is most of the run
    copies = np.diff(np.concatenate([[0], np.flatnonzero(marks) + 1]))[:301]
    assert copies[:300].max() <= 3 + 1 + 3 + 1 and copies[300] <= 50
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)
    seen, last = {}, None
    for k in np.flatnonzero(~marks[:-1]):
        pair = (symbols[k], symbols[k + 1])
        if last == (k - 1, pair):  # of three equal symbols two are a pair
            last = None
            continue
        seen[pair], last = seen.get(pair, 0) + 1, (k, pair)
    assert max(seen.values()) < 6


def test_places_of_rare_pairs_are_sieved_before_sorting():
    rng = np.random.default_rng(6)
    symbols = rng.integers(0, 1 << 16, 200_000).astype(np.uint32)
    symbols[1000:1020] = np.tile([70_000, 70_001], 10)
    at, rank_at = np.arange(len(symbols) - 1), np.full(len(symbols) + 2, repair._NEVER)
    found, follow, other, pairs = repair._frequent(symbols, None, at, 6, rank_at, True)
    assert 20 <= len(found) < len(at) / 20 and (follow == found + 1).all() and not len(other)
    assert pairs.tolist() == [70_000 << 32 | 70_001, 70_001 << 32 | 70_000]
    assert (np.flatnonzero(rank_at < repair._NEVER) == np.arange(1001, 1020)).all()


def test_grammar_is_the_same_for_symbols_too_wide_to_pack():
    rng = np.random.default_rng(7)
    ids = np.repeat(rng.integers(0, 30, 3000), rng.integers(1, 6, 3000)).astype(np.uint32)
    ends = rng.random(len(ids)) < 0.01
    low, high = (repair.compress(ids, ends, base) for base in (30, 1 << 31))
    assert (low[1] == high[1]).all() and (low[3] == high[3]).all() and len(low[2]) > 30
    for a, b in zip(low[::2], high[::2]):
        assert (np.where(a < 30, a, a + np.uint32((1 << 31) - 30)) == b).all()


def test_byte_level_pieces_share_the_bytes_of_the_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choices("aZ .,é×÷Øɏɐ\n!?À;ı汉🙂1'\x01\x80¿", k=rng.randint(0, 14))) for _ in range(3000)]
    given = pa.array(texts + ["", "a,b\nc d", " x"])
    given = given.filter(vocab.byte_level_fits(given, []))
    marked = [re.sub(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])|(?= )|(?=\n)|(?<=\n)", "\0", t).split("\0") for t in given.to_pylist()]
    for part, want in ((given, marked), (given.slice(7, 900), marked[7:907]), (given.slice(3, 0), []), (pa.array(["", ""]), [[""]] * 2)):
        pieces = vocab.cut_byte_level(part)
        assert pieces.to_pylist() == [[p for p in w if p] for w in want]
    assert vocab.cut_byte_level(given).values.buffers()[2].address == given.buffers()[2].address
    assert [np.frombuffer(i, "<u4").tolist() for i in vocab.encoder(BYTES).ids(texts)] == [list(i) for i in library(BYTES, texts)]


def test_token_files_of_odd_rows(spark, tmp_path):
    docs, path = documents(spark), str(tmp_path / "ids")
    repair.write_ids(docs, BYTES, path, shard_ids=500)
    rows = repair.read_summary(spark, path).collect()
    assert spark.read.parquet(path).count() > 2
    given = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    found = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in found] == [d for d, _ in given]
    start, want = 0, {}
    for (doc, _), ids in zip(given, library(BYTES, [t for _, t in given])):
        want.setdefault(doc, []).append((len(ids) + 1, zlib.crc32(np.append(ids, np.uint32(0)).astype("<u4").tobytes())))
    for r in found:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    repair.write_ids(empty(spark), BYTES, path + "-none")
    assert repair.read_summary(spark, path + "-none").count() == 0
