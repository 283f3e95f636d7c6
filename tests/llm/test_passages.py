"""Decontamination, spelling variants and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.llm import decontaminate, periodic, queries, spelling

from .fixtures import documents, empty

ITEMS = "item_id long, text string, lang int, leak string"


def item_rows(rows):
    """Items cut from the documents, and every odd one."""
    texts = [r.text for r in rows if r.text]
    long = max(texts, key=lambda t: len(t.split()))
    given = [" ".join(texts[i].split()[2:20]).upper() for i in range(0, 40, 7)]
    given += ["  The, OF  and!", "é日本 ß", "", " !? ", None, "nowhere to be found in any of these texts at all ever", long + " x"]
    out = [(i, t, 1, "x") for i, t in enumerate(given)]
    return out + [out[0], (None, given[1], 1, None), (3, given[0], 1, None)]  # again, without id, a second text


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def normal(text):
    return re.findall(decontaminate.WORD, lower(text))


def brute_hits(text, items, window):
    own, hit, names = normal(text), set(), set()
    for item, body, *_ in items:
        words = normal(body)
        size = min(window, len(words))
        held = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in held:
                hit |= set(range(i, i + size))
                names |= {str(item)} - {"None"}
    return len(own), hit, sorted(names)


@pytest.mark.parametrize("options", [{}, {"window": 4, "broadcast_bytes": 9000, "chars": 500}])
def test_every_hit_word_is_found(spark, options, monkeypatch):
    monkeypatch.setattr(decontaminate, "_PIECE", 50)
    docs = documents(spark)
    rows = docs.collect()
    items = item_rows(rows)
    table = spark.createDataFrame(items, ITEMS)
    window = options.get("window", 10)
    want = []
    for r in rows:
        n, hit, names = brute_hits(r.text, items, window)
        spans = [m.span() for m in re.finditer(decontaminate.WORD, lower(r.text))]
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i + 1 for i in sorted(hit) if i + 1 not in hit]
        want.append((r.doc_id, n, len(hit), list(zip(starts, ends)), [(spans[a][0], spans[b - 1][1]) for a, b in zip(starts, ends)], names))
    found = [
        (r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.words], [tuple(s) for s in r.spans], r.items)
        for r in decontaminate.scan(docs, table, **options).collect()
    ]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want) and any(not w[2] for w in want if w[1])
    clean = decontaminate.remove_spans(docs, table, mark="#", **options)
    assert clean.schema == docs.schema
    cut = Counter()
    for r, w in zip(rows, want):
        out, at = "", 0
        for a, b in w[4]:
            out, at = out + r.text[at:a] + "#", b
        cut[r.doc_id, None if r.text is None else out + r.text[at:], r.spans] += 1
    assert Counter((r.doc_id, r.text, r.spans) for r in clean.collect()) == cut
    kept = Counter(r.doc_id for r in decontaminate.drop_documents(docs, table, **options).collect())
    assert kept == Counter(w[0] for w in want if not w[2])
    some = decontaminate.drop_documents(docs, table, most=0.5, **options)
    assert Counter(r.doc_id for r in some.collect()) == Counter(w[0] for w in want if 2 * w[2] <= w[1])


def test_no_documents_no_items_and_taken_names(spark):
    docs, none = documents(spark), spark.createDataFrame([], ITEMS)
    assert decontaminate.scan(empty(spark), none).count() == 0
    assert decontaminate.scan(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    named = docs.withColumnsRenamed({"block": "LEAK", "row": "leak_0"})
    assert decontaminate.remove_spans(named, none).columns == named.columns
    assert decontaminate.drop_documents(named, none).count() == docs.count()


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, ratio=5):
    """Form, root and number of near words, by comparing all pairs."""
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= ratio * words[a] else None
    out = {}
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out[a] = (words[a], form[a], words.get(form[a]), root, len(near[a]))
    return out


def test_words_near_each_other(spark):
    rnd = random.Random(11)
    words = {}
    for k in range(60):
        w = "".join(rnd.choices("abñ", k=rnd.randint(6, 9)))
        words[w] = rnd.randint(5, 4000)
        for _ in range(rnd.randint(0, 6)):
            i, c = rnd.randrange(len(w)), rnd.choice("abñ")
            v = rnd.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, c + w])
            words.setdefault(v, rnd.choice([5, 6, 30, 800]))
    words |= {"a" * n: 5 ** (n % 7 + 1) for n in range(6, 14)}  # each the start of the next
    words |= {"x" * 400: 9, "x" * 399 + "y": 60, "x" * 200 + "z" + "x" * 200: 9, "q" * 700: 5}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.group_variants(table).collect()
    assert {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in found} == variants(words)
    pairs = [(r.word, r.near) for r in spelling.near_words(table).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_counted_words_of_odd_rows(spark):
    docs = documents(spark)
    rows = docs.collect()
    rows += spark.createDataFrame([(7, "Zürich ZÜRICH zürich× ÿÿÿÿÿÿ naïveté " * 3)], "doc_id long, text string").collect()
    docs = docs.select("doc_id", "text", "lang", "size").unionByName(
        spark.createDataFrame([tuple(rows[-1])], "doc_id long, text string"), allowMissingColumns=True
    )
    for alter in (None, queries.letter_lost):
        want = Counter()
        for r in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
                run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
                if alter and r.doc_id is not None:
                    h = zlib.crc32(f"{r.doc_id}:{run}".encode())
                    run = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += 1
        want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 2}
        found = spelling.count_words(docs, frequent=2, alter=alter, chars=300).collect()
        assert want and {r.word: r.n for r in found} == want
    none = spelling.count_words(empty(spark))
    assert none.count() == 0 == spelling.group_variants(none).count() == spelling.near_words(none).count()


def all_runs(words, least):
    """Maximal stretches by looking at every period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - start >= q and end - start + q >= least:
                out.setdefault((start, end + q), q)
            start = end + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences():
    rnd = random.Random(3)

    def nested(depth):
        if depth == 0 or rnd.random() < 0.2:
            return [rnd.randrange(3) for _ in range(rnd.randint(1, 4))]
        x = nested(depth - 1)
        if rnd.random() < 0.6:
            x = x * rnd.randint(2, 6)
            return x[: len(x) - rnd.randint(0, 3)][:700] or [0]
        return (x + nested(depth - 1))[:700]

    out = [[rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 90))] for _ in range(60)]
    out += [nested(4) + nested(4) + nested(3) for _ in range(120)]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    out += [b, [bin(i).count("1") & 1 for i in range(600)]]
    # Regions of one root that touch: a run of every fitting period lies across each border.
    out += [([0, 1] * 90 + [0]) * 3 + [0, 1] * 40, ([0, 0, 1] * 60 + [0]) * 2 + [0, 0, 1] * 50, ([0] * 70 + [1]) * 6 + [0] * 30]
    return out + [(list(range(30)) * 9 + list(range(7))) * 2 + list(range(30)) * 8, [], [5]]


def test_runs_of_every_period():
    given = sequences()
    found = periodic.runs_of([np.array(x, dtype=np.int64) for x in given], 12)
    assert [[tuple(map(int, r)) for r in rows] for rows in found] == [all_runs(x, 12) for x in given]
    assert max(r[2] for rows in found for r in rows) >= 96  # several scales took part


def test_runs_of_odd_rows(spark):
    docs = documents(spark)
    extra = [(500, "a b c  " * 40, "x"), (501, "stop " * 30, "x"), (None, "a b\n" * 20 + "c", "x")]
    docs = docs.withColumn("runs", F.lit("x")).unionByName(spark.createDataFrame(extra, "doc_id long, text string, runs string"), allowMissingColumns=True)
    want = []
    for r in docs.collect():
        own = (r.text or "").encode().split()
        runs = all_runs(own, 12)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((r.doc_id, len(own), runs, " ".join(w.decode() for i, w in enumerate(own) if i not in dropped)))
    for chars in (4_000_000, 200):
        found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.runs(docs, chars=chars).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
    assert periodic.runs(empty(spark)).count() == 0


def test_repeated_words_are_those_of_the_contract(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(
        spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(0), F.col("id") % 37)).alias("text"))
    )
    want, changed = Counter(), 0
    for r in docs.collect():
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        want[r.doc_id, " ".join(words)] += 1
    found = queries.words_repeated(docs).collect()
    assert Counter((r.doc_id, " ".join(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in found) == want and changed > 20


def test_digests_of_the_runs_query(spark):
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert any(r.n_runs for r in found.values())
    for r in found.values():
        assert (r.n_runs == 0) == (r.start is None) == (r.exponent_milli is None) == (r.runs_sha256 == none)
