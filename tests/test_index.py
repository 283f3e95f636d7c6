"""Text index and dictionary matching against plain scans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.functions import predicates as P
from reportloom.functions import text as T
from reportloom.operators import dictionary as D
from reportloom.operators import textindex as X


def gram(s):
    return int(X._grams(s)[0])


def test_what_patterns_require():
    abc, bcd, xyz = map(gram, ("abc", "bcd", "xyz"))
    assert X.required("ABCD") == ("and", (abc, bcd))
    assert X.required("abc|xyz") == ("or", (abc, xyz)) == X.required("(?:abc)|(?:xyz)")
    assert X.required("abc.{0,9}xyz") == ("and", (abc, xyz)) == X.required(r"abc\s+xyz") == X.required("(?:abc)+.*xyz")
    assert X.required("a(?:b|x)c") == ("or", (abc, gram("axc")))
    assert X.required(r"\babc\b") == abc == X.required("abc(?:xyz)?") == X.required("abc(?=d)?[xyz]{3}")
    for none in ("ab", "abc|x", "a.c", "[abc]{5}", "(?:abc)*", "", r"\p{L}abc", r"\Qabc\E", r"a\vbc", "abc(", "abc|"):
        assert X.required(none) is None
    assert X.required("STRASSE") == X.required("straße") and X.required("ΟΔΟΣ") == X.required("οδος")
    many = "(?:" + "|".join(f"{i}ab" for i in range(99)) + ")xyz"
    assert X.required(many)[0] == "and"  # the branch by itself, then what follows


def test_numbers_are_packed():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 60_000):
        numbers = np.sort(rng.choice(1 << X.BLOCK_BITS, n, replace=False))
        assert (X._decoded(X._encoded(numbers)) == numbers).all()
    assert len(X._encoded(np.arange(1000))) == 1000


WORDS = ["nodule", "No evidence of", "straße", "STRASSE", "lung", "ſcan", "scan", "Mass", "μ", "İstanbul", "e.g.", "C++", "x" * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 12))) for _ in range(150)] + [None, "", "ab", "\n\t", "lung " * 5000]
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)] + [(7, "lung nodule", 0), (7, "nothing", 1)]
    return spark.createDataFrame(rows, "id long, body string, row int").repartition(5)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return X.TextIndex.build(docs, str(tmp_path_factory.mktemp("index")), key="id", text="body", pairs=500)


PATTERNS = ["lung", "LUNG NODULE", "no evidence of.{0,20}mass|nodule lung", "scan (?:lung|mass)", "strasse", "straße", "istanbul", "x{50}"]
PATTERNS += [r"c\+\+", r"e\.g\. \w+", "ab", "", "not there at all", r"\Qe.g.\E", r"\bmass\b", "μ ſcan", "(?<!x)lung(?= lung)"]


@pytest.mark.parametrize("pattern", [*([p] for p in PATTERNS), ["lung nodule", "ab"], ["mass mass", "nodule scan"], []])
def test_search_equals_the_scan(docs, index, pattern):
    rows = lambda df: sorted(map(str, df.collect()))
    want = docs.filter(P.any_of([F.col("body").rlike(P.FLAGS + p) for p in pattern]))
    found = index.search(docs, pattern)
    assert rows(found) == rows(want) and found.schema == docs.schema


def test_share_that_is_read(docs, index):
    total = docs.count()
    read = lambda p: tuple(index.share_read([p]).first())
    assert read("not there at all") == (total, 0) and read("ab") == (total, total)
    matching = docs.filter(F.col("body").rlike(P.FLAGS + "istanbul")).count()
    assert matching <= read("istanbul")[1] < total
    few = index.candidates(["lung nodule"])
    assert "gram" in few._jdf.queryExecution().toString() and few.count() < total


def test_index_of_nothing(spark, docs, tmp_path):
    empty = X.TextIndex.build(docs.limit(0), str(tmp_path / "x"), key="id", text="body")
    assert empty.search(docs, "lung").count() == 0 == empty.search(docs.limit(0), "ab").count()


TERMS = ["lung", "Mass", "No", "no evidence", "nodule", "dul", "ng no", "scan", "strasse", "xx", "μ", "i", "C++", "of nodule"]


def test_spans_and_mentions_equal_those_of_patterns(docs):
    patterns = [P.literal(t) for t in TERMS]
    bare = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["negated"]))
    # The engine lowers the text before it matches, which may lengthen it by that one letter.
    plain = docs.filter(~F.coalesce(F.contains("body", F.lit("İ")), F.lit(False)))
    spans = D.with_spans(plain, TERMS, "body").select("row", "body", bare.alias("a"), T.match_spans(F.col("body"), patterns).alias("b"))
    for r in spans.collect():
        assert [tuple(s) for s in r.a] == [tuple(s) for s in r.b or []], r.body
    flags = D.with_positive(plain, TERMS, "body").select(
        "body", "positive", *[T.positive_mention(F.col("body"), [p]).alias(f"p{i}") for i, p in enumerate(patterns)]
    )
    for r in flags.collect():
        assert r.positive == [i for i in range(len(TERMS)) if r[f"p{i}"]], r.body
    some = docs.filter(P.text_terms(F.col("body"), TERMS)).select("row").collect()
    assert sorted(D.mentions_any(docs, TERMS, "body").select("row").collect()) == sorted(some)


def test_odd_terms_and_taken_names(docs):
    named = docs.withColumnRenamed("row", "spans")
    assert D.with_spans(named, ["lung"], "body").columns == ["id", "body", "spans"]
    assert D.usable_terms([" a", "A", "", None, "b ", "B"]) == ["a", "b"]
    assert D.mentions_any(docs, ["", " "], "body").count() == 0
    assert D.with_positive(docs, [], "body").filter("size(positive) > 0").isEmpty()


def test_many_terms_cost_one_pass():
    few, many = (D.Terms([f"term{i}" for i in range(n)]) for n in (10, 10_000))
    text = "some term9 here and term5 there " * 20_000
    import time

    def cost(terms):
        times = []
        for _ in range(5):
            start = time.perf_counter()
            sum(1 for _ in terms.hits(text))
            times.append(time.perf_counter() - start)
        return min(times)

    assert cost(many) < 2 * cost(few)
    assert re.findall("term9", text)
