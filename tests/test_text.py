import random
import re

import pytest
from pyspark.sql import functions as F

from reportloom.functions import predicates as P
from reportloom.functions import text as T

WORDS = ["no ", "evidence of ", "lung ", "mass", "Mass ", "ruled out ", "nodule", ". ", "\n", "negative  for ",
         "x" * 30 + " ", "LI-RADS 4 ", "LR-5", "lr m", "LR mass", "BI-RADS category 4b ", "5 BIRADS", "PIRADS 3"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(WORDS) for _ in range(rng.randrange(25)))) for i in range(400)]
    return rows + [(400, None), (401, ""), (402, "mass" * 3000)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(texts, "i int, t string").cache()


PATTERNS = ["mass", r"lung.{0,10}mass", "nodul(?:e|ar)"]
NEGATION = re.compile("|".join(T.NEGATION_PHRASES), re.IGNORECASE)


def hits(text):
    low = (text or "").lower()
    for p in PATTERNS:
        for m in re.finditer(p, low, re.IGNORECASE | re.DOTALL):
            yield m.start(), m.end(), bool(NEGATION.search(low[max(0, m.start() - 50) : m.start()]))


def test_positive_mention(frame, texts):
    got = {r["i"]: r["p"] for r in frame.select("i", T.positive_mention(F.col("t"), PATTERNS).alias("p")).collect()}
    want = {i: any(not n for _, _, n in hits(t)) for i, t in texts}
    assert got == want and 50 < sum(want.values()) < 350


def test_match_spans(frame, texts):
    rows = frame.select("i", T.match_spans(F.col("t"), PATTERNS).alias("m")).collect()
    for r, (_, text) in zip(sorted(rows, key=lambda r: r["i"]), texts):
        kept, edge = [], 0
        for span in sorted(hits(text), key=lambda h: (h[0], -(h[1] - h[0]))):
            if span[0] >= edge:
                kept.append(span)
                edge = span[1]
        if text is not None:
            assert [tuple(m) for m in r["m"]] == kept


def scores_by_hand(text, kind):
    found = []
    for p in T.SCORE_PATTERNS[kind]:
        for m in re.finditer(p, text or "", re.IGNORECASE):
            s = m.group(1).upper()
            if kind == "LIRADS" and not s.startswith("LR-"):
                s = "LR-" + s
            if kind == "BIRADS":
                s = "BI-RADS-" + re.sub(r"CATEGORY\s*", "", s)
            if s not in found:
                found.append(s)
    return found


@pytest.mark.parametrize("kind", ["LIRADS", "BIRADS", "PIRADS"])
def test_scores(frame, texts, kind):
    s = T.extract_scores(F.col("t"), kind)
    rows = frame.select("i", s.alias("s"), T.primary_score(s, kind).alias("p")).collect()
    by_id = dict(texts)
    for r in rows:
        want = scores_by_hand(by_id[r["i"]], kind)
        best = [p for p in T.SCORE_PRIORITY[kind] if p in want]
        assert list(r["s"]) == want
        assert r["p"] == (best[0] if best else want[0] if want else None)


def test_lr_mass_reads_as_lr_m(spark):
    row = spark.range(1).select(T.extract_scores(F.lit("an LR mass"), "LIRADS").alias("s")).first()
    assert list(row["s"]) == ["LR-M"]


def test_locate_snippet(spark):
    rows = [
        ("Findings:\n  a  small\tnodule here", "A small nodule", (12, 27)),
        ("abc def", "abc", None),
        ("abc def", "zzz zzz", None),
        ("xab cde f", "ab cde", (1, 7)),
        (None, "abcdef", None),
        ("word " * 20000 + "the end now", "the  end now", (100000, 100011)),
    ]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(rows)], "i int, t string, s string")
    got = {r["i"]: r["m"] for r in df.select("i", T.locate_snippet(F.col("t"), F.col("s")).alias("m")).collect()}
    assert {i: tuple(m) if m else None for i, m in got.items()} == {i: w for i, (_, _, w) in enumerate(rows)}


def test_excerpt(spark):
    long = "a " * 100 + "big MASS\nseen" + " b" * 100
    row = spark.range(1).select(
        T.excerpt([F.lit(None).cast("string"), F.lit("massive"), F.lit(long)], ["mass"]).alias("e")
    ).first()
    at = long.index("MASS")
    assert row["e"] == "…" + long[at - 80 : at + 84].replace("\n", " ").strip() + "…"


def test_literals_and_negation(spark):
    df = spark.createDataFrame(
        [("c++ a.b",), ("No mass. Nodule seen",), ("no nodule",), ("note: nodule",), (None,)], "t string"
    )
    t = F.col("t")
    rows = df.select(
        P.text_terms(t, "a.b\nzzz").alias("a"),
        (P.matches(t, "nodule") & P.unnegated(t, "nodule")).alias("b"),
    ).collect()
    assert [r["a"] for r in rows] == [True, False, False, False, None]
    assert [r["b"] for r in rows] == [False, True, False, True, False]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_rules_beyond_ascii(spark):
    """Reports are ISO-8859-1: no-break spaces and accented capitals are common."""
    assert not one(spark, "No\u00a0evidence of nodule", lambda c: T.positive_mention(c, ["nodule"]))
    assert one(spark, "LI-RADS\u00a05", lambda c: T.extract_scores(c, "LIRADS")) == ["LR-5"]
    for test in (lambda c: P.text_terms(c, "écho"), lambda c: P.name_any(c, "écho"), lambda c: P.matches(c, "écho")):
        assert one(spark, "Écho cardiaque", test)
    assert one(spark, "nodule", lambda c: T.positive_mention(c, [r"\p{L}+dule"]))


def test_unusable_patterns_and_empty_lists(spark):
    for pattern in ("(", "(?P<a>x)"):
        with pytest.raises(ValueError):
            T.positive_mention(F.col("t"), [pattern])
    for test in (lambda c: P.name_any(c, ""), lambda c: P.text_terms(c, "\n"), lambda c: T.positive_mention(c, [])):
        assert one(spark, "anything", test) is False


def test_locating_a_snippet_takes_time_in_proportion(spark):
    import time

    took = []
    for n in (16_000, 64_000):
        words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(i.cast("string"), F.when(i % 7 == 0, " ").otherwise("")))
        df = spark.range(4).select(F.array_join(words, " ").alias("t")).repartition(4).cache()
        found = df.select(T.locate_snippet(F.col("t"), F.regexp_replace("t", r"\s+", " ")).alias("m"), F.length("t").alias("n"))
        assert found.filter("m.start = 0 AND m.end >= n - 1").count() == 4
        times = []
        for _ in range(3):
            start = time.perf_counter()
            found.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took.append(min(times))
    assert took[1] < 8 * took[0]  # four times the words; quadratic would be sixteen
