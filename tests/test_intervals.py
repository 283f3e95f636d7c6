"""Joins in time against the plain joins they replace."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators import intervals as V

DAY = 86_400


def at(n):
    return None if n is None else dt.datetime(1969, 12, 1) + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    hour = lambda: None if rng.random() < 0.05 else rng.randrange(2000)
    exams = [(key(), at(hour()), i, rng.randrange(3)) for i in range(400)] + [("hot", at(7), 900, 1)] * 3
    index = [(key(), at(hour()), i) for i in range(60)] + [("none", at(5), 99), ("hot", at(7), 98)]
    return (
        spark.createDataFrame(exams, "p string, t timestamp_ntz, i int, v int").repartition(3),
        spark.createDataFrame(index, "p string, x timestamp_ntz, j int"),
    )


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("before,after", [(30 * DAY, 0), (3600, 3600), (0, 0), (0, 5 * DAY)])
def test_rows_in_the_window_of_an_event(tables, before, after):
    exams, index = tables
    gap = F.timestamp_diff("SECOND", F.col("t"), F.col("x"))
    want = exams.join(index, "p").filter(gap.between(-after, before)).select("p", "t", "i", "v", "x", "j")
    found = V.within(exams, index, "p", "t", "x", before, after)
    assert found.columns == want.columns and rows(found) == rows(want)


@pytest.mark.parametrize("width", [None, 7200, 10**9])
def test_intervals_that_overlap(spark, width):
    rng = random.Random(9)
    make = lambda n, far: spark.createDataFrame(
        [(rng.choice(["hot", "hot", "a", None]), at(s := rng.randrange(900)), at(s + rng.randrange(-2, far)), i) for i in range(n)],
        "p string, s timestamp_ntz, e timestamp_ntz, i int",
    )
    a, b = make(80, 20), make(60, 200)
    c = b.select(*[F.col(x).alias(f"{x}_b") for x in b.columns])
    want = a.join(c, (F.col("p") == F.col("p_b")) & (F.col("s") <= F.col("e_b")) & (F.col("s_b") <= F.col("e")))
    want = want.filter("s <= e AND s_b <= e_b")
    found = V.overlaps(a, b, "p", "s", "e", width=width)
    assert want.count() > 50 and rows(found) == rows(want.select(*found.columns))
    assert V.overlaps(a.limit(0), b.limit(0), "p", "s", "e").count() == 0


@pytest.mark.parametrize("strict,most,runs", [(True, None, 1), (True, None, 7), (False, 20 * DAY, 30), (False, None, 3)])
def test_nearest_row_before_an_event(tables, strict, most, runs):
    exams, index = tables
    held = [r for r in exams.collect() if r.p is not None and r.t is not None]
    want = []
    for e in index.collect():
        own = [r for r in held if r.p == e.p and e.x is not None and (r.t < e.x or r.t == e.x and not strict)]
        own = [r for r in own if most is None or (e.x - r.t).total_seconds() <= most]
        best = max(own, key=lambda r: (r.t, r.v, r.i), default=None)
        want.append((e.p, e.x, e.j, best and best.i, best and best.v, best and best.t))
    found = V.nearest_before(exams, index, "p", "t", "x", ["i", "v", "t"], ["v", "i"], strict, most, runs)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert sum(w[3] is not None for w in want) > 20


def test_nearest_of_nothing(tables):
    exams, index = tables
    assert V.nearest_before(exams.limit(0), index, "p", "t", "x", ["i"]).filter("i IS NOT NULL").isEmpty()
    assert V.nearest_before(exams, index.limit(0), "p", "t", "x", ["i"]).isEmpty()
