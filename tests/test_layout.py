"""The Hilbert layout: neighbours on the curve, rows unchanged, fewer row groups read."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.operators import layout as L


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 5), (3, 3), (4, 2)])
def test_the_curve_visits_every_point_step_by_step(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    places = L.curve(list(points.T), bits)
    assert sorted(places) == list(range(len(points)))
    walk = points[np.argsort(places)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(1500))
    rows = [(i, f"ACC{i:06d}" if i % 50 else None, rng.choice(["north", "south", "east", None]), day(), rng.random()) for i in range(6000)]
    return spark.createDataFrame(rows, "_place long, acc string, site string, day date, x double").repartition(5)


def rows(df):
    return sorted(map(str, df.collect()))


def test_rows_are_the_same_and_filters_skip_groups(spark, table, tmp_path):
    by = ["day", "site", "acc"]
    table.repartition(16).write.parquet(str(tmp_path / "plain"))
    L.write_clustered(table, str(tmp_path / "laid"), by, bloom=["acc"], partitions=16)
    laid = spark.read.parquet(str(tmp_path / "laid"))
    assert laid.schema == table.schema and rows(laid) == rows(table)
    wanted = {
        "day": (dt.date(2021, 1, 1), dt.date(2021, 3, 1)),
        "site": ("north", "north"),
        "acc": ("ACC001000", "ACC001200"),
    }
    for c, (low, high) in wanted.items():
        total, read = L.groups_read(spark, str(tmp_path / "laid"), {c: (low, high)}).first()
        assert total == 16 and 0 < read < 13, c
        assert L.groups_read(spark, str(tmp_path / "plain"), {c: (low, high)}).first() == (16, 16)
        kept = F.col(c).between(F.lit(low), F.lit(high))
        assert rows(laid.filter(kept)) == rows(table.filter(kept))
    both = {"day": wanted["day"], "acc": wanted["acc"]}
    assert L.groups_read(spark, str(tmp_path / "laid"), both).first().n_read <= 8
    assert L.groups_read(spark, str(tmp_path / "laid"), {"site": ("zzz", "zzzz")}).first() == (16, 0)
    # One id is found with its filter, and one that lies between others is not there.
    assert laid.filter("acc = 'ACC001001'").count() == 1 and laid.filter("acc = 'ACC001001x'").count() == 0


def test_odd_tables(spark, table):
    assert L.clustered(table.limit(0), ["day"]).count() == 0
    nothing = table.withColumn("site", F.lit(None).cast("string"))
    assert L.clustered(nothing, ["site", "day"]).count() == 6000
    same = table.withColumn("day", F.lit(dt.date(2020, 1, 1)))
    assert rows(L.clustered(same, ["day", "x"], partitions=3)) == rows(same)
    with pytest.raises(ValueError):
        L.clustered(table, [])
    with pytest.raises(ValueError):
        L.clustered(table, ["day", "site"], bits=40)
