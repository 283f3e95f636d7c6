import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators import changes as C
from reportloom.operators import maintained as M
from reportloom.operators import identity, windows
from reportloom.plans.maintenance import base_reports
from reportloom.plans.registry import Tables
from reportloom.streaming import cascade
from reportloom.streaming.cascade import ReportTables
from reportloom.streaming.tables import MergeTable


def test_hash_ignores_order_and_null_columns(spark):
    df = spark.createDataFrame([(1, "a", None)], "a int, b string, c string")
    one = C.with_content_hash(df).first()["content_hash"]
    assert C.with_content_hash(df.select("c", "b", "a")).first()["content_hash"] == one
    assert C.with_content_hash(df.drop("c").withColumn("updated", F.lit(5))).first()["content_hash"] == one
    assert C.with_content_hash(df.withColumn("c", F.lit("x"))).first()["content_hash"] != one
    empty = spark.createDataFrame([(None,)], "z string")
    assert C.with_content_hash(empty).first()["content_hash"] is not None


def test_merge_backfills_a_missing_hash_once(spark):
    schema = "source_file string, year int, v string"
    batch = spark.createDataFrame([("a", 2020, "x"), ("b", None, "y")], schema)
    legacy = spark.createDataFrame([("a", 2020, "x")], schema)
    merged, changed = C.merge_reports(legacy, batch)
    assert sorted(r["source_file"] for r in changed.collect()) == ["a", "b"]
    merged, again = C.merge_reports(merged, batch)
    # A row without a year is found again like any other.
    assert again.count() == 0 and merged.count() == 2


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_table(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), "id")
    make = lambda data: spark.createDataFrame(data, "id string, g string, v int")
    assert table.upsert(0, make([("a1", "a", 1), ("a2", "a", 2), ("b1", "b", 3)]))
    assert not table.upsert(1, make([("a1", "a", 1)]))
    assert table.upsert(2, make([("a1", "a", 9), ("c1", "c", 4)]))
    assert rows_of(table.read().select("id", "v")) == [("a1", 9), ("a2", 2), ("b1", 3), ("c1", 4)]
    # Replaying a commit changes nothing, whatever it is called with.
    assert table.upsert(2, make([("zz", "z", 0)]))
    assert table.read().count() == 4
    # Replacing a group as a set, and emptying one.
    touched = spark.createDataFrame([("a",), ("b",)], "g string")
    assert table.replace(3, make([("a3", "a", 7)]), touched, "g")
    assert rows_of(table.read().select("id", "v")) == [("a3", 7), ("c1", 4)]
    kinds = rows_of(table.changes().filter("_commit_version = 3").select("id", "_change_type"))
    assert kinds == [("a1", "delete"), ("a2", "delete"), ("a3", "insert"), ("b1", "delete")]
    # New columns are taken up.
    wider = make([("c1", "c", 5)]).withColumn("extra", F.lit("e"))
    assert table.upsert(4, wider)
    assert rows_of(table.read().select("id", "v", "extra")) == [("a3", 7, None), ("c1", 5, "e")]


def test_cascade_in_batches(spark, tmp_path):
    reports = base_reports(Tables(spark, "/root/testdata/sf0.001")).filter("year < 1997")
    early, late = reports.filter("year = 1995"), reports.filter("year <> 1995")
    tables = ReportTables(spark, str(tmp_path / "split"))
    assert tables.ingest(0, early)
    tables.refresh()
    assert tables.ingest(1, late.unionByName(early))
    assert not tables.ingest(2, early)
    tables.refresh()
    assert tables.base.changes().filter("_commit_version = 1").count() == late.count()
    good = reports.count()
    curated = tables.curated.read()
    assert tables.base.read().count() == good
    assert tables.latest.read().count() == curated.select("accession_number").distinct().count()
    assert tables.dx.read().count() == 2 * tables.latest.read().count()
    mapping = tables.mapping.read()
    assert mapping.count() == curated.count()
    view = tables.patient_view(tables.latest)
    assert view.count() == mapping.filter("consistent").join(
        tables.latest.read(), "primary_report_identifier"
    ).count()


@pytest.mark.parametrize("runs", [1, 3, 40])
def test_neighbours_equal_windows(spark, runs):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        at = None if rng.random() < 0.05 else rng.randrange(1000)
        rows.append((key, at, i, None if rng.random() < 0.2 else rng.randrange(9)))
    df = spark.createDataFrame(rows, "k string, at int, i int, v int")
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("at", "i")
    want = df.withColumns(
        {
            "p1": F.lag("v", 1).over(w),
            "p3": F.lag("i", 3).over(w),
            "n2": F.lead("v", 2).over(w),
            "rn": F.row_number().over(w).cast("bigint"),
            "size": F.count("*").over(Window.partitionBy("k")),
        }
    )
    got = windows.with_neighbours(
        df, "k", ["at", "i"], lags={"p1": ("v", 1), "p3": ("i", 3)}, leads={"n2": ("v", 2)},
        number="rn", size="size", runs=runs,
    ).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = windows.newest_per(df, "k", [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def files_under(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_commit_writes_only_its_batch(spark, tmp_path):
    make = lambda data: spark.createDataFrame(data, "id long, v int")
    table = MergeTable(spark, str(tmp_path / "t"), "id")
    assert table.upsert(0, make([(i, 0) for i in range(200)]))
    before = files_under(tmp_path / "t")
    assert table.upsert(1, make([(3, 9), (500, 1)]))
    after = files_under(tmp_path / "t")
    assert before.items() <= after.items() and len(after) > len(before)
    assert sum(spark.read.parquet(p).count() for p in after.keys() - before.keys()) == 2
    again = MergeTable(spark, str(tmp_path / "t"), "id")
    assert again.upsert(2, make([(4, 7)]))
    assert again.read().count() == 201 and again.read().filter("v = 7").count() == 1
    assert rows_of(again.changes().filter("_commit_version = 2").select("id", "_change_type")) == [(4, "update_postimage")]


def test_null_keys_readers_and_unchanged_rows(spark, tmp_path):
    make = lambda data: spark.createDataFrame(data, "id long, y int, v int")
    table = MergeTable(spark, str(tmp_path / "t"), ["id", "y"])
    assert table.upsert(0, make([(1, 2020, 1), (2, None, 1)]))
    reader = table.read()
    assert table.upsert(1, make([(1, 2020, 2), (3, 2021, 1)]))
    assert not table.upsert(2, make([(2, None, 1)]))
    assert rows_of(reader) == [(1, 2020, 1), (2, None, 1)]
    assert table.upsert(3, make([(2, None, 5)]))
    want = [(1, 2020, 2), (2, None, 5), (3, 2021, 1)]
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in table.read().select("id", "y", "v").collect()), key=key) == want
    assert not table.upsert(4, make([(2, None, 5)])) and table.logged(1) and not table.logged(4)
    # A commit that was not finished is written again.
    (tmp_path / "t" / "changes" / "_commit_version=3" / "_SUCCESS").unlink()
    assert table.upsert(3, make([(2, None, 6)]))
    assert table.read().filter("v = 6").count() == 1


@pytest.mark.parametrize("condition", [None, "s.v > t.v"])
def test_changes_of_an_upsert(spark, condition):
    rng = random.Random(4)
    rows = lambda n: [(k, rng.randrange(3), {"a": rng.randrange(2)}, str(rng.random())) for k in rng.sample(range(30), n)]
    old = spark.createDataFrame([*rows(20), (None, 1, None, "x")], "id int, v int, m map<string,int>, updated string")
    new = spark.createDataFrame([*rows(20), (None, 2, None, "x")], old.schema).drop("m" if condition else "updated").withColumn("w", F.lit(1))
    want = C.change_rows(old, C.upsert(old, new, "id", condition), "id")
    got = C.upsert_changes(old, new, "id", condition)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_change_rows_with_preimages(spark):
    make = lambda data: spark.createDataFrame(data, "id int, v int")
    rows = C.change_rows(make([(1, 1), (2, 1), (3, 1)]), make([(1, 1), (2, 5), (4, 1)]), "id", preimages=True)
    assert rows_of(rows) == [(2, 1, "update_preimage"), (2, 5, "update_postimage"), (3, 1, "delete"), (4, 1, "insert")]


def test_aggregates_follow_the_log(spark, tmp_path):
    rng, schema = random.Random(8), "id int, g string, v int, p string"
    rows: dict[int, tuple] = {}
    sums = M.MaintainedAggregate(spark, str(tmp_path / "sums"), ["g"], ["v"])
    kinds = M.MaintainedAggregate(spark, str(tmp_path / "kinds"), ["g"], distinct="p")
    with pytest.raises(FileNotFoundError):
        sums.read()
    for version in range(7):
        old = spark.createDataFrame(list(rows.values()), schema)
        if version == 5:
            rows.clear()  # everything goes
        for _ in range(25 if version != 5 else 0):
            i = rng.randrange(40)
            rows.pop(i, None)
            if rng.random() < 0.8:
                rows[i] = (i, rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None]))
        new = spark.createDataFrame(list(rows.values()), schema)
        changes = C.change_rows(old, new, "id", preimages=True)
        for held in (sums, kinds):
            held.apply(version, changes)
            if version % 3 == 2:
                held.apply(version, changes)  # a replay
            if version in (3, 5):
                held.fold(version if version == 5 else 2)
        want = new.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("sum_v"), F.avg("v").alias("avg_v"))
        assert sorted(map(str, sums.read().collect())) == sorted(map(str, want.collect()))
        distinct = new.groupBy("g").agg(F.count_distinct("p").alias("n"))
        assert sorted(map(str, kinds.read().collect())) == sorted(map(str, distinct.collect()))
    # A batch that changes nothing leaves nothing.
    assert M.deltas(changes.filter("false"), "g", ["v"]).count() == 0


def test_a_table_feeds_its_aggregate(spark, tmp_path):
    make = lambda data: spark.createDataFrame(data, "id long, g string, v int")
    table = MergeTable(spark, str(tmp_path / "t"), "id", preimages=True)
    held = M.MaintainedAggregate(spark, str(tmp_path / "sums"), ["g"], ["v"])
    batches = [[(1, "a", 1), (2, "a", 2), (3, "b", 3)], [(1, "b", 5), (4, "b", None)], [(2, "a", 2)]]
    for version, rows in enumerate(batches):
        if table.upsert(version, make(rows)):
            held.apply(version, table.changes().filter(F.col("_commit_version") == version))
    touched = spark.createDataFrame([("a",)], "g string")
    assert table.replace(3, make([(9, "a", 7), (2, "a", 4)]), touched, "g")
    held.apply(3, table.changes().filter("_commit_version = 3"))
    assert rows_of(table.read()) == [(1, "b", 5), (2, "a", 4), (3, "b", 3), (4, "b", None), (9, "a", 7)]
    assert sorted(map(tuple, held.read().collect())) == [("a", 2, 11, 5.5), ("b", 3, 8, 4.0)]
    images = table.changes().filter("_commit_version = 1").select("id", "g", "_change_type")
    assert rows_of(images) == [(1, "a", "update_preimage"), (1, "b", "update_postimage"), (4, "b", "insert")]


def test_equal_dates_are_cut_into_even_runs(spark):
    rows = spark.range(100_000).select(F.lit("k").alias("k"), F.lit(5).alias("at"), "id")
    sizes = [r["count"] for r in windows.in_runs(rows, ["k"], ["at", "id"], 16).groupBy("_run").count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 2 * 100_000 / 16


def test_first_commits_are_not_held(spark, tmp_path, monkeypatch):
    made = []
    persist = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: made.append(df.columns) or persist(df, *a))
    table = MergeTable(spark, str(tmp_path / "t"), "id")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert table.replace(0, rows, rows.select("id"), "id") and not made
    assert table.upsert(1, rows.withColumn("v", F.col("v") + 1)) and len(made) == 1
    assert rows_of(table.read()) == [("a", 2), ("b", 3)]
    # A single table reads the batch itself, several have it held.
    cascade.fan_out([lambda b, v: b.count()])(rows, 0)
    assert len(made) == 1
    cascade.fan_out([lambda b, v: b.count()] * 2)(rows, 0)
    assert len(made) == 2


def test_an_empty_mapping_is_empty_in_the_plan(spark):
    empty = identity.empty_mapping(spark)
    assert empty.columns == list(identity.MAPPING_COLUMNS) and empty.schema["consistent"].dataType.simpleString() == "boolean"
    reports = spark.createDataFrame([("r", "m")], "primary_report_identifier string, mpi string")
    plan = identity.unmapped(reports, empty)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_known_sources_are_not_held_and_images_dealt_once(spark, tmp_path, monkeypatch):
    made = []
    persist = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: made.append(df.columns) or persist(df, *a))
    table = MergeTable(spark, str(tmp_path / "t"), "id")
    some = lambda n, v: spark.range(n).select(F.nullif("id", F.lit(3)).alias("id"), F.lit(v).alias("v"))
    assert table.upsert(0, some(8, 1)) and table.upsert(1, some(10, 1))
    assert not table.upsert(2, some(10, 1)) and table.upsert(3, some(5, 2)) and not made
    kinds = table.changes().groupBy("_commit_version", "_change_type").count()
    assert rows_of(kinds) == [(0, "insert", 8), (1, "insert", 2), (3, "update_postimage", 5)]
    assert table.read().filter("v = 2").count() == 5 and table.read().count() == 10 and table._null_keys(table.changes())
    # A log without NULL keys meets the source where its images lie by key already.
    whole = MergeTable(spark, str(tmp_path / "w"), "id")
    assert whole.upsert(0, spark.range(9).withColumn("v", F.lit(1))) and not whole._null_keys(whole.changes())
    for null_keys, dealt in ((True, 3), (False, 2)):
        rows = C.upsert_changes(whole.read().hint("merge"), spark.range(9).withColumn("v", F.lit(2)), "id", null_keys=null_keys)
        assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hash") == dealt


@pytest.mark.parametrize("nulls", [True, False])
def test_changes_of_a_replacement(spark, nulls):
    rng = random.Random(6)
    rows = lambda n: [(k, rng.choice(["a", "b", "c", "d", None]), rng.randrange(2), {"x": rng.randrange(2)}) for k in rng.sample(range(40), n)]
    make = lambda data: spark.createDataFrame(data, "id int, g string, v int, m map<string,int>")
    extra = [(None, "a", 1, None)] if nulls else []
    old, new = make(rows(30) + extra).withColumn("was", F.lit(7)), make(rows(30) + extra).withColumn("w", F.lit("y"))
    touched = spark.createDataFrame([("a",), ("b",), (None,), ("a",), ("z",)], "g string")
    group = old.filter("g IN ('a', 'b') OR g IS NULL")
    for preimages in (False, True):
        want = C.change_rows(group, new, "id", preimages=preimages)
        got = C.replace_changes(old, new, touched, "id", "g", preimages=preimages, null_keys=nulls)
        assert got.columns == want.columns and want.count() > 20
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_are_hashed_as_they_are_written(spark, tmp_path):
    tables = ReportTables(spark, str(tmp_path / "r"))
    make = lambda n, **more: spark.range(n).select(F.col("id").cast("string").alias("source_file"), F.lit(2020).alias("year"), *[F.lit(v).alias(k) for k, v in more.items()])
    assert tables.ingest(0, make(3, a="x", b="y")) and tables.ingest(1, make(4, a="x")) and not tables.ingest(2, make(2, a="x"))
    log = tables.base.changes()
    for version, reports in ((0, make(3, a="x", b="y")), (1, make(4, a="x").filter("source_file = '3'"))):
        want = rows_of(C.with_content_hash(reports).select("source_file", C.CONTENT_HASH))
        assert rows_of(log.filter(F.col("_commit_version") == version).select("source_file", C.CONTENT_HASH)) == want
    assert log.columns[:6] == ["source_file", "year", "a", "b", C.CONTENT_HASH, "updated"]


def test_components_settle_as_soon_as_they_are_stars(spark):
    make = lambda edges: spark.createDataFrame(edges, "u string, v string")
    assert identity._settled(make([("c", "a"), ("d", "a"), ("f", "e")])) and identity._settled(make([]))
    assert not identity._settled(make([("c", "a"), ("c", "b")])) and not identity._settled(make([("c", "b"), ("b", "a")]))


def test_a_batch_tells_what_it_changes_in_the_mapping(spark):
    make = lambda rows: spark.createDataFrame(rows, "primary_report_identifier string, mpi string, epic_mrn string")
    mapping = identity.build_mapping(make([("a", "m1", None), ("b", "m2", "e2"), ("c", "m3", None), ("d", None, None)]))
    batch = make([("x", "m1", "e2"), ("y", "m3", None), ("b", "m2", "e2"), ("z", None, None)])
    affected, added = identity.place_batch(mapping, batch)
    old, new = identity.resolve_batch(mapping, batch)
    assert sorted(r[0] for r in added.select("primary_report_identifier").collect()) == ["x", "y", "z"]
    assert rows_of(identity.placed_history(affected)) == rows_of(identity.mapping_history(old, new))
    want = C.upsert_changes(mapping, new, "primary_report_identifier")
    assert rows_of(identity.placed_changes(affected, added)) == rows_of(want.select(*identity.MAPPING_COLUMNS, "_change_type"))
