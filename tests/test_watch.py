"""Feed watching as streams that stop and go on, and the mapping as it once was."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators import identity as I
from reportloom.streaming import watch
from reportloom.streaming.tables import MergeTable

START = dt.datetime(2024, 1, 1)


def minute(n):
    return START + dt.timedelta(minutes=n)


class Feed:
    """Files that arrive, and a stream over them that ends when it has read them."""

    def __init__(self, spark, session, root, schemas, make):
        self.spark, self.session, self.root, self.schemas, self.make = spark, session, root, schemas, make

    def put(self, name, rows):
        path = f"{self.root}/{name}"
        self.spark.createDataFrame(rows, self.schemas[name]).coalesce(1).write.mode("append").parquet(path)

    def run(self):
        streams = {n: self.session.readStream.schema(s).parquet(f"{self.root}/{n}") for n, s in self.schemas.items()}
        found = self.make(**streams)
        writer = found.writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/ck")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        self.held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
        return sorted(map(tuple, self.spark.read.schema(found.schema).parquet(f"{self.root}/out").collect()), key=str)


def test_messages_without_an_entry(spark, tmp_path):
    schemas = {"messages": "key string, received_at timestamp", "entries": "key string, archived_at timestamp"}
    feed = Feed(spark, spark, tmp_path, schemas, watch.unbatched)
    feed.put("messages", [("a", minute(0)), ("b", minute(1)), ("c", minute(2)), ("d", minute(50)), (None, minute(3)), ("e", minute(4))])
    feed.put("entries", [("a", minute(30)), ("b", minute(32)), ("x", minute(5)), ("c", minute(1)), ("e", minute(4))])
    without = (None, minute(3))
    assert feed.run() == []  # nothing is known for certain yet
    # A restart from the checkpoint; the watermark passes the first windows.
    feed.put("messages", [("z", minute(100))])
    feed.put("entries", [("d", minute(60)), ("y", minute(100))])
    want = [("b", minute(1)), ("c", minute(2))]
    assert feed.run() == sorted([*want, without], key=str) == feed.run()
    # Too late to count, and told once only.
    feed.put("entries", [("c", minute(3)), ("q", minute(400))])
    feed.put("messages", [("late", minute(6)), ("w", minute(400))])
    feed.run()
    feed.put("messages", [("v", minute(500))])
    feed.put("entries", [("v", minute(500))])
    found = [r for r in feed.run() if r[0]]
    assert found == [*want, ("w", minute(400)), ("z", minute(100))]
    assert feed.held[-1] <= 4  # all that is older than the window is forgotten


def test_files_that_stall(spark, tmp_path):
    session = watch.with_timers(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != watch.ROCKS
    feed = Feed(spark, session, tmp_path, {"status": "file_path string, status string, processed_at timestamp"}, watch.stalled)
    feed.put("status", [("a", "staged", minute(0)), ("b", "staged", minute(0)), ("b", "success", minute(9)), ("c", "staged", minute(20))])
    feed.put("status", [(None, "staged", minute(0)), ("d", None, minute(0)), ("e", "staged", None), ("f", "staged", minute(5)), ("f", "failed", minute(5))])
    assert feed.run() == []
    feed.put("status", [("z", "success", minute(45)), ("a", "staged", minute(0))])  # the second a replay
    a = ("a", "staged", minute(0))
    assert feed.run() == [a]
    # It goes on, stalls again and is told again; what is done is never told.
    feed.put("status", [("a", "parsed", minute(46)), ("c", "success", minute(46)), ("b", "staged", minute(1))])
    assert feed.run() == [a]
    feed.put("status", [("z", "success", minute(300))])
    assert feed.run() == [("a", "parsed", minute(46)), a]
    assert feed.run() == [("a", "parsed", minute(46)), a]


@pytest.mark.parametrize("null_ids", ["group", "separate"])
def test_the_mapping_as_it_was(spark, tmp_path, null_ids):
    rng = random.Random(12)
    pick = lambda p: None if rng.random() < 0.35 else f"{p}{rng.randrange(25)}"
    reports = [(f"r{i:02d}", pick("m"), pick("e")) for i in range(60)]
    rng.shuffle(reports)
    make = lambda rows: spark.createDataFrame(rows, "primary_report_identifier string, mpi string, epic_mrn string")
    table = MergeTable(spark, str(tmp_path / "mapping"), "primary_report_identifier")
    mapping, then = I.empty_mapping(spark), []
    for version, cut in enumerate((20, 35, 60)):
        mapping, _ = I.update_mapping(mapping, make(reports[len(then) and (0, 20, 35)[version] : cut]), null_ids)
        table.upsert(version, mapping)
        then.append(sorted(map(str, mapping.select(*I.MAPPING_COLUMNS).collect())))
    spans = I.validity(table.changes()).cache()
    for version, want in enumerate(then):
        held = I.mapping_as_of(spans, version)
        assert sorted(map(str, held.collect())) == want
        rows = make(reports).select("primary_report_identifier")
        assert I.patient_view_as_of(rows, spans, version).count() == held.filter("consistent").count()
    assert spans.count() > 60 and I.mapping_as_of(spans, -1).isEmpty()  # some were renamed
    dated = make(reports).withColumn("v", F.lit(1))
    assert dated.count() == I.patient_at(dated, spans, "v").count()
    assert I.patient_at(dated, spans, "v").filter("patient_id IS NOT NULL").count() == 35


def test_states_that_repeat_split_and_end(spark):
    rows = [("r", "p1", 0, "insert"), ("r", "p1", 1, "update_postimage"), ("r", "p2", 2, "update_postimage"), ("r", "p2", 4, "delete")]
    rows += [("r", "p1", 6, "insert"), ("s", "p1", 3, "insert"), ("s", "p1", 5, "update_preimage"), ("s", "p3", 5, "update_postimage")]
    log = spark.createDataFrame(rows, "primary_report_identifier string, patient_id string, _commit_version int, _change_type string")
    log = log.withColumns({"mpi": F.lit("m"), "epic_mrn": F.lit(None).cast("string"), "consistent": F.lit(True)})
    log = log.withColumn("_commit_timestamp", F.make_dt_interval(days="_commit_version") + F.lit(START))
    found = I.validity(log).select("primary_report_identifier", "patient_id", "valid_from", "valid_to").collect()
    want = [("r", "p1", 0, 2), ("r", "p1", 6, None), ("r", "p2", 2, 4), ("s", "p1", 3, 5), ("s", "p3", 5, None)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    timed = I.validity(log, at="_commit_timestamp")
    assert I.mapping_as_of(timed, START + dt.timedelta(days=4, hours=1)).select("patient_id").collect() == [("p1",)]
