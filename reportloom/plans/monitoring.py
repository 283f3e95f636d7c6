"""Streams, ingest status and governed views over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy, status
from ..operators.windows import newest_per
from ..session import scratch_path
from ..streaming import archive, watch
from ..streaming.cascade import fan_out, stream_changes
from .registry import query
from .shapes import EXAMS, SOURCE, exams, hl7_messages

def event_status():
    return (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "staged")
        .otherwise("success")
    )


STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'staged' ELSE 'success' END"


def event_log(t):
    """Events as status rows of one file per user."""
    path = t.events.withColumn("path", F.concat(F.lit("f/"), F.col("user_id").cast("string")))
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return status.status_rows(path, "path", event_status(), error=error, at=F.col("ts"))


def event_stream(t):
    """The events table as a stream of files."""
    schema = t.events.schema
    folder = t.path("events").rsplit("/", 1)[0]
    return t.spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")


def run(stream, t, mode, name, key=None):
    """Run a stream over what is there and read its result.

    A row of a ``key`` that a later batch writes again replaces the earlier one.
    """
    path = scratch_path(t.spark, name)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", scratch_path(t.spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = t.spark.read.parquet(path)
    return (newest_per(rows, key, [F.desc("batch")]) if key else rows).drop("batch")


@query(
    "K1_stream_changes",
    """SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1""",
)
def _(t):
    source, out = scratch_path(t.spark, "feed"), scratch_path(t.spark, "seen")
    t.events.withColumn("_commit_version", F.month("ts")).write.partitionBy("_commit_version").parquet(source)
    checkpoint = scratch_path(t.spark, "feed-checkpoint")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # The second run finds nothing new and adds nothing.
    stream_changes(t.spark, source, keep, checkpoint)
    stream_changes(t.spark, source, keep, checkpoint)
    return (
        t.spark.read.parquet(out)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    )


@query(
    "K2_fan_out",
    """SELECT 'failed' AS part, count(*) AS n FROM events WHERE event_type = 'error'
       UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events""",
)
def _(t):
    out = scratch_path(t.spark, "fan")

    def failed(batch, batch_id):
        batch.filter("event_type = 'error'").select("event_id").write.parquet(f"{out}/failed/batch={batch_id}")

    def users(batch, batch_id):
        batch.select("user_id").distinct().write.parquet(f"{out}/users/batch={batch_id}")

    query = (
        event_stream(t)
        .writeStream.foreachBatch(fan_out([failed, users]))
        .option("checkpointLocation", scratch_path(t.spark, "fan-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    parts = [
        t.spark.read.parquet(f"{out}/{p}").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
        for p in ("failed", "users")
    ]
    return parts[0].unionByName(parts[1])


def message_folder(t):
    """HL7 messages and empty bodies as files a stream can pick up."""
    path = scratch_path(t.spark, "inbox")
    blank = t.nation.select(F.lit("").alias("body"))
    hl7_messages(t).select(F.col("content").alias("body")).unionByName(blank).write.parquet(path)
    return t.spark.readStream.schema("body string").parquet(path)


@query(
    "K3_archive_messages",
    f"""WITH {SOURCE} SELECT k AS message_control_id, true AS listed, CAST(length(k) + 17 AS INTEGER) AS name_length
       FROM src""",
)
def _(t):
    path = scratch_path(t.spark, "archive")
    stream = archive.keyed(message_folder(t))
    archive.archive_messages(
        stream, path, scratch_path(t.spark, "archive-checkpoint"), interval=None
    ).awaitTermination()
    listed = t.spark.read.parquet(f"{path}/manifest").select("entry", F.lit(True).alias("listed"))
    return t.spark.read.parquet(f"{path}/messages").join(listed, "entry", "left").select(
        F.col("key").alias("message_control_id"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
        F.length("entry").alias("name_length"),
    )


def run_twice(t, spark, fill, make):
    """Rows of a stream that ends, finds later files, and goes on from its checkpoint until all is reported.

    ``fill(late)`` writes the files, first those of the table, then one that lies far ahead.
    """
    out, checkpoint = scratch_path(t.spark, "watched"), scratch_path(t.spark, "watch-checkpoint")
    for late in (False, True):
        fill(late)
        stream = make(spark)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query(
    "K11_unbatched",
    """SELECT event_id AS key, ts AS received_at FROM events WHERE event_type = 'error' OR user_id % 5 = 0""",
)
def _(t):
    inbox, stored = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "entries")
    delay = F.when(F.col("user_id") % 5 == 0, 31).otherwise(F.col("user_id") % 31)
    sent = t.events.select(F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("received_at"))
    noted = t.events.filter("event_type <> 'error'").select(
        F.col("event_id").alias("key"),
        (F.col("ts") + F.make_dt_interval(mins=delay.cast("int"))).cast("timestamp").alias("archived_at"),
    )
    ahead = t.events.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).cast("timestamp").alias("at"))

    def fill(late):
        if late:
            ahead.select(F.lit(-1).cast("long").alias("key"), F.col("at").alias("received_at")).write.mode("append").parquet(inbox)
            ahead.select(F.lit(-1).cast("long").alias("key"), F.col("at").alias("archived_at")).write.mode("append").parquet(stored)
        else:
            sent.write.parquet(inbox)
            noted.write.parquet(stored)

    def make(spark):
        messages = spark.readStream.schema("key long, received_at timestamp").parquet(inbox)
        entries = spark.readStream.schema("key long, archived_at timestamp").parquet(stored)
        return watch.unbatched(messages, entries)

    return run_twice(t, t.spark, fill, make).select("key", F.col("received_at").cast("timestamp_ntz").alias("received_at"))


@query(
    "K6_stalled_files",
    f"""SELECT 'f/' || user_id AS file_path, status, ts AS at FROM (
         SELECT user_id, ts, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
       WHERE rn = 1 AND status = 'staged'""",
)
def _(t):
    inbox = scratch_path(t.spark, "status")
    log = event_log(t).select("file_path", "status", F.col("processed_at").cast("timestamp").alias("processed_at"))
    ahead = log.agg((F.max("processed_at") + F.expr("INTERVAL 9 DAYS")).alias("processed_at"))

    def fill(late):
        done = ahead.select(F.lit("ahead").alias("file_path"), F.lit("success").alias("status"), "processed_at")
        (done if late else log).write.mode("append").parquet(inbox)

    def make(spark):
        return watch.stalled(spark.readStream.schema("file_path string, status string, processed_at timestamp").parquet(inbox))

    found = run_twice(t, watch.with_timers(t.spark), fill, make)
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("K4_keyed_stream", f"WITH {SOURCE} SELECT k AS key, count(*) AS n FROM src GROUP BY 1")
def _(t):
    stream = archive.keyed(message_folder(t)).filter("key IS NOT NULL").select("key")
    return run(stream, t, "append", "keyed").groupBy("key").agg(F.count("*").alias("n"))


@query(
    "K5_current_status",
    f"""SELECT 'f/' || user_id AS file_path, {STATUS} AS status,
       CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS error_message, ts AS processed_at FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t):
    path = scratch_path(t.spark, "status")
    log = event_log(t)
    status.append_status(log.filter("status = 'failed'"), path)
    status.append_status(log.filter("status <> 'failed'"), path)
    return status.current_status(t.spark.read.parquet(path)).drop("type")


@query(
    "K5_upsert_status",
    f"""SELECT 'f/' || user_id AS file_path, {STATUS} AS status, ts AS processed_at FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t):
    log, noon = event_log(t), "2024-01-15"
    current = status.current_status(log.filter(F.col("processed_at") < noon))
    merged = status.upsert_status(current, log.filter(F.col("processed_at") >= noon))
    return merged.select("file_path", "status", "processed_at")


def lineage(t):
    """One line per conversation turn, with the file its user stands for."""
    return t.conversations.select(
        F.concat(F.lit("log/"), F.col("conv_id").cast("string")).alias("log_path"),
        F.col("turn").alias("message_number"),
        F.concat(F.lit("f/"), F.col("conv_id").cast("string")).alias("hl7_path"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).alias("date"),
    )


@query(
    "K6_upsert_lineage",
    """SELECT 'log/' || conv_id AS log_path, turn AS message_number,
       CASE WHEN role = 'user' THEN 'again/' ELSE 'f/' END || conv_id AS hl7_path FROM conversations""",
)
def _(t):
    again = t.conversations.filter("role = 'user'").select(
        F.concat(F.lit("log/"), F.col("conv_id").cast("string")).alias("log_path"),
        F.col("turn").alias("message_number"),
        F.concat(F.lit("again/"), F.col("conv_id").cast("string")).alias("hl7_path"),
    )
    first = lineage(t).drop("date")
    return status.upsert_lineage(first, again)


RECENT = f"""cur AS (SELECT 'f/' || user_id AS file_path, {STATUS} AS status,
    CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS error_message FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1),
  recent AS (SELECT cur.*, 'log/' || conv_id AS log_path, turn AS message_number, DATE '2024-01-01' + CAST(turn AS INTEGER) AS date
    FROM cur JOIN conversations ON file_path = 'f/' || conv_id)"""


def recent(t):
    return status.recent_files(status.current_status(event_log(t)), lineage(t))


@query("K7_recent_files", f"WITH {RECENT} SELECT file_path, status, log_path, message_number, date FROM recent")
def _(t):
    return recent(t).select("file_path", "status", "log_path", "message_number", "date")


@query("K8_file_counts", f"WITH {RECENT} SELECT date, status, count(*) AS files FROM recent GROUP BY 1, 2")
def _(t):
    return status.file_counts(recent(t))


@query(
    "K9_error_files",
    """SELECT 'f/' || user_id AS file_path, 'event ' || event_id AS error_message FROM events
       WHERE event_type = 'error'""",
)
def _(t):
    return status.error_files(event_log(t)).select("file_path", "error_message")


@query(
    "K10_daily_series",
    """WITH c AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'error') AS failed,
         count(*) FILTER (WHERE event_type <> 'error') AS succeeded FROM events GROUP BY 1),
       s AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date)
       SELECT s.date, coalesce(failed, 0) AS failed, coalesce(succeeded, 0) AS succeeded FROM s LEFT JOIN c USING (date)""",
)
def _(t):
    log = event_log(t).withColumn("date", F.col("processed_at").cast("date"))
    return status.daily_series(status.file_counts(log), "2023-12-25", "2024-02-05")


@query(
    "K11_feed_gaps",
    """WITH w AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events),
       e AS (SELECT max(ts) + INTERVAL 1 HOUR AS e FROM events),
       s AS (SELECT unnest(generate_series(min(b), (SELECT e FROM e) - INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS b FROM w)
       SELECT s.b AS window_start FROM s WHERE s.b NOT IN (SELECT b FROM w)""",
)
def _(t):
    # As seen an hour after the feed stopped.
    later = t.events.agg(F.max("ts") + F.expr("INTERVAL 1 HOUR")).scalar()
    gaps = status.feed_gaps(t.events, "ts", "5 minutes", end=later)
    return gaps.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"))


@query(
    "K11_windowed_failures",
    """SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n,
       count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1
       HAVING count(*) FILTER (WHERE event_type = 'error') > 0""",
)
def _(t):
    found = status.failures_since(t.events, "ts", F.col("event_type") == "error")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "failures")


@query(
    "K11_stalled",
    """WITH r AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, count(*) AS n FROM events
         WHERE event_type <> 'purchase' GROUP BY 1)
       SELECT b AS window_start, n FROM r WHERE b NOT IN (
         SELECT time_bucket(INTERVAL 30 MINUTE, ts) FROM events WHERE event_type = 'purchase')""",
)
def _(t):
    arrived, done = t.events.filter("event_type <> 'purchase'"), t.events.filter("event_type = 'purchase'")
    found = status.stalled(arrived, done, "ts")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "K11_stream_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def _(t):
    counted = status.windowed_counts(event_stream(t), "ts", "1 hour", watermark="1 hour", keys=["event_type"])
    done = run(counted, t, "update", "windows", ["window_start", "event_type"])
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "K12_rates",
    """WITH s AS (SELECT unnest(range(5)) AS i),
       w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i) AS b, event_type FROM events, s)
       SELECT b AS window_start, count(*) AS n, round(count(*) / 300.0, 6) AS per_second,
       round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_pct FROM w GROUP BY 1""",
)
def _(t):
    found = status.rates(t.events, "ts", failed=F.col("event_type") == "error")
    return found.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "n",
        F.round("per_second", 6).alias("per_second"),
        F.round("success_pct", 6).alias("success_pct"),
    )


@query(
    "K13_mark_failed",
    """SELECT 's3://hl7/' || o_orderkey AS file_path, 'HL7' AS type, 'failed' AS status, 'no workflow' AS error_message,
       TIMESTAMP '2024-06-01' AS processed_at FROM orders""",
)
def _(t):
    manifest = t.orders.select(F.concat(F.lit("s3://hl7/"), F.col("o_orderkey").cast("string")).alias("path"))
    return status.mark_failed(manifest, "no workflow", at=F.lit("2024-06-01").cast("timestamp_ntz"))


POLICY = policy.Policy(
    attribute_filters={
        "facilities": policy.AttributeFilter("sending_facility"),
        "modalities": policy.AttributeFilter("modality", tables=("reports_latest",)),
    },
    masked_columns=("epic_mrn", "patient_age"),
)


def user(**attributes):
    return policy.User("reader", ("user",), True, {k: tuple(v) for k, v in attributes.items()})


@query(
    "K14_row_filter",
    f"""WITH {EXAMS} SELECT 'two' AS who, primary_report_identifier FROM exams
         WHERE sending_facility IN ('NATION_1', 'NATION_2') AND modality = '4-NOT SPECIFIED'
       UNION ALL SELECT 'all', primary_report_identifier FROM exams
       UNION ALL SELECT 'curated', primary_report_identifier FROM exams WHERE sending_facility = 'NATION_7'""",
)
def _(t):
    e = exams(t).select("primary_report_identifier", "sending_facility", "modality")
    bad = "x' OR '1'='1"
    seen = {
        "two": policy.row_filter(
            e, "reports_latest",
            user(facilities=["NATION_1", "NATION_2", bad], modalities=["4-NOT SPECIFIED"]), POLICY,
        ),
        "all": policy.row_filter(e, "reports_latest", user(facilities=["*"], modalities=["*"]), POLICY),
        "curated": policy.row_filter(e, "reports_curated", user(facilities=["NATION_7"]), POLICY),
        "none": policy.row_filter(e, "reports_latest", user(facilities=[bad], modalities=["*"]), POLICY),
    }
    out = None
    for who, df in seen.items():
        part = df.select(F.lit(who).alias("who"), "primary_report_identifier")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "K15_mask",
    f"""WITH {EXAMS} SELECT primary_report_identifier, '[REDACTED]' AS epic_mrn, CAST(NULL AS INTEGER) AS patient_age,
       modality FROM exams""",
)
def _(t):
    masked = policy.mask(exams(t), user(redact_select_identifiers=["true"]), POLICY.masked_columns)
    return masked.select("primary_report_identifier", "epic_mrn", "patient_age", "modality")


@query(
    "K16_governed",
    f"""WITH {EXAMS} SELECT sending_facility, count(*) AS n, count(DISTINCT epic_mrn) AS mrns,
       CAST(2 AS BIGINT) AS denied FROM (SELECT sending_facility, '[REDACTED]' AS epic_mrn FROM exams
       WHERE sending_facility IN ('NATION_1', 'NATION_2', 'NATION_3')) GROUP BY 1""",
)
def _(t):
    reader = user(
        facilities=["NATION_1", "NATION_2", "NATION_3"], modalities=["*"], redact_select_identifiers=["true"]
    )
    denied = 0
    attempts = [
        ("reports_report_patient_mapping", reader),
        ("reports_latest", policy.User("gone", ("user",), enabled=False)),
    ]
    for table, who in attempts:
        try:
            policy.governed(exams(t), table, who, POLICY)
        except policy.AccessDenied:
            denied += 1
    view = policy.governed(exams(t), "reports_latest", reader, POLICY)
    return view.groupBy("sending_facility").agg(
        F.count("*").alias("n"),
        F.count_distinct("epic_mrn").alias("mrns"),
        F.lit(denied).cast("bigint").alias("denied"),
    )
