"""Upserts, change rows, the cascade and curation rules over the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import changes as C
from ..operators import curate, layout, status
from ..operators import maintained as M
from ..session import cut, scratch_path
from ..sources.messages import parse_messages
from ..streaming.cascade import Derivative, ReportTables, run_cascade
from ..streaming.tables import MergeTable
from .registry import query
from .shapes import EXAMS, SOURCE, diagnosis_array, exams, hl7_messages, part_reports


@query(
    "C1_content_hash",
    """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment ||
       '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS content_hash,
       true AS order_free, true AS null_free FROM customer""",
)
def _(t):
    base = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    turned = base.select("c_mktsegment", "c_nationkey", "c_custkey", "c_name").withColumn(
        "updated", F.current_timestamp()
    )
    padded = base.withColumn("never_set", F.lit(None).cast("string"))
    a, b, c = (C.with_content_hash(x) for x in (base, turned, padded))
    return (
        a.select("c_custkey", "content_hash")
        .join(b.select("c_custkey", F.col("content_hash").alias("hb")), "c_custkey")
        .join(c.select("c_custkey", F.col("content_hash").alias("hc")), "c_custkey")
        .select(
            "c_custkey",
            "content_hash",
            (F.col("content_hash") == F.col("hb")).alias("order_free"),
            (F.col("content_hash") == F.col("hc")).alias("null_free"),
        )
    )


def dated_orders(t):
    return t.orders.select(
        F.col("o_orderkey").alias("source_file"),
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.year("o_orderdate").alias("year"),
    )


def next_batch_of_orders(t):
    """All orders again: the F ones changed, the rest as before."""
    return dated_orders(t).withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "changed").otherwise(F.col("o_orderpriority")),
    )


@query(
    "C2_drop_unchanged",
    "SELECT o_orderkey AS source_file, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'",
)
def _(t):
    stored = C.with_content_hash(dated_orders(t).filter("o_orderstatus <> 'P'"))
    batch = C.with_content_hash(next_batch_of_orders(t))
    return C.drop_unchanged(batch, stored).select("source_file", "o_orderstatus")


@query(
    "C3_upsert",
    """SELECT c_custkey, c_name,
       CASE WHEN c_mktsegment <> 'BUILDING' AND -c_acctbal > c_acctbal THEN -c_acctbal ELSE c_acctbal END
         AS c_acctbal,
       CASE WHEN c_mktsegment <> 'BUILDING' AND -c_acctbal > c_acctbal THEN 'flipped' END AS note FROM customer
       UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal, 'new' FROM supplier""",
)
def _(t):
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    flipped = t.customer.filter("c_mktsegment <> 'BUILDING'").select(
        "c_custkey", "c_name", (-F.col("c_acctbal")).alias("c_acctbal"), F.lit("flipped").alias("note")
    )
    fresh = t.supplier.select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("new").alias("note"),
    )
    return C.upsert(target, flipped.unionByName(fresh), "c_custkey", "s.c_acctbal > t.c_acctbal")


@query(
    "C3_change_rows",
    """SELECT o_orderkey AS source_file,
       CASE o_orderstatus WHEN 'F' THEN 'update_postimage' WHEN 'P' THEN 'insert' END AS _change_type
       FROM orders WHERE o_orderstatus <> 'O'
       UNION ALL SELECT -1 - n_nationkey, 'delete' FROM nation""",
)
def _(t):
    gone = t.nation.select(
        (-1 - F.col("n_nationkey").cast("bigint")).alias("source_file"), F.col("n_name").alias("o_orderpriority")
    )
    old = dated_orders(t).filter("o_orderstatus <> 'P'").unionByName(gone, allowMissingColumns=True)
    return C.change_rows(old, next_batch_of_orders(t), "source_file").select("source_file", "_change_type")


@query(
    "C4_merge_reports",
    """SELECT 'table' AS part, CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE o_orderpriority END AS
       o_orderpriority, count(*) AS n FROM orders GROUP BY ALL
       UNION ALL SELECT 'changed', CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE o_orderpriority END, count(*)
       FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL
       UNION ALL SELECT 'again', 'none', CAST(0 AS BIGINT)""",
)
def _(t):
    stored, _ = C.merge_reports(
        dated_orders(t).limit(0), dated_orders(t).filter("o_orderstatus <> 'P'")
    )
    merged, changed = C.merge_reports(stored, next_batch_of_orders(t))
    _, again = C.merge_reports(merged, next_batch_of_orders(t))

    def counted(df, part):
        return df.groupBy(F.lit(part).alias("part"), "o_orderpriority").agg(F.count("*").alias("n"))

    none = again.agg(F.count("*").alias("n")).select(
        F.lit("again").alias("part"), F.lit("none").alias("o_orderpriority"), "n"
    )
    return counted(merged, "table").unionByName(counted(changed, "changed")).unionByName(none)


def line_feed(t):
    """Line items as a change feed over their order."""
    kind = (
        F.when(F.col("l_returnflag") == "A", "insert")
        .when(F.col("l_returnflag") == "N", "update_postimage")
        .otherwise("delete")
    )
    version = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10 + F.col("l_linenumber")
    return t.lineitem.withColumns({"_change_type": kind, "_commit_version": version}).withColumn(
        "_commit_timestamp", F.col("l_shipdate")
    )


@query(
    "C5_latest_changes",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber DESC) AS rn
         FROM lineitem WHERE l_returnflag IN ('A', 'N')) WHERE rn = 1""",
)
def _(t):
    return C.latest_changes(line_feed(t), "l_orderkey").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )


def keyed_lines(t):
    """Line items of an order; those of small quantity have no usable key."""
    key = F.when(F.col("l_quantity") > 5, F.col("l_orderkey").cast("string")).otherwise(F.lit("  "))
    return t.lineitem.withColumn("accession", key)


TIES = ["l_linenumber", "l_partkey", "l_suppkey"]


MAINTAINED = """final AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '2-HIGH' ELSE o_orderpriority END AS p,
         CAST(o_totalprice AS DECIMAL(18, 2)) AS price, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')"""


def maintained(t, keys, sums=(), distinct=None):
    """Three commits of orders: all but the latest, updates and deletes, the latest; the second arrives twice."""
    rows = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("p"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderdate"
    )
    held = M.MaintainedAggregate(t.spark, scratch_path(t.spark, "counts"), keys, sums, distinct)
    moved = rows.filter("o_orderstatus <> 'P'").withColumn("p", F.when(F.col("p") == "1-URGENT", "2-HIGH").otherwise(F.col("p")))
    early = "o_orderdate < '1997-01-01'"
    commits = [(rows.limit(0), rows.filter(early)), (rows.filter(early), moved.filter(early)), (moved.filter(early), moved)]
    for version in (0, 1, 1, 2):
        old, new = commits[version]
        held.apply(version, C.change_rows(old, new, "o_orderkey", preimages=True))
        if version == 1:
            held.fold(0)
    return held.read()


@query(
    "C5_maintained_sums",
    f"""WITH {MAINTAINED} SELECT p, o_orderstatus, count(*) AS n, CAST(sum(price) AS DOUBLE) AS sum_price FROM final GROUP BY 1, 2""",
)
def _(t):
    found = maintained(t, ["p", "o_orderstatus"], ["price"])
    return found.select("p", "o_orderstatus", "n", F.col("sum_price").cast("double").alias("sum_price"))


@query("H1_maintained_distinct", f"WITH {MAINTAINED} SELECT p, count(DISTINCT o_custkey) AS n FROM final GROUP BY 1")
def _(t):
    return maintained(t, ["p"], distinct="o_custkey")


@query(
    "C6_dedupe_newest",
    """SELECT CAST(l_orderkey AS VARCHAR) AS accession, l_partkey, l_suppkey, l_shipdate FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
         FROM lineitem WHERE l_quantity > 5) WHERE rn = 1""",
)
def _(t):
    return C.dedupe_newest(keyed_lines(t), "accession", "l_shipdate", TIES).select(
        "accession", "l_partkey", "l_suppkey", "l_shipdate"
    )


def base_reports(t):
    """Base report rows from orders and customers, several message versions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    version = (
        F.when(F.col("o_orderstatus") == "F", "2.7").when(F.col("o_orderstatus") == "O", "2.4").otherwise("2.3")
    )
    return e.select(
        name("in/", "o_orderkey").alias("source_file"),
        version.alias("version_id"),
        name("M", "o_custkey").alias("mpi"),
        F.when(F.col("c_nationkey") >= 8, name("E", "o_custkey")).alias("epic_mrn"),
        F.when(F.col("c_nationkey") < 8, name("B", "o_custkey")).alias("mbmc_mr"),
        F.when(F.col("c_nationkey") >= 4, name("M", "o_custkey")).alias("empi_mr"),
        F.when(F.col("c_nationkey") >= 16, name("J", "o_custkey")).alias("bjh_mr"),
        name("S", "o_custkey").alias("slch_mr"),
        name("W", "o_custkey").alias("bjwc_ee"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")).otherwise(name("P", "o_orderkey")).alias(
            "obr_2_placer_order_number"
        ),
        name("Q", "o_orderkey").alias("orc_2_placer_order_number"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(""))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("  "))
        .otherwise(name("F", "o_orderkey"))
        .alias("obr_3_filler_order_number"),
        name("G", "o_orderkey").alias("orc_3_filler_order_number"),
        F.add_months(F.lit("1880-01-31").cast("date"), (F.col("o_custkey") % 1400).cast("int")).alias("birth_date"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("message_dt"),
        F.col("o_orderdate").cast("timestamp").alias("requested_dt"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate").cast("timestamp")).alias("observation_dt"),
        diagnosis_array(
            (F.col("o_orderpriority"), F.col("c_mktsegment")),
            (name("N", "c_nationkey"), F.lit("nation")),
        ).alias("diagnoses"),
        F.year("o_orderdate").alias("year"),
    )


BASE = """base AS (
  SELECT *, 'in/' || o_orderkey AS report,
    CASE o_orderstatus WHEN 'F' THEN '2.7' WHEN 'O' THEN '2.4' ELSE '2.3' END AS version_id,
    'M' || o_custkey AS mpi, CASE WHEN c_nationkey >= 8 THEN 'E' || o_custkey END AS epic_mrn,
    CASE WHEN c_nationkey < 8 THEN 'B' || o_custkey END AS mbmc_mr,
    CASE WHEN c_nationkey >= 4 THEN 'M' || o_custkey END AS empi_mr,
    CASE WHEN c_nationkey >= 16 THEN 'J' || o_custkey END AS bjh_mr, 'S' || o_custkey AS slch_mr,
    'W' || o_custkey AS bjwc_ee,
    CAST(DATE '1880-01-31' + to_months(CAST(o_custkey % 1400 AS INTEGER)) AS DATE) AS birth
  FROM orders JOIN customer ON o_custkey = c_custkey),
curated AS (
  SELECT *,
    CASE version_id
      WHEN '2.7' THEN coalesce('epic_mrn_' || epic_mrn, 'mbmc_mr_' || mbmc_mr, 'empi_mr_' || empi_mr)
      WHEN '2.4' THEN coalesce('bjh_mr_' || bjh_mr, 'slch_mr_' || slch_mr) ELSE 'mpi_' || mpi END AS primary_id,
    CASE version_id WHEN '2.7' THEN empi_mr WHEN '2.4' THEN bjwc_ee ELSE mpi END AS patient_mpi,
    CASE WHEN version_id = '2.7' THEN coalesce(epic_mrn, mbmc_mr) END AS patient_epic,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'G' WHEN '2-HIGH' THEN '  ' ELSE 'F' END AS prefix,
    CASE WHEN birth > DATE '1905-01-01' THEN birth END AS sane_birth FROM base),
final AS (
  SELECT *, CASE WHEN prefix = '  ' THEN prefix ELSE prefix || o_orderkey END AS accession,
    CAST(datesub('year', CAST(sane_birth AS TIMESTAMP), o_orderdate) AS INTEGER) AS age FROM curated)"""


@query(
    "C7_curate",
    f"""WITH {BASE} SELECT report AS primary_report_identifier, accession AS accession_number,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Q' ELSE 'P' END || o_orderkey AS placer_order_number,
       accession AS primary_study_identifier, primary_id AS primary_patient_identifier, patient_mpi,
       CASE WHEN age > 109 THEN NULL ELSE sane_birth END AS birth_date,
       CASE WHEN age > 109 THEN NULL ELSE age END AS patient_age FROM final WHERE trim(accession) <> ''""",
)
def _(t):
    return curate.curate(base_reports(t)).select(
        "primary_report_identifier",
        "accession_number",
        "placer_order_number",
        "primary_study_identifier",
        "primary_patient_identifier",
        "patient_mpi",
        "birth_date",
        "patient_age",
    )


@query(
    "C8_maintain_latest",
    """SELECT accession, l_partkey, l_suppkey, l_shipdate FROM (
         SELECT *, CAST(l_orderkey AS VARCHAR) AS accession, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate DESC, l_returnflag = 'R', l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
         FROM lineitem WHERE l_quantity > 5) WHERE rn = 1""",
)
def _(t):
    lines = keyed_lines(t).select("accession", "l_shipdate", "l_returnflag", *TIES)
    first = C.maintain_latest(None, lines.filter("l_returnflag <> 'R'"), "accession", "l_shipdate", TIES)
    second = C.maintain_latest(first, lines.filter("l_returnflag = 'R'"), "accession", "l_shipdate", TIES)
    return second.select("accession", "l_partkey", "l_suppkey", "l_shipdate")


@query(
    "C9_replace_dx",
    """WITH ranked AS (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R'
           ORDER BY l_shipdate DESC, l_partkey * 100000000 + l_suppkey * 10 + l_linenumber DESC) AS rn,
           max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS touched
         FROM lineitem JOIN part ON l_partkey = p_partkey),
       kept AS (SELECT *, l_partkey * 100000000 + l_suppkey * 10 + l_linenumber AS report FROM ranked
         WHERE rn = 1 AND (l_returnflag = 'R' OR touched = 0))
       SELECT CAST(l_orderkey AS VARCHAR) AS accession, report || '_0' AS diagnosis_id, p_brand AS diagnosis_code,
              p_name AS diagnosis_code_text FROM kept
       UNION ALL SELECT CAST(l_orderkey AS VARCHAR), report || '_1', p_type || '-' || p_size, p_type FROM kept""",
)
def _(t):
    rows = part_reports(t).select(
        F.col("l_orderkey").cast("string").alias("accession"),
        (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("report"),
        "l_shipdate",
        "l_returnflag",
        "diagnoses",
    )
    first = C.replace_dx(
        None, rows.filter("l_returnflag <> 'R'"), "accession", order="l_shipdate", report="report"
    )
    second = C.replace_dx(
        first, rows.filter("l_returnflag = 'R'"), "accession", order="l_shipdate", report="report"
    )
    return second.select("accession", "diagnosis_id", "diagnosis_code", "diagnosis_code_text")


CASCADE_SQL = f"""WITH {BASE}, good AS (SELECT * FROM final WHERE trim(accession) <> '')
SELECT 'reports' AS tbl, report AS k, version_id AS v FROM base
UNION ALL SELECT 'reports_curated', report, primary_id FROM good
UNION ALL SELECT 'reports_latest', accession, report FROM good
UNION ALL SELECT 'reports_dx', report || '_0', o_orderpriority FROM good
UNION ALL SELECT 'reports_dx', report || '_1', 'N' || c_nationkey FROM good
UNION ALL SELECT 'reports_report_patient_mapping', report, patient_mpi FROM good
UNION ALL SELECT 'replaced', report || '_2', 'delete' FROM good WHERE version_id = '2.7' AND year(o_orderdate) < 1998
UNION ALL SELECT 'commits_of_a_repeat', 'n', '0'"""


@query("C10_run_cascade", CASCADE_SQL)
def _(t):
    tables = ReportTables(t.spark, scratch_path(t.spark, "tables"))
    reports = base_reports(t)
    # Some early reports come in an older form with one diagnosis more.
    older = F.col("version_id") == "2.7"
    third = F.array(F.get("diagnoses", F.lit(0)))
    early = reports.filter("year < 1998").withColumns(
        {
            "message_dt": F.when(older, F.col("message_dt") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("message_dt")),
            "diagnoses": F.when(older, F.concat("diagnoses", third)).otherwise(F.col("diagnoses")),
        }
    )
    tables.ingest(0, early)
    tables.refresh()
    # Updates of those, reports of later years, and rows that are known already.
    tables.ingest(1, reports)
    tables.refresh()
    repeated = tables.ingest(2, reports)
    tables.refresh()
    shown = (
        ("reports", tables.base, "source_file", "version_id"),
        ("reports_curated", tables.curated, "primary_report_identifier", "primary_patient_identifier"),
        ("reports_latest", tables.latest, "accession_number", "primary_report_identifier"),
        ("reports_dx", tables.dx, "diagnosis_id", "diagnosis_code"),
        ("reports_report_patient_mapping", tables.mapping, "primary_report_identifier", "mpi"),
    )
    out = None
    for name, table, key, value in shown:
        part = table.read().select(F.lit(name).alias("tbl"), F.col(key).alias("k"), F.col(value).alias("v"))
        out = part if out is None else out.unionByName(part)
    gone = tables.dx.changes().filter("_change_type = 'delete'")
    gone = gone.select(F.lit("replaced").alias("tbl"), F.col("diagnosis_id").alias("k"), F.col("_change_type").alias("v"))
    none = t.orders.agg(F.lit("n").alias("k"), F.lit(str(int(repeated))).alias("v"))
    return out.unionByName(gone).unionByName(none.select(F.lit("commits_of_a_repeat").alias("tbl"), "k", "v"))


@query(
    "C11_derivative_tables",
    """SELECT o_custkey, o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
       AS second_commit FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
         ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def _(t):
    root = scratch_path(t.spark, "dag")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    base = MergeTable(t.spark, f"{root}/orders", "o_orderkey")
    newest = MergeTable(t.spark, f"{root}/orders_newest", "o_custkey")

    def keep_newest(batch, version):
        incoming = C.dedupe_newest(
            C.latest_changes(batch, "o_orderkey").withColumn("key", F.col("o_custkey").cast("string")),
            "key", "o_orderdate", ["o_orderkey"],
        )
        newest.upsert(version, incoming.drop("key"), "s.o_orderdate > t.o_orderdate")

    dag = [Derivative("orders", "orders_newest", keep_newest)]
    base.upsert(0, orders.filter("o_orderdate < '1998-01-01'"))
    run_cascade(t.spark, root, dag, f"{root}/_checkpoints")
    # The second batch repeats the first; only what is new becomes a change.
    base.upsert(1, orders)
    run_cascade(t.spark, root, dag, f"{root}/_checkpoints")
    second = base.changes().filter("_commit_version = 1").agg(F.count("*"))
    return newest.read().withColumn("second_commit", second.scalar())


@query(
    "C12_delete_matched",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN
       (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(t):
    keys = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.delete_matched(t.orders.select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query(
    "C13_top_up",
    """SELECT o_orderkey, o_orderstatus, CAST(NULL AS BOOLEAN) AS detected FROM orders
       WHERE o_orderstatus <> 'F'""",
)
def _(t):
    target = t.orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_orderstatus", F.lit(True).alias("detected")
    )
    return C.top_up(target, t.orders, "o_orderkey")


@query(
    "C14_write_back",
    """SELECT d.doc_id, lang, quality, CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2024-06-01' END AS stamped
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    when = F.lit("2024-06-01").cast("timestamp_ntz")
    return C.write_back(t.documents.select("doc_id", "lang"), t.labels, "doc_id", ["quality"], "stamped", when)


@query("C15_compact", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return C.compact(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query(
    "C15_clustered",
    """SELECT 'date' AS wanted, count(*) AS n, true AS skips FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-01'
       UNION ALL SELECT 'facility', count(*), true FROM orders WHERE o_orderpriority BETWEEN '2-HIGH' AND '2-HIGH'
       UNION ALL SELECT 'accession', count(*), true FROM orders WHERE o_orderkey BETWEEN 100 AND 200""",
)
def _(t):
    path = scratch_path(t.spark, "clustered")
    layout.write_clustered(t.orders, path, ["o_orderdate", "o_orderpriority", "o_orderkey"], ["o_orderkey"], partitions=24)
    laid = t.spark.read.parquet(path)
    wanted = {
        "date": ("o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1996, 3, 1)),
        "facility": ("o_orderpriority", "2-HIGH", "2-HIGH"),
        "accession": ("o_orderkey", 100, 200),
    }
    parts = []
    for name, (c, low, high) in wanted.items():
        groups = layout.groups_read(t.spark, path, {c: (low, high)}).select((F.col("n_read") < F.col("n_groups")).alias("skips"))
        rows = laid.filter(F.col(c).between(F.lit(low), F.lit(high))).agg(F.count("*").alias("n"))
        parts.append(rows.select(F.lit(name).alias("wanted"), "n", groups.scalar().alias("skips")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "C16_working_copy",
    f"""WITH {EXAMS} SELECT primary_report_identifier, accession_number, modality, CAST(NULL AS BOOLEAN)
       AS followup_detected, CAST(NULL AS VARCHAR) AS followup_confidence, CAST(NULL AS VARCHAR) AS followup_snippet,
       CAST(NULL AS VARCHAR) AS followup_finding, CAST(NULL AS TIMESTAMP) AS followup_processed_at FROM exams""",
)
def _(t):
    return C.working_copy(exams(t), ["primary_report_identifier", "accession_number", "modality"])


@query(
    "D1_first_non_empty",
    """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'Q' ELSE CASE WHEN o_orderpriority = '2-HIGH' THEN '  '
       ELSE 'P' END END AS code, count(*) AS n FROM orders GROUP BY 1""",
)
def _(t):
    a = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(""))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("  "))
        .otherwise(F.lit("P"))
    )
    picked = rules.first_non_empty(a, F.lit("Q"))
    return t.orders.groupBy(picked.alias("code")).agg(F.count("*").alias("n"))


@query(
    "D2_primary_patient_id",
    f"WITH {BASE} SELECT report AS source_file, primary_id FROM final",
)
def _(t):
    b = base_reports(t)
    return b.select("source_file", rules.primary_patient_id(b).alias("primary_id"))


@query("D3_patient_mpi", f"WITH {BASE} SELECT report AS source_file, patient_mpi FROM final")
def _(t):
    b = base_reports(t)
    return b.select("source_file", rules.patient_mpi(b).alias("patient_mpi"))


@query(
    "D4_exam_date",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_shipdate ELSE o_orderdate END
       AS exam_dt FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    observed = F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", rules.exam_date(observed, F.col("o_orderdate")).alias("exam_dt")
    )


@query(
    "D5_sane_birth_date",
    """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1998-01-01' THEN CAST(o_orderdate AS DATE) END
       AS birth_date FROM orders""",
)
def _(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", rules.sane_birth_date(day, "1998-01-01").alias("birth_date"))


@query(
    "D6_age_years",
    """SELECT CAST(datesub('year', o_orderdate - INTERVAL 30 YEAR, l_shipdate) AS INTEGER) AS age, count(*) AS n
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    birth = F.col("o_orderdate") - F.expr("INTERVAL 30 YEAR")
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(rules.age_years(birth, F.col("l_shipdate")).alias("age")).agg(
        F.count("*").alias("n")
    )


@query(
    "D7_anticipated",
    "SELECT c_custkey, c_name AS present, CAST(NULL AS VARCHAR) AS absent FROM customer",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        rules.anticipated(t.customer, "c_name").alias("present"),
        rules.anticipated(t.customer, "epic_mrn").alias("absent"),
    )


@query(
    "D8_require_key",
    """SELECT count(*) FILTER (WHERE l_quantity > 5) AS kept, count(*) FILTER (WHERE l_quantity <= 5) AS dropped
       FROM lineitem""",
)
def _(t):
    seen = Observation()
    kept = C.require_key(keyed_lines(t), "accession", seen).agg(F.count("*").alias("kept"))
    found = cut(kept)  # the observation is filled as the rows are counted
    return found.withColumn("dropped", F.lit(seen.get["dropped"]).cast("bigint"))


@query(
    "B_to_C_message_pipeline",
    f"""WITH {SOURCE} SELECT coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN k ELSE '' END, ''), 'F' || k)
       AS accession_number, 'epic_mrn_' || cust AS primary_patient_identifier,
       CAST(datesub('year', TIMESTAMP '1960-02-15', o_orderdate) AS INTEGER) AS patient_age FROM src""",
)
def _(t):
    reports = curate.build_reports(parse_messages(hl7_messages(t), keep=["source_file"]))
    return curate.curate(reports).select("accession_number", "primary_patient_identifier", "patient_age")




@query(
    "B_to_C_ingest_status",
    f"""WITH {SOURCE}, f AS (SELECT source_file, regexp_matches(source_file, '7\\.hl7$') AS broken FROM src)
       SELECT source_file AS file_path, CASE WHEN broken THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN broken THEN 'File is not parsable as HL7' END AS error_message, NOT broken AS stored FROM f""",
)
def _(t):
    broken = F.col("source_file").rlike(r"7\.hl7$")
    content = hl7_messages(t).withColumn("content", F.when(broken, F.lit("no message")).otherwise(F.col("content")))
    tables = ReportTables(t.spark, scratch_path(t.spark, "ingested"))
    tables.ingest_messages(0, parse_messages(content, keep=["source_file"]))
    now = status.current_status(t.spark.read.parquet(tables.status_path))
    stored = tables.base.read().select(F.col("source_file").alias("file_path"), F.lit(True).alias("stored"))
    return now.join(stored, "file_path", "left").select(
        "file_path", "status", "error_message", F.coalesce("stored", F.lit(False)).alias("stored")
    )
