"""Joins, calendars and longitudinal queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as V
from ..operators import longitudinal as L
from ..operators.windows import newest_per
from .metrics import BURSTS
from .registry import query
from .shapes import EXAMS, exams


@query(
    "J1_left_joins",
    """SELECT o_orderkey, c_name, n_name, l_quantity FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS l_quantity
       FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def _(t):
    returned = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("l_quantity")
    )
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select("o_orderkey", "c_name", "n_name", "l_quantity")
    )


@query(
    "J2_lookup_join",
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def _(t):
    return t.customer.join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select("c_custkey", "n_name")


PAIRS = """a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
  b AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders
    WHERE o_orderdate < TIMESTAMP '1998-01-01')"""


@query(
    "J3_semi_anti_null_safe",
    f"""WITH {PAIRS} SELECT o_orderkey, EXISTS (SELECT 1 FROM b WHERE b.o_custkey = a.o_custkey
       AND b.p IS NOT DISTINCT FROM a.p) AS known FROM a""",
)
def _(t):
    pairs = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("p"),
    )
    new, old = pairs.filter("o_orderdate >= '1998-01-01'"), pairs.filter("o_orderdate < '1998-01-01'")
    old = old.select(F.col("o_custkey").alias("k"), F.col("p").alias("q")).distinct()
    same = (F.col("o_custkey") == F.col("k")) & F.col("p").eqNullSafe(F.col("q"))
    known = new.join(old, same, "left_semi").select("o_orderkey", F.lit(True).alias("known"))
    return known.unionByName(new.join(old, same, "left_anti").select("o_orderkey", F.lit(False).alias("known")))


@query(
    "J4_join_aggregate",
    """WITH m AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
       SELECT o_orderkey, top FROM orders JOIN m USING (o_custkey)""",
)
def _(t):
    top = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t.orders.join(top, "o_custkey").select("o_orderkey", "top")


@query(
    "J5_semi_join_ids",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN
       (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)""",
)
def _(t):
    poor = t.supplier.filter("s_acctbal < 2000").select("s_suppkey")
    return t.lineitem.join(poor, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(
        "l_orderkey", "l_linenumber", "l_suppkey"
    )


@query(
    "J6_before_index",
    """WITH i AS (SELECT o_custkey, min(o_orderdate) AS index_dt FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
       SELECT o_orderkey, index_dt FROM orders JOIN i USING (o_custkey) WHERE o_orderdate < index_dt""",
)
def _(t):
    index = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("index_dt"))
    return L.before_index(t.orders, index, "o_custkey", "o_orderdate").select("o_orderkey", "index_dt")


@query(
    "J7_not_exists",
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
         SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 10)""",
)
def _(t):
    busy = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 10")
    return t.customer.join(busy, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "J8_full_outer_fill",
    """WITH a AS (SELECT l_partkey AS k, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
       b AS (SELECT l_partkey AS k, count(*) AS accepted FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS l_partkey, coalesce(returned, 0) AS returned, coalesce(accepted, 0) AS accepted
       FROM a FULL JOIN b ON a.k = b.k""",
)
def _(t):
    def counted(flag, name):
        return t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count("*").alias(name))

    return counted("R", "returned").join(counted("A", "accepted"), "l_partkey", "full_outer").fillna(0)


@query(
    "J9_pad_grid",
    """WITH g AS (SELECT * FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus),
         (SELECT unnest(['1-URGENT', '5-LOW', '9-NEVER']) AS o_orderpriority)),
       c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (o_orderstatus, o_orderpriority)""",
)
def _(t):
    counted = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    axes = {"o_orderstatus": ["F", "O", "P", "X"], "o_orderpriority": ["1-URGENT", "5-LOW", "9-NEVER"]}
    return L.pad_grid(counted, axes, {"n": 0})


@query(
    "J10_spine",
    """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
       s AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
       SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (day)""",
)
def _(t):
    counted = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return L.spine(t.spark, "1994-12-01", "2001-12-31").join(counted, "day", "left").fillna(0)


@query(
    "J11_union_by_name",
    """SELECT 'customer' AS kind, c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""",
)
def _(t):
    people = t.customer.select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    firms = t.supplier.select(
        F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k")
    )
    return people.unionByName(firms, allowMissingColumns=True)


@query(
    "J12_distinct",
    """SELECT l_orderkey, l_returnflag, min(l_shipdate) AS first_dt FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    # dropDuplicates on a subset keeps any row; the first in order is kept here.
    order = [F.col("l_shipdate")]
    return newest_per(t.lineitem, ["l_orderkey", "l_returnflag"], order).select(
        "l_orderkey", "l_returnflag", F.col("l_shipdate").alias("first_dt")
    )


@query(
    "J13_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(
    "J14_long_span_patients",
    f"""WITH {EXAMS} SELECT patient_id, count(*) AS exams, min(requested_dt) AS earliest, max(requested_dt) AS latest,
       datesub('year', min(requested_dt), max(requested_dt)) AS years_span FROM exams
       WHERE regexp_matches(service_name, '(?i)(urgent|low)') GROUP BY 1
       HAVING count(*) >= 2 AND datesub('year', min(requested_dt), max(requested_dt)) >= 5""",
)
def _(t):
    some = exams(t).filter(F.col("service_name").rlike("(?i)(urgent|low)"))
    return L.long_span_patients(some, "patient_id", "requested_dt")


@query(
    "J15_surveillance",
    f"""WITH {BURSTS}, totals AS (SELECT o_custkey AS patient_id, count(*) AS total_exams,
         count(*) FILTER (WHERE o_orderpriority LIKE '%LOW%') AS mentions FROM orders GROUP BY 1)
       SELECT patient_id, total_exams, mentions, burst_first, burst_last FROM totals JOIN burst USING (patient_id)
       WHERE mentions > 0""",
)
def _(t):
    base = t.orders.withColumnRenamed("o_custkey", "patient_id")
    mention = F.col("o_orderpriority").rlike("(?i)low")
    return L.surveillance(base, "patient_id", "o_orderdate", mention, 3, 6, ["o_orderkey"])


@query(
    "J16_imaging_before",
    f"""WITH {EXAMS}, i AS (SELECT patient_id, min(requested_dt) AS dt FROM exams WHERE report_status = 'P' GROUP BY 1)
       SELECT patient_id, count(*) AS prior_reports, min(requested_dt) AS earliest_imaging,
       max(requested_dt) AS latest_imaging, array_to_string(list_sort(array_agg(DISTINCT modality)), ',') AS modalities
       FROM exams JOIN i USING (patient_id) WHERE requested_dt < dt GROUP BY 1""",
)
def _(t):
    found = L.imaging_before(exams(t), F.col("report_status") == "P", "patient_id", "requested_dt")
    return found.withColumn("modalities", F.array_join("modalities", ","))


@query(
    "J17_patient_history",
    f"""WITH {EXAMS} SELECT epic_mrn, accession_number, requested_dt FROM exams
       WHERE epic_mrn IN ('E1', 'E17', 'E42') OR mpi IN ('E1', 'M77') ORDER BY requested_dt""",
)
def _(t):
    found = L.patient_history(exams(t), ["E1", "E17", "E42", "M77"], "requested_dt", ["epic_mrn", "mpi"])
    return found.select("epic_mrn", "accession_number", "requested_dt")


@query(
    "J17_patient_history_table",
    f"""WITH {EXAMS}, ids AS (SELECT 'E' || (s_suppkey * 7) AS id FROM supplier)
       SELECT epic_mrn, accession_number, requested_dt FROM exams WHERE epic_mrn IN (SELECT id FROM ids)""",
)
def _(t):
    ids = t.supplier.select(F.concat(F.lit("E"), (F.col("s_suppkey") * 7).cast("string")).alias("id"))
    found = L.patient_history(exams(t), ids, "requested_dt", ["epic_mrn", "mpi"])
    return found.select("epic_mrn", "accession_number", "requested_dt")


@query(
    "J16_exams_in_window",
    f"""WITH {EXAMS} SELECT a.accession_number AS accession, b.accession_number AS index_accession FROM exams a
       JOIN exams b ON a.patient_id = b.patient_id AND b.report_status = 'P'
         AND a.requested_dt BETWEEN b.requested_dt - INTERVAL 180 DAY AND b.requested_dt""",
)
def _(t):
    e = exams(t).select("patient_id", F.col("accession_number").alias("accession"), "requested_dt", "report_status")
    index = e.filter("report_status = 'P'").select(
        "patient_id", F.col("accession").alias("index_accession"), F.col("requested_dt").alias("index_dt")
    )
    found = V.within(e, index, "patient_id", "requested_dt", "index_dt", 180 * 86_400)
    return found.select("accession", "index_accession")


@query(
    "J6_nearest_before",
    f"""WITH {EXAMS}, e AS (SELECT patient_id, o_orderkey, requested_dt, report_status FROM exams),
       m AS (SELECT patient_id, requested_dt, max(o_orderkey) AS prior FROM e
         WHERE report_status <> 'P' GROUP BY ALL)
       SELECT i.o_orderkey AS index_key, m.prior, m.requested_dt AS prior_dt FROM (SELECT * FROM e WHERE report_status = 'P') i
       ASOF LEFT JOIN m ON i.patient_id = m.patient_id AND i.requested_dt > m.requested_dt""",
)
def _(t):
    e = exams(t)
    index = e.filter("report_status = 'P'").select("patient_id", F.col("o_orderkey").alias("index_key"), F.col("requested_dt").alias("index_dt"))
    prior = e.filter("report_status <> 'P'").select(
        "patient_id", "requested_dt", F.col("o_orderkey").alias("prior"), F.col("requested_dt").alias("prior_dt")
    )
    found = V.nearest_before(prior, index, "patient_id", "requested_dt", "index_dt", ["prior", "prior_dt"], ["prior"])
    return found.select("index_key", "prior", "prior_dt")


@query(
    "J6_overlapping_stays",
    """WITH s AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS e
         FROM orders)
       SELECT x.p, x.k AS first_stay, y.k AS second_stay FROM s x JOIN s y ON x.p = y.p AND x.k < y.k AND x.a <= y.e AND y.a <= x.e""",
)
def _(t):
    days = F.make_dt_interval(days=(F.col("o_orderkey") % 60).cast("int"))
    stays = t.orders.select(
        F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + days).alias("e")
    )
    found = V.overlaps(stays, stays, "p", "a", "e").filter("k < k_b")
    return found.select("p", F.col("k").alias("first_stay"), F.col("k_b").alias("second_stay"))
