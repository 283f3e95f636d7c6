"""Patient identity over the driver tables.

Orders carry a customer as one identifier and the customer's nation as the other.
An order of status P carries both, so customers with such an order join their
nation's component: a few very large patients, many small ones, and reports
without any identifier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators.curate import curate
from ..operators.windows import newest_per
from ..session import scratch_path
from ..streaming.tables import MergeTable
from .maintenance import BASE, base_reports
from .registry import query
from .shapes import EXAMS, exams

CUT = "1998-01-01"


def links(t):
    status, both = F.col("o_orderstatus"), F.col("o_orderstatus") == "P"
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("primary_report_identifier"),
        F.when(status != "O", F.concat(F.lit("M"), F.col("o_custkey").cast("string"))).alias("mpi"),
        F.when(
            both | ((status == "O") & (F.col("o_orderpriority") != "5-LOW")),
            F.concat(F.lit("E"), F.col("c_nationkey").cast("string")),
        ).alias("epic_mrn"),
        "o_orderdate",
    )


def early(t):
    return links(t).filter(F.col("o_orderdate") < CUT).drop("o_orderdate")


def late(t):
    return links(t).filter(F.col("o_orderdate") >= CUT).drop("o_orderdate")


LINKS = f"""l AS (
  SELECT 'o' || o_orderkey AS report, o_custkey, c_nationkey, o_orderstatus, o_orderdate < TIMESTAMP '{CUT}' AS early,
    CASE WHEN o_orderstatus <> 'O' THEN 'M' || o_custkey END AS mpi,
    CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority <> '5-LOW')
      THEN 'E' || c_nationkey END AS epic
  FROM orders JOIN customer ON o_custkey = c_custkey),
comp1 AS (
  SELECT *, CASE WHEN epic IS NOT NULL THEN epic WHEN mpi IS NULL THEN 'none'
    WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) = 1
      THEN 'E' || c_nationkey ELSE mpi END AS c FROM l WHERE early),
map1 AS (
  SELECT *, sha256(min(report) OVER (PARTITION BY c)) AS patient_id,
    coalesce(min(mpi) OVER (PARTITION BY c) = max(mpi) OVER (PARTITION BY c), true)
    AND coalesce(min(epic) OVER (PARTITION BY c) = max(epic) OVER (PARTITION BY c), true) AS consistent FROM comp1),
comp AS (
  SELECT *, CASE WHEN epic IS NOT NULL THEN epic WHEN mpi IS NULL THEN 'none'
    WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) = 1
      THEN 'E' || c_nationkey ELSE mpi END AS c FROM l),
whole AS (
  SELECT *, min(report) OVER (PARTITION BY c) AS first_report,
    coalesce(min(mpi) OVER (PARTITION BY c) = max(mpi) OVER (PARTITION BY c), true)
    AND coalesce(min(epic) OVER (PARTITION BY c) = max(epic) OVER (PARTITION BY c), true) AS consistent FROM comp)"""


def by_first_report(mapping):
    """Patients named after their smallest report, which does not depend on batches."""
    first = mapping.groupBy("patient_id").agg(F.min("primary_report_identifier").alias("first_report"))
    return mapping.join(first, "patient_id").select(
        "primary_report_identifier", "mpi", "epic_mrn", "first_report", "consistent"
    )


@query(
    "E1_resolve_ids",
    f"""WITH {BASE} SELECT report AS primary_report_identifier, patient_mpi AS mpi, patient_epic AS epic_mrn
       FROM final WHERE trim(accession) <> ''""",
)
def _(t):
    return I.resolve_ids(curate(base_reports(t)))


@query("E2_unmapped", f"WITH {LINKS} SELECT report AS primary_report_identifier FROM l WHERE NOT early")
def _(t):
    return I.unmapped(links(t), I._as_new(early(t))).select("primary_report_identifier")


@query(
    "E3_defer_exact",
    f"""WITH {LINKS}, ranked AS (
         SELECT report, row_number() OVER (PARTITION BY mpi, epic ORDER BY report) AS rn,
           EXISTS (SELECT 1 FROM l k WHERE k.early AND k.mpi IS NOT DISTINCT FROM l.mpi
                   AND k.epic IS NOT DISTINCT FROM l.epic) AS known FROM l WHERE NOT early)
       SELECT report AS primary_report_identifier, known OR rn > 1 AS deferred FROM ranked""",
)
def _(t):
    rest, deferred = I.defer_exact(late(t), I._as_new(early(t)))
    return rest.select("primary_report_identifier", F.lit(False).alias("deferred")).unionByName(
        deferred.select("primary_report_identifier", F.lit(True).alias("deferred"))
    )


@query(
    "E4_disjoint_new",
    f"""WITH {LINKS}, firsts AS (
         SELECT mpi, epic, min(report) AS report FROM l WHERE NOT early GROUP BY ALL),
       rest AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.early
         AND k.mpi IS NOT DISTINCT FROM f.mpi AND k.epic IS NOT DISTINCT FROM f.epic)),
       alone AS (SELECT r.* FROM rest r WHERE coalesce(mpi, epic) IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM l k WHERE k.early AND (k.mpi = r.mpi OR k.epic = r.epic))
         AND NOT EXISTS (SELECT 1 FROM rest o WHERE o.report <> r.report AND (o.mpi = r.mpi OR o.epic = r.epic)))
       SELECT report AS primary_report_identifier, mpi, epic AS epic_mrn, sha256(report) AS patient_id,
       true AS consistent FROM alone UNION ALL SELECT 'n' || n_nationkey, 'X' || n_nationkey, NULL,
       sha256('n' || n_nationkey), true FROM nation""",
)
def _(t):
    extra = t.nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("primary_report_identifier"),
        F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("mpi"),
        F.lit(None).cast("string").alias("epic_mrn"),
    )
    known = I._as_new(early(t))
    rest, _ = I.defer_exact(late(t).unionByName(extra), known)
    return I.disjoint_new(rest, known)


@query(
    "E5_inherit_single",
    f"""WITH {LINKS}, owner AS (SELECT coalesce(mpi, epic) AS id, min(sha256(report)) AS patient_id FROM l
         WHERE early AND (mpi IS NULL) <> (epic IS NULL) GROUP BY 1),
       single AS (SELECT *, coalesce(mpi, epic) AS id FROM l WHERE NOT early AND (mpi IS NULL) <> (epic IS NULL)),
       fresh AS (SELECT id, sha256(min(report)) AS patient_id FROM single GROUP BY 1)
       SELECT report AS primary_report_identifier, mpi, epic AS epic_mrn,
         coalesce(o.patient_id, f.patient_id) AS patient_id, true AS consistent
       FROM single JOIN fresh f USING (id) LEFT JOIN owner o USING (id)""",
)
def _(t):
    known = early(t).filter(F.col("mpi").isNull() != F.col("epic_mrn").isNull())
    return I.inherit_single(late(t), I._as_new(known))


@query(
    "E6_closure",
    f"""WITH {LINKS}, hit AS (SELECT DISTINCT m.c FROM map1 m WHERE EXISTS (SELECT 1 FROM l k WHERE NOT k.early
         AND k.o_orderstatus = 'P' AND (k.mpi = m.mpi OR k.epic = m.epic)))
       SELECT report AS primary_report_identifier, mpi, epic AS epic_mrn, patient_id, consistent
       FROM map1 WHERE c IN (SELECT c FROM hit)""",
)
def _(t):
    seeds = late(t).filter("mpi IS NOT NULL AND epic_mrn IS NOT NULL")
    return I.closure(I.build_mapping(early(t)), seeds)


@query(
    "E7_connected_components",
    """WITH RECURSIVE e AS (
         SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem
         UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
         UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
       adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
       walk(vertex, component) USING KEY (vertex) AS (
         SELECT DISTINCT a, a FROM adj
         UNION
         SELECT r.vertex, min(w.component) FROM walk w JOIN adj ON w.vertex = adj.a
         JOIN recurring.walk r ON r.vertex = adj.b WHERE w.component < r.component GROUP BY r.vertex)
       SELECT vertex, component FROM walk""",
)
def _(t):
    def edge(a, x, b, y):
        return (
            F.concat(F.lit(a), F.col(x).cast("string")).alias("a"),
            F.concat(F.lit(b), F.col(y).cast("string")).alias("b"),
        )

    edges = (
        t.lineitem.select(*edge("p", "l_partkey", "s", "l_suppkey"))
        .unionByName(t.customer.select(*edge("c", "c_custkey", "n", "c_nationkey")))
        .unionByName(t.nation.select(*edge("n", "n_nationkey", "r", "n_regionkey")))
    )
    return I.connected_components(edges)


@query(
    "E7_update_mapping",
    f"""WITH {LINKS} SELECT report AS primary_report_identifier, mpi, epic AS epic_mrn, first_report, consistent
       FROM whole""",
)
def _(t):
    first = I.build_mapping(early(t))
    return by_first_report(I.update_mapping(first, late(t))[0])


@query(
    "E8_consistency",
    f"""WITH {LINKS} SELECT c_nationkey, coalesce(min(mpi) = max(mpi), true) AND coalesce(min(epic) = max(epic), true)
       AS consistent FROM l GROUP BY 1""",
)
def _(t):
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("primary_report_identifier"), "c_nationkey"
    )
    rows = links(t).join(named, "primary_report_identifier")
    return I.consistency(rows, "c_nationkey")


@query(
    "E9_mapping_history",
    f"""WITH {LINKS}, renamed AS (
         SELECT m.report, m.mpi, m.epic, m.patient_id AS previous_patient_id, m.consistent AS was, w.consistent,
           min(m.patient_id) OVER (PARTITION BY w.c) AS patient_id FROM map1 m JOIN whole w ON w.report = m.report)
       SELECT report AS primary_report_identifier, mpi, epic AS epic_mrn, patient_id, consistent,
         previous_patient_id FROM renamed WHERE patient_id <> previous_patient_id OR was <> consistent""",
)
def _(t):
    return I.update_mapping(I.build_mapping(early(t)), late(t))[1]


@query(
    "E10_attach_deferred",
    f"""WITH {LINKS} SELECT l.report AS primary_report_identifier, l.mpi, l.epic AS epic_mrn, min(m.patient_id) AS patient_id,
       min(m.consistent) AS consistent FROM l JOIN map1 m ON m.mpi IS NOT DISTINCT FROM l.mpi
       AND m.epic IS NOT DISTINCT FROM l.epic WHERE NOT l.early GROUP BY 1, 2, 3""",
)
def _(t):
    return I.attach_deferred(late(t), I.build_mapping(early(t)))


VIEW = f"""{LINKS}, resolved AS (
  SELECT c, max(epic) AS resolved_epic_mrn, max(mpi) AS resolved_mpi FROM whole WHERE consistent GROUP BY 1)"""


@query(
    "E11_patient_view",
    f"""WITH {EXAMS}, {VIEW} SELECT e.accession_number, e.modality, sha256(w.first_report) AS patient_id,
       resolved_epic_mrn, resolved_mpi FROM exams e JOIN whole w ON w.report = 'o' || e.o_orderkey
       JOIN resolved USING (c) WHERE w.consistent""",
)
def _(t):
    named = exams(t).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("primary_report_identifier"),
        "accession_number",
        "modality",
    )
    view = I.patient_view(named, I.build_mapping(links(t).drop("o_orderdate")))
    return view.drop("primary_report_identifier")


def mapping_log(t):
    """The change rows of a mapping that took in the early reports and then the late ones."""
    table = MergeTable(t.spark, scratch_path(t.spark, "mapping"), "primary_report_identifier")
    first = I.build_mapping(early(t))
    table.upsert(0, first)
    table.upsert(1, I.update_mapping(first, late(t))[0])
    return table.changes()


@query(
    "E11_view_as_of",
    f"""WITH {EXAMS}, {LINKS}, r AS (SELECT patient_id, max(epic) AS resolved_epic_mrn, max(mpi) AS resolved_mpi
         FROM map1 WHERE consistent GROUP BY 1)
       SELECT e.accession_number, m.patient_id, resolved_epic_mrn, resolved_mpi FROM exams e
       JOIN map1 m ON m.report = 'o' || e.o_orderkey JOIN r ON r.patient_id = m.patient_id WHERE m.consistent""",
)
def _(t):
    named = exams(t).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("primary_report_identifier"), "accession_number"
    )
    view = I.patient_view_as_of(named, I.validity(mapping_log(t)), 0)
    return view.drop("primary_report_identifier")


@query(
    "E9_validity",
    f"""WITH {LINKS}, renamed AS (SELECT w.report, m.patient_id AS was, m.consistent AS was_ok, w.consistent,
         coalesce(min(m.patient_id) OVER (PARTITION BY w.c), sha256(w.first_report)) AS patient_id
         FROM whole w LEFT JOIN map1 m ON m.report = w.report),
       old AS (SELECT report, was AS patient_id, was_ok AS consistent, 0 AS valid_from,
         CASE WHEN was <> patient_id OR was_ok <> consistent THEN 1 END AS valid_to FROM renamed WHERE was IS NOT NULL)
       SELECT report AS primary_report_identifier, patient_id, consistent, CAST(valid_from AS INTEGER) AS valid_from,
         CAST(valid_to AS INTEGER) AS valid_to FROM old
       UNION ALL SELECT report, patient_id, consistent, 1, NULL FROM renamed
         WHERE was IS NULL OR was <> patient_id OR was_ok <> consistent""",
)
def _(t):
    return I.validity(mapping_log(t)).select("primary_report_identifier", "patient_id", "consistent", "valid_from", "valid_to")


@query(
    "J18_expand_patients",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
         SELECT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         WHERE n_name IN ('NATION_1', 'NATION_2') AND o_orderstatus = 'F')""",
)
def _(t):
    view = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    marked = view.withColumn("epic_mrn", F.when(F.col("o_orderstatus") == "F", F.col("n_name")))
    found = I.expand_patients(marked, ["NATION_1", "NATION_2"], ["epic_mrn"], "o_custkey")
    return found.select("o_orderkey", "o_custkey")


@query(
    "J18_expand_patient_table",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
         SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50))""",
)
def _(t):
    ids = t.lineitem.filter("l_quantity = 50").select(F.col("l_orderkey").alias("id"))
    return I.expand_patients(t.orders, ids, ["o_orderkey"], "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "E11_named_views",
    f"""WITH {EXAMS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
         ORDER BY requested_dt DESC, o_orderkey DESC) AS rn FROM exams) WHERE rn = 1)
       SELECT 'reports_curated' AS name, count(*) AS n, CAST(NULL AS VARCHAR) AS last_mpi FROM exams
       UNION ALL SELECT 'reports_latest', count(*), NULL FROM newest
       UNION ALL SELECT 'reports_curated_epic_view', count(*), max(mpi) FROM exams WHERE patient_id % 3 <> 0
       UNION ALL SELECT 'reports_latest_epic_view', count(*), max(mpi) FROM newest WHERE patient_id % 3 <> 0""",
)
def _(t):
    curated = exams(t)
    latest = newest_per(curated, "patient_id", [F.desc("requested_dt"), F.desc("o_orderkey")])
    mapping = curated.select(
        F.col("patient_id").cast("string").alias("patient_id"), "primary_report_identifier", "mpi", "epic_mrn",
        (F.col("patient_id") % 3 != 0).alias("consistent"),
    )
    out = None
    for name, view in I.report_views(curated.drop("patient_id"), latest.drop("patient_id"), mapping).items():
        last = F.max("resolved_mpi") if name.endswith("_view") else F.lit(None).cast("string")
        row = view.agg(F.count("*").alias("n"), last.alias("last_mpi")).select(F.lit(name).alias("name"), "n", "last_mpi")
        out = row if out is None else out.unionByName(row)
    return out
