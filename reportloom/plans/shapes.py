"""Clinical shapes derived from the driver tables, in Spark and in SQL.

``exams`` reads orders as exams of customers; ``doc_reports`` reads documents as
report texts; ``hl7_messages`` writes each order as an HL7 message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables


def exams(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias(
                "primary_report_identifier"
            ),
            F.col("o_orderkey").cast("string").alias("accession_number"),
            F.col("o_orderkey"),
            F.col("o_custkey").alias("patient_id"),
            F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("epic_mrn"),
            F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("mpi"),
            F.col("o_orderpriority").alias("modality"),
            F.col("o_orderstatus").alias("report_status"),
            F.col("n_name").alias("sending_facility"),
            F.col("c_mktsegment").alias("race"),
            F.when(F.col("c_nationkey") >= 12, "M").otherwise("F").alias("sex"),
            F.col("n_regionkey").cast("string").alias("ethnic_group"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("service_name"),
            F.floor(F.col("o_totalprice") / 5000).cast("int").alias("patient_age"),
            F.col("o_orderdate").alias("requested_dt"),
            F.col("o_orderdate").alias("observation_dt"),
            F.col("o_totalprice"),
        )
    )


EXAMS = """exams AS (
  SELECT 'r' || o_orderkey AS primary_report_identifier, CAST(o_orderkey AS VARCHAR) AS accession_number,
         o_orderkey, o_custkey AS patient_id, 'E' || o_custkey AS epic_mrn, 'M' || o_custkey AS mpi,
         o_orderpriority AS modality, o_orderstatus AS report_status, n_name AS sending_facility,
         c_mktsegment AS race, CASE WHEN c_nationkey >= 12 THEN 'M' ELSE 'F' END AS sex,
         CAST(n_regionkey AS VARCHAR) AS ethnic_group,
         o_orderpriority || ' ' || c_mktsegment AS service_name,
         CAST(floor(o_totalprice / 5000) AS INTEGER) AS patient_age,
         o_orderdate AS requested_dt, o_orderdate AS observation_dt, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def timed(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Line items as timed reports: ordered, shipped, read by a supplier."""
    lines = t.lineitem if lines is None else lines
    return lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderpriority").alias("modality"),
        F.col("l_returnflag").alias("sending_facility"),
        F.col("l_suppkey").alias("radiologist"),
        F.col("o_orderdate").alias("requested_dt"),
        F.col("o_orderdate").alias("observation_dt"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias(
            "results_report_status_change_dt"
        ),
        F.col("l_shipdate").alias("message_dt"),
        F.concat_ws(" ", "o_orderpriority", "l_returnflag").alias("report_text"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.col("o_orderpriority"), F.lit(" seen"))).alias(
            "report_section_findings"
        ),
        F.concat_ws(" ", F.lit("read"), "o_orderpriority").alias("report_section_impression"),
        F.when(F.col("l_linestatus") == "O", F.lit("addendum text")).alias(
            "report_section_addendum"
        ),
    )


TIMED = """timed AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_custkey AS patient_id,
         o_orderpriority AS modality, l_returnflag AS sending_facility, l_suppkey AS radiologist,
         o_orderdate AS requested_dt, l_shipdate AS message_dt,
         coalesce(CASE WHEN l_linestatus = 'F' THEN l_shipdate END, l_shipdate) AS finalized,
         o_orderpriority || ' ' || l_returnflag AS report_text,
         CASE WHEN l_returnflag <> 'R' THEN o_orderpriority || ' seen' END AS findings,
         'read ' || o_orderpriority AS impression,
         CASE WHEN l_linestatus = 'O' THEN 'addendum text' END AS addendum
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
quality AS (
  SELECT *, CASE WHEN secs > 0 AND secs <= 2592000 THEN secs END AS seconds,
         CASE WHEN secs > 0 AND secs <= 2592000 THEN secs / 3600.0 END AS hours,
         coalesce(length(findings) > 10, false) AS has_findings,
         coalesce(length(impression) > 10, false) AS has_impression,
         coalesce(length(addendum) > 10, false) AS has_addendum
  FROM (SELECT *, CAST(date_diff('second', requested_dt, finalized) AS BIGINT) AS secs FROM timed))"""


def doc_reports(t: Tables) -> DataFrame:
    lang = F.col("lang")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("primary_report_identifier"),
        F.when(lang == "en", "CT")
        .when(lang == "fr", "MR")
        .when(lang == "de", "US")
        .otherwise("XR")
        .alias("modality"),
        F.col("source").alias("sending_facility"),
        F.col("source").alias("patient_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias(
            "message_dt"
        ),
        (F.col("n_chars") % 120).cast("int").alias("patient_age"),
        F.col("text").alias("report_text"),
        F.concat_ws(
            " ",
            F.when(F.col("quality") == 1, "Recommend follow-up: see").otherwise("Stable: see"),
            F.col("source"),
        ).alias("followup_finding"),
        (F.col("toxic") == 1).alias("followup_detected"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias(
            "followup_confidence"
        ),
        (F.col("quality") == 1).alias("human_ground_truth"),
    )


DOCS = """docs AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS primary_report_identifier,
         CASE lang WHEN 'en' THEN 'CT' WHEN 'fr' THEN 'MR' WHEN 'de' THEN 'US' ELSE 'XR' END AS modality,
         source AS sending_facility, source AS patient_id,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS BIGINT)) AS message_dt,
         CAST(n_chars % 120 AS INTEGER) AS patient_age, text AS report_text,
         CASE WHEN quality = 1 THEN 'Recommend follow-up: see' ELSE 'Stable: see' END || ' ' || source
           AS followup_finding,
         toxic = 1 AS followup_detected,
         CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS followup_confidence,
         quality = 1 AS human_ground_truth
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def diagnosis_array(*pairs: tuple[Column, Column]) -> Column:
    """Diagnoses of a row from (code, text) pairs."""
    return F.array(
        *[
            F.struct(
                code.alias("diagnosis_code"),
                text.alias("diagnosis_code_text"),
                F.lit("I10").alias("diagnosis_code_coding_system"),
            )
            for code, text in pairs
        ]
    )


def part_reports(t: Tables) -> DataFrame:
    """Line items as reports whose diagnoses are their part's brand and type."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_returnflag",
        "p_name",
        "p_type",
        diagnosis_array(
            (F.col("p_brand"), F.col("p_name")),
            (F.concat_ws("-", "p_type", F.col("p_size").cast("string")), F.col("p_type")),
        ).alias("diagnoses"),
    )


def pipe(values: dict[int, Column], size: int, name: str) -> Column:
    """A segment with the given 1-based fields."""
    return F.concat_ws("|", F.lit(name), *[values.get(i, F.lit("")) for i in range(1, size + 1)])


def hl7_messages(t: Tables) -> DataFrame:
    """``source_file, content``: one message per order.

    The orders are one file here, where messages would be many; so the rows are dealt out
    before they are written as messages.
    """
    key = F.col("o_orderkey").cast("string")
    cust = F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    number = F.substring_index("c_name", "#", -1)
    lines = [
        F.concat_ws(
            "|",
            *[F.lit(v) for v in ("MSH", "^~\\&", "LAB")],
            F.col("n_name"),
            F.lit(""),
            F.lit(""),
            F.concat(day, F.lit("0830")),
            F.lit(""),
            F.lit("ORU^R01"),
            key,
            F.lit("P"),
            F.lit("2.7"),
        ),
        pipe(
            {
                1: F.lit("1"),
                2: F.concat(F.lit("M"), cust),
                3: F.concat(
                    cust,
                    F.lit("^^^EPIC^MRN~"),
                    key,
                    F.lit("^^^^^"),
                    F.col("o_orderstatus"),
                    F.lit("H~123456789^^^GOV^SS"),
                ),
                5: F.concat(F.lit("CUSTOMER^"), number, F.lit("^ ^JR")),
                7: F.lit("19600215"),
                8: F.when(F.col("c_nationkey") >= 12, "M").otherwise("F"),
                10: F.col("c_mktsegment"),
                11: F.concat(F.lit("1 ROAD^^CITY^ST^"), F.col("c_nationkey").cast("string"), F.lit("^US")),
            },
            22,
            "PID",
        ),
        pipe({1: F.lit("1"), 2: F.lit("O")}, 2, "PV1"),
        pipe({1: F.lit("RE"), 2: F.concat(F.lit("P"), key), 3: F.concat(F.lit("F"), key)}, 3, "ORC"),
        pipe(
            {
                1: F.lit("1"),
                3: F.when(F.col("o_orderstatus") == "F", key).otherwise(F.lit("")),
                4: F.concat(
                    F.lit("X"), F.substring("o_orderpriority", 1, 1), F.lit("^"), F.col("o_orderpriority"), F.lit("^LN")
                ),
                6: F.concat(day, F.lit("0700")),
                7: F.concat(day, F.lit("073015")),
                8: F.lit("not a date"),
                16: F.concat(number, F.lit("^ROE^JANE^^^^^^HOSP^L~77^^NOBODY")),
                22: F.concat(day, F.lit("0900")),
                24: F.lit("RAD"),
                32: F.lit("5^GRAY^ANN^^^^^^HOSP"),
                33: F.lit("6^POE^BO~6^POE^BO~7^DOE^CY"),
                34: F.lit(""),
            },
            34,
            "OBR",
        ),
        F.concat_ws(
            "|",
            *[F.lit(v) for v in ("OBX", "1", "TX", "1&GDT", "")],
            F.concat(F.lit("Priority "), F.col("o_orderpriority"), F.lit("~segment "), F.col("c_mktsegment")),
            *[F.lit("")] * 5,
            F.col("o_orderstatus"),
        ),
        F.concat_ws(
            "|",
            *[F.lit(v) for v in ("OBX", "2", "ST", "1&IMP", "")],
            F.concat(F.lit("Impression~of "), key),
            *[F.lit("")] * 5,
            F.lit("Z"),
        ),
        F.concat_ws("|", *[F.lit(v) for v in ("OBX", "3", "TX", "1", "", "tail", "", "", "")]),
        F.concat_ws(
            "|", F.lit("DG1"), F.lit("1"), F.lit(""), F.concat_ws("^", F.col("o_orderpriority"), "c_mktsegment", F.lit("I10"))
        ),
        F.concat_ws("|", F.lit("DG1"), F.lit("2"), F.lit(""), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))),
        F.concat(F.lit("ZDS|1.2."), key),
    ]
    return (
        t.orders.repartition(t.spark.sparkContext.defaultParallelism)
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("in/"), key, F.lit(".hl7")).alias("source_file"),
            F.concat_ws("\r", *lines).alias("content"),
        )
    )


SOURCE = """src AS (
  SELECT *, 'in/' || o_orderkey || '.hl7' AS source_file, CAST(o_orderkey AS VARCHAR) AS k,
         CAST(o_custkey AS VARCHAR) AS cust, strftime(o_orderdate, '%Y%m%d') AS ymd,
         split_part(c_name, '#', 2) AS num
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
