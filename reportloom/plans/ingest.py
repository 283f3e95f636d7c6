"""Sources, sinks and HL7 extraction over the driver tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from ..functions import hl7
from ..operators import curate
from ..session import cut, scratch_path
from ..sources import archives, lists, logs, messages, sinks
from .registry import query
from .shapes import DOCS, EXAMS, SOURCE, doc_reports, exams, hl7_messages


def parsed(t):
    return messages.parse_messages(hl7_messages(t), keep=["source_file"])


def framed_lines(t):
    """Each message framed, with noise before it, as lines of one text value."""
    body = F.concat(F.replace("content", F.lit("\r"), F.lit("<R>\n")), F.lit("<R>"))
    return hl7_messages(t).select(
        F.concat(F.lit("noise\n<SB>dropped\n"), body, F.lit("\n<EB>\nmore noise")).alias("value")
    )


FRAMED_SQL = f"""WITH {SOURCE}
SELECT k AS message_control_id, CAST(12 AS BIGINT) AS n_lines, 'ZDS|1.2.' || k AS last_line FROM src"""


def message_facts(split):
    return split.select(
        hl7.component(hl7.header(F.get("lines", F.lit(0))), 10).alias("message_control_id"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.get("lines", F.size("lines") - 2).alias("last_line"),
    )


@query("A1_read_message_logs", FRAMED_SQL)
def _(t):
    path = scratch_path(t.spark, "logs")
    framed_lines(t).write.text(path)
    return message_facts(logs.read_message_logs(t.spark, path))


@query(
    "A2_validate_messages",
    """SELECT 'in/log_' || (conv_id * 1000 + turn) AS file_path, 'HL7' AS type, 'failed' AS status,
       'HL7 message content is empty' AS error_message FROM conversations WHERE role = 'system'
       UNION ALL SELECT 'in/log_' || (conv_id * 1000 + turn), 'HL7', 'staged', text FROM conversations
       WHERE role <> 'system'
       UNION ALL SELECT 'in/empty' || r_regionkey || '.log', 'Log', 'failed',
       'Log did not contain any HL7 messages' FROM region""",
)
def _(t):
    split = t.conversations.select(
        F.lit("in/log.log").alias("log_path"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_number"),
        F.when(F.col("role") == "system", F.array(F.lit(""), F.lit("  ")))
        .otherwise(F.array(F.col("text")))
        .alias("lines"),
    )
    empty = t.region.select(
        F.concat(F.lit("in/empty"), F.col("r_regionkey").cast("string"), F.lit(".log")).alias("log_path")
    )
    ok, errors = logs.validate_messages(split, split.select("log_path").unionByName(empty))
    staged = ok.select(
        logs.failed_uri("log_path", "message_number").alias("file_path"),
        F.lit("HL7").alias("type"),
        F.lit("staged").alias("status"),
        F.get("lines", F.lit(0)).alias("error_message"),
    )
    return errors.unionByName(staged)


@query(
    "A3_log_date",
    """SELECT CAST(o_orderdate AS DATE) AS log_date, count(*) AS n FROM orders GROUP BY 1
       UNION ALL SELECT NULL, count(*) FROM nation""",
)
def _(t):
    paths = t.orders.select(
        F.concat(F.lit("/in/1/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_PORU.log")).alias("p")
    ).unionByName(t.nation.select(F.concat(F.lit("/in/20200101/"), "n_name", F.lit(".log")).alias("p")))
    return paths.groupBy(logs.log_date("p").alias("log_date")).agg(F.count("*").alias("n"))


@query(
    "A4_message_uri",
    """SELECT 's3://hl7/' || year(o_orderdate) || '/' || strftime(o_orderdate, '%Y%m%d') || '_P.zip/'
       || strftime(o_orderdate, '%Y/%m/%d/%Y%m%d') || '_P_' || o_orderkey || '.hl7' AS uri,
       'in/' || strftime(o_orderdate, '%Y%m%d') || '_P_' || o_orderkey AS failed_uri FROM orders""",
)
def _(t):
    path = F.concat(F.lit("in/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_P.log"))
    return t.orders.select(
        logs.message_uri("s3://hl7/", path, "o_orderkey").alias("uri"),
        logs.failed_uri(path, "o_orderkey").alias("failed_uri"),
    )


@query(
    "A5_discover_logs",
    f"WITH {SOURCE} SELECT n_name AS sending_facility, count(*) AS n FROM src GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "found")
    # The csv writer can name files .log; a control character that never occurs
    # keeps each value one unquoted cell.
    framed = framed_lines(t).select(F.explode(F.split("value", "\n")).alias("value"))
    framed.write.option("extension", "log").option("sep", "\x01").option("quote", "").option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)
    split = logs.read_discovered_logs(t.spark, path, logs.discover_logs(t.spark, path, "part"), "part")
    facility = hl7.component(hl7.header(F.get("lines", F.lit(0))), 4)
    return split.groupBy(facility.alias("sending_facility")).agg(F.count("*").alias("n"))


@query("A6_manifest", "SELECT 's3://hl7/' || o_orderkey || '.hl7' AS path FROM orders")
def _(t):
    path = scratch_path(t.spark, "manifest")
    listed = t.orders.select(
        F.concat(F.lit("s3://hl7/"), F.col("o_orderkey").cast("string"), F.lit(".hl7")).alias("path")
    )
    blank = t.region.select(F.lit(" ").alias("path"))
    logs.write_manifest(listed.unionByName(blank), path)
    return logs.read_manifest(t.spark, [path, path + "-missing"])


@query(
    "A7_parse_messages",
    f"""WITH {SOURCE} SELECT source_file,
       'MSH|^~\\&|LAB|' || n_name || '|||' || ymd || '0830||ORU^R01|' || k || '|P|2.7' AS message,
       CAST(10 AS BIGINT) AS n_segments, 'PID,PV1,ORC,OBR,OBX,OBX,OBX,DG1,DG1,ZDS' AS ids,
       CAST(11 + 2 + 3 + 33 + 11 + 11 + 5 + 3 + 3 + 1 AS BIGINT) AS n_fields FROM src""",
)
def _(t):
    return parsed(t).select(
        "source_file",
        "message",
        F.size("segments").cast("bigint").alias("n_segments"),
        F.array_join(F.transform("segments", lambda s: s["id"]), ",").alias("ids"),
        F.aggregate("segments", F.lit(0), lambda a, s: a + F.size(s["fields"])).cast("bigint").alias("n_fields"),
    )


@query(
    "A8_zipped_messages",
    f"""WITH {SOURCE} SELECT k AS message_control_id, n_name AS facility FROM src WHERE o_orderkey IN (
       SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def _(t):
    def pack(batches):
        for batch in batches:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in zip(batch["source_file"], batch["content"]):
                    z.writestr(name, content)
            yield pd.DataFrame({"path": [batch["source_file"].iloc[0] + ".zip"], "content": [data.getvalue()]})

    archives = cut(hl7_messages(t).mapInPandas(pack, "path string, content binary"))
    # Members carry their archive's path; those of some orders are wanted.
    members = messages.unzip_messages(archives).select("source_file")
    orders = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("k"))
    wanted = members.join(orders, F.regexp_extract("source_file", r"(\d+)\.hl7$", 1) == F.col("k"), "left_semi")
    found = messages.zipped_messages(archives, wanted)
    return found.select(
        hl7.component(hl7.header(), 10).alias("message_control_id"),
        hl7.component(hl7.header(), 4).alias("facility"),
    )


@query(
    "A8_members_by_offset",
    f"""WITH {SOURCE} SELECT k AS message_control_id, n_name AS facility, true AS listed FROM src WHERE o_orderstatus <> 'P'""",
)
def _(t):
    folder = scratch_path(t.spark, "zips")

    def pack(batches):
        # Written by the tasks into the folder they share.
        store, place = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(place, recursive=True)
        for batch in batches:
            name = batch["source_file"].iloc[0].replace("/", "_") + ".zip"
            with store.open_output_stream(f"{place}/{name}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                for member, content in zip(batch["source_file"], batch["content"]):
                    z.writestr(member, content)
            yield pd.DataFrame({"path": [f"{folder}/{name}"]})

    paths = cut(hl7_messages(t).mapInPandas(pack, "path string"))
    members = archives.list_members(paths)
    orders = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("k"))
    chosen = members.join(orders, F.regexp_extract("member", r"(\d+)\.hl7$", 1) == F.col("k"), "left_semi")
    found = archives.read_members(chosen, task_bytes=1_000_000)
    parsed = messages.parse_messages(found.withColumn("content", F.decode("content", "utf-8")), "content", keep=["error"])
    return parsed.select(
        hl7.component(hl7.header(), 10).alias("message_control_id"),
        hl7.component(hl7.header(), 4).alias("facility"),
        F.col("error").isNull().alias("listed"),
    )


@query(
    "A9_code_map",
    "SELECT p_type AS modality, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "codes")
    t.part.select(
        F.col("p_partkey").cast("string").alias("Exam Code"), F.col("p_type").alias("Modality")
    ).write.option("header", True).csv(path)
    codes = lists.read_code_map(t.spark, path)
    joined = t.lineitem.select(F.col("l_partkey").cast("string").alias("service_identifier")).join(
        codes, "service_identifier", "left"
    )
    return joined.groupBy("modality").agg(F.count("*").alias("n"))


@query(
    "A10_read_id_list",
    """SELECT n_name AS id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
       GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "ids")
    doubled = t.nation.unionByName(t.nation).select(
        F.lit("x").alias("note"), F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("Patient MRN")
    )
    doubled.write.option("header", True).csv(path)
    ids, column = lists.read_id_list(t.spark, path)
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    assert column == "epic_mrn"
    return people.join(ids, F.col("n_name") == F.col("id")).groupBy("id").agg(
        F.count("*").alias("n")
    )


@query(
    "A11_write_table",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n,
       CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "table")
    sinks.write_table(t.lineitem.withColumn("year", F.year("l_shipdate")), path)
    return (
        t.spark.read.parquet(path)
        .groupBy("year")
        .agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
    )


@query(
    "A12_export_csv",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
       CASE WHEN p_size > 25 THEN '''=' || p_name || '"q"' ELSE p_name END AS p_name FROM part""",
)
def _(t):
    path = scratch_path(t.spark, "export")
    risky = F.when(F.col("p_size") > 25, F.concat(F.lit("="), F.col("p_name"), F.lit('"q"'))).otherwise(
        F.col("p_name")
    )
    sinks.export_csv(t.part.select("p_partkey", risky.alias("p_name")), path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query(
    "A13_export_cohort",
    f"""WITH {EXAMS} SELECT accession_number, patient_id, epic_mrn, mpi, patient_age, sex, race, ethnic_group,
       modality, service_name, requested_dt, observation_dt, sending_facility,
       CASE WHEN report_status <> 'P' THEN report_status = 'F' END AS manually_included,
       CASE WHEN report_status <> 'P' THEN 'seen ' || report_status ELSE '' END AS manual_review_notes
       FROM exams""",
)
def _(t):
    notes = t.orders.select(
        F.col("o_orderkey").cast("string").alias("accession_number"),
        (F.col("o_orderstatus") != "P").alias("reviewed"),
        (F.col("o_orderstatus") == "F").alias("included"),
        F.concat(F.lit("seen "), "o_orderstatus").alias("notes"),
    )
    return sinks.export_cohort(exams(t), notes)


@query(
    "A14_fold_batches",
    f"""WITH {DOCS} SELECT modality, CAST(count(*) FILTER (WHERE contains(lower(followup_finding), 'follow-up'))
       AS BIGINT) AS followups, count(*) AS n FROM docs GROUP BY 1""",
)
def _(t):
    hit = F.contains(F.lower("followup_finding"), F.lit("follow-up"))
    return sinks.fold_batches(doc_reports(t), "modality", followups=F.count_if(hit), n=F.count("*"))


@query(
    "B1_segments",
    f"""WITH {SOURCE} SELECT source_file, 'RE' AS orc_1, CAST(3 AS BIGINT) AS n_obx, CAST(2 AS BIGINT) AS n_dg1,
       true AS no_nte FROM src""",
)
def _(t):
    return parsed(t).select(
        "source_file",
        hl7.field(hl7.segment("ORC"), 1).alias("orc_1"),
        F.size(hl7.segments("OBX")).cast("bigint").alias("n_obx"),
        F.size(hl7.segments("DG1")).cast("bigint").alias("n_dg1"),
        hl7.segment("NTE").isNull().alias("no_nte"),
    )


@query(
    "B2_fields",
    f"""WITH {SOURCE} SELECT k AS message_control_id, n_name AS facility, ymd || '0830' AS message_at,
       '2.7' AS version_id, 'X' || left(o_orderpriority, 1) AS service_identifier,
       o_orderpriority AS service_name, 'LN' AS coding_system, CAST(NULL AS VARCHAR) AS absent,
       CAST(c_nationkey AS VARCHAR) AS zip FROM src""",
)
def _(t):
    obr = hl7.segment("OBR")
    return parsed(t).select(
        hl7.component(hl7.header(), 10).alias("message_control_id"),
        hl7.component(hl7.header(), 4).alias("facility"),
        hl7.component(hl7.header(), 7).alias("message_at"),
        hl7.component(hl7.header(), 12).alias("version_id"),
        hl7.component(obr, 4, 1).alias("service_identifier"),
        hl7.component(obr, 4, 2).alias("service_name"),
        hl7.component(obr, 4, 3).alias("coding_system"),
        hl7.component(obr, 60, 2).alias("absent"),
        hl7.component(hl7.segment("PID"), 11, 5).alias("zip"),
    )


@query(
    "B3_repeated",
    f"""WITH {SOURCE} SELECT source_file, cust || '+' || k || '+123456789' AS every_id,
       k || '+123456789' AS long_form FROM src""",
)
def _(t):
    pid3 = hl7.field(hl7.segment("PID"), 3)
    first = lambda parts: F.struct(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(4)).alias("kind"))
    return parsed(t).select(
        "source_file",
        F.array_join(F.transform(hl7.repeated(pid3, first), lambda x: x["id"]), "+").alias("every_id"),
        F.array_join(
            F.transform(hl7.repeated(pid3, first, lambda x: x["kind"] != "MRN"), lambda x: x["id"]), "+"
        ).alias("long_form"),
    )


@query(
    "B4_names",
    f"""WITH {SOURCE} SELECT source_file, 'CUSTOMER' AS family, num AS given, CAST(NULL AS VARCHAR) AS middle,
       'JR' AS suffix, num AS doctor_id, 'ROE' AS doctor, 'L' AS doctor_type, 'HOSP' AS doctor_authority,
       CAST(1 AS BIGINT) AS doctors, 'GRAY' AS reader, CAST(NULL AS VARCHAR) AS reader_type FROM src""",
)
def _(t):
    base = parsed(t).select(
        "source_file",
        F.get(hl7.xpn(hl7.field(hl7.segment("PID"), 5)), F.lit(0)).alias("p"),
        hl7.xcn(hl7.field(hl7.segment("OBR"), 16), hl7.has_family_name).alias("o"),
        F.get(hl7.cnn(hl7.field(hl7.segment("OBR"), 32), hl7.has_family_name), F.lit(0)).alias("r"),
    )
    doctor = F.get("o", F.lit(0))
    return base.select(
        "source_file",
        F.col("p.family_name").alias("family"),
        F.col("p.given_name").alias("given"),
        F.col("p.second_and_further_names").alias("middle"),
        F.col("p.suffix").alias("suffix"),
        doctor["id_number"].alias("doctor_id"),
        doctor["family_name"].alias("doctor"),
        doctor["name_type_code"].alias("doctor_type"),
        doctor["assigning_authority"].alias("doctor_authority"),
        F.size("o").cast("bigint").alias("doctors"),
        F.col("r.family_name").alias("reader"),
        F.col("r.name_type_code").alias("reader_type"),
    )


@query(
    "B5_friendly_names",
    f"""WITH {SOURCE} SELECT source_file, num || ' CUSTOMER' AS patient_name, 'BO POE;CY DOE' AS assistants,
       '' AS technician FROM src""",
)
def _(t):
    obr = hl7.segment("OBR")
    named = hl7.has_family_name
    return parsed(t).select(
        "source_file",
        hl7.friendly_first(hl7.xpn(hl7.field(hl7.segment("PID"), 5))).alias("patient_name"),
        F.array_join(hl7.friendly_all(hl7.cnn(hl7.field(obr, 33), named)), ";").alias("assistants"),
        F.coalesce(hl7.friendly_first(hl7.cnn(hl7.field(obr, 34), named)), F.lit("")).alias("technician"),
    )


@query(
    "B6_patient_ids",
    f"""WITH {SOURCE} SELECT source_file, unnest(['EPIC', NULL]) AS authority, unnest([cust, k]) AS id_number,
       unnest(['MRN', NULL]) AS id_type, unnest([NULL, o_orderstatus || 'H']) AS facility FROM src""",
)
def _(t):
    ids = hl7.patient_ids(hl7.field(hl7.segment("PID"), 3))
    return parsed(t).select("source_file", F.explode(ids).alias("i")).select(
        "source_file",
        F.col("i.assigning_authority").alias("authority"),
        F.col("i.id_number"),
        F.col("i.identifier_type_code").alias("id_type"),
        F.col("i.assigning_facility").alias("facility"),
    )


@query(
    "B7_pivot_patient_ids",
    f"""WITH {SOURCE} SELECT source_file, cust AS epic_mrn,
       CASE WHEN o_orderstatus = 'F' THEN k END AS legacy_patient_id_fh,
       CASE WHEN o_orderstatus = 'O' THEN k END AS legacy_patient_id_oh,
       CASE WHEN o_orderstatus = 'P' THEN k END AS legacy_patient_id_ph FROM src""",
)
def _(t):
    ids = parsed(t).select(
        "source_file", hl7.patient_ids(hl7.field(hl7.segment("PID"), 3)).alias("patient_ids")
    )
    keys = ["epic_mrn", "legacy_patient_id_fh", "legacy_patient_id_oh", "legacy_patient_id_ph"]
    return curate.pivot_patient_ids(ids, keys=keys).drop("patient_ids")


@query(
    "B8_dates",
    f"""WITH {SOURCE} SELECT source_file, DATE '1960-02-15' AS birth_date,
       o_orderdate + INTERVAL '8 hours 30 minutes' AS message_dt,
       o_orderdate + INTERVAL '7 hours 30 minutes 15 seconds' AS observation_dt,
       CAST(NULL AS TIMESTAMP) AS observation_end_dt FROM src""",
)
def _(t):
    obr = hl7.segment("OBR")
    return parsed(t).select(
        "source_file",
        hl7.parse_hl7_date(hl7.component(hl7.segment("PID"), 7)).alias("birth_date"),
        hl7.parse_hl7_ts(hl7.component(hl7.header(), 7)).cast("timestamp_ntz").alias("message_dt"),
        hl7.parse_hl7_ts(hl7.component(obr, 7)).cast("timestamp_ntz").alias("observation_dt"),
        hl7.parse_hl7_ts(hl7.component(obr, 8)).cast("timestamp_ntz").alias("observation_end_dt"),
    )


TEXT_SQL = "'Priority ' || o_orderpriority || chr(10) || 'segment ' || c_mktsegment"


@query(
    "B9_assemble_text",
    f"""WITH {SOURCE} SELECT source_file, {TEXT_SQL} || chr(10) || 'Impression~of ' || k || chr(10) || 'tail'
       AS report_text, o_orderstatus AS report_status FROM src""",
)
def _(t):
    obx = hl7.segments("OBX")
    return parsed(t).select(
        "source_file",
        hl7.assemble_text(obx).alias("report_text"),
        hl7.report_status(obx).alias("report_status"),
    )


@query(
    "B10_sections",
    f"""WITH {SOURCE} SELECT source_file, {TEXT_SQL} AS findings, 'Impression~of ' || k AS impression,
       '' AS addendum, '' AS technician_note FROM src""",
)
def _(t):
    obx = hl7.segments("OBX")
    return parsed(t).select(
        "source_file",
        *[hl7.section(obx, s).alias(n) for n, s in hl7.SECTION_SUFFIXES.items()],
    )


@query(
    "B11_diagnoses",
    f"""WITH {SOURCE} SELECT source_file, unnest([o_orderpriority, 'N' || c_nationkey]) AS code,
       unnest([c_mktsegment, NULL]) AS text, unnest(['I10', NULL]) AS system, c_mktsegment AS consolidated
       FROM src""",
)
def _(t):
    dx = parsed(t).select("source_file", hl7.diagnoses(hl7.segments("DG1")).alias("dx"))
    return dx.select("source_file", hl7.diagnoses_consolidated("dx").alias("consolidated"), F.explode("dx").alias("d")).select(
        "source_file",
        F.col("d.diagnosis_code").alias("code"),
        F.col("d.diagnosis_code_text").alias("text"),
        F.col("d.diagnosis_code_coding_system").alias("system"),
        "consolidated",
    )


@query(
    "B12_split_unparsable",
    f"""WITH {SOURCE} SELECT source_file AS file_path, 'success' AS status, CAST(NULL AS VARCHAR) AS error_message
       FROM src UNION ALL SELECT 'doc/' || doc_id, 'failed', 'File is not parsable as HL7' FROM documents""",
)
def _(t):
    junk = t.documents.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_file"),
        F.replace("text", F.lit("|"), F.lit(" ")).alias("content"),
    )
    both = messages.parse_messages(hl7_messages(t).unionByName(junk), keep=["source_file"])
    ok, errors = curate.split_unparsable(both)
    good = ok.select(
        F.col("source_file").alias("file_path"),
        F.lit("success").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return good.unionByName(errors.drop("type"))


@query(
    "B13_build_reports",
    f"""WITH {SOURCE} SELECT source_file, k AS message_control_id, n_name AS sending_facility, 'M' || cust AS mpi,
       CASE WHEN c_nationkey >= 12 THEN 'M' ELSE 'F' END AS sex, c_mktsegment AS race, 'O' AS patient_class,
       'P' || k AS orc_2_placer_order_number, 'F' || k AS orc_3_filler_order_number,
       CASE WHEN o_orderstatus = 'F' THEN k ELSE '' END AS obr_3_filler_order_number,
       o_orderpriority AS service_name, '1.2.' || k AS study_instance_uid,
       o_orderdate + INTERVAL '7 hours' AS requested_dt, o_orderdate + INTERVAL '9 hours' AS changed_dt,
       CAST(year(o_orderdate) AS INTEGER) AS year, cust AS epic_mrn, 'JANE ROE' AS ordering_provider,
       'ANN GRAY' AS principal_result_interpreter, 'BO POE;CY DOE' AS assistants,
       r_name AS modality FROM src LEFT JOIN region ON 'X' || (r_regionkey + 2) = 'X' || left(o_orderpriority, 1)""",
)
def _(t):
    # Codes X2 to X6: messages with X1 have no modality, X6 occurs in none.
    codes = t.region.select(
        F.concat(F.lit("X"), (F.col("r_regionkey") + 2).cast("string")).alias("service_identifier"),
        F.col("r_name").alias("modality"),
    )
    r = curate.build_reports(parsed(t), codes)
    return r.select(
        "source_file", "message_control_id", "sending_facility", "mpi", "sex", "race", "patient_class",
        "orc_2_placer_order_number", "orc_3_filler_order_number", "obr_3_filler_order_number",
        "service_name", "study_instance_uid",
        F.col("requested_dt").cast("timestamp_ntz").alias("requested_dt"),
        F.col("results_report_status_change_dt").cast("timestamp_ntz").alias("changed_dt"),
        "year", "epic_mrn", "ordering_provider", "principal_result_interpreter",
        F.array_join("assistant_result_interpreter", ";").alias("assistants"),
        "modality",
    )


