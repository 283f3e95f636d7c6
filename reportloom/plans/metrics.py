"""Counts, quality, classifier, score and profile queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate
from ..operators import metrics as M
from ..operators import profile, scores, windows
from ..operators import sketches as S
from ..session import scratch_path
from .registry import query
from .search import SCORED, cohort_rows, decisions, duck_primary, duck_scores, scored
from .shapes import DOCS, EXAMS, TIMED, diagnosis_array, doc_reports, exams, timed



def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def quality(t):
    return M.load_quality(timed(t))


@query(
    "H1_count_by",
    f"""WITH {EXAMS} SELECT modality, sending_facility, CAST(year(requested_dt) AS INTEGER) AS year, count(*) AS n
       FROM exams GROUP BY ALL""",
)
def _(t):
    return M.count_by(exams(t).withColumn("year", F.year("requested_dt")), ["modality", "sending_facility", "year"])


@query(
    "H1_count_distinct_by",
    f"WITH {EXAMS} SELECT sex, race, count(DISTINCT patient_id) AS n FROM exams GROUP BY ALL",
)
def _(t):
    return M.count_by(exams(t), ["sex", "race"], "patient_id")


@query(
    "H2_top_n",
    """SELECT l_partkey, count(*) AS n FROM lineitem WHERE CAST(l_partkey AS VARCHAR) NOT IN ('', '7')
       GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20""",
)
def _(t):
    return M.top_n(t.lineitem, "l_partkey", 20, exclude=("", "7"))


@query(
    "H3_top_series",
    f"""WITH {EXAMS}, big AS (SELECT service_name FROM exams GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
       SELECT CAST(date_trunc('quarter', requested_dt) AS DATE) AS x, service_name, count(*) AS n FROM exams
       WHERE service_name IN (SELECT service_name FROM big) GROUP BY 1, 2""",
)
def _(t):
    return M.top_series(exams(t), M.period("requested_dt", "P3M"), "service_name", 5)


def _grain(code, name):
    @query(
        f"H4_count_over_time_{name}",
        f"""WITH {EXAMS} SELECT CAST(date_trunc('{name}', requested_dt) AS DATE) AS period, sending_facility,
            count(*) AS n FROM exams GROUP BY 1, 2""",
    )
    def _(t):
        return M.count_over_time(exams(t), "requested_dt", code, "sending_facility")


for _code, _name in (("P1D", "day"), ("P1W", "week"), ("P1M", "month"), ("P3M", "quarter")):
    _grain(_code, _name)


@query(
    "H5_tat_percentiles",
    f"""WITH {TIMED} SELECT modality, round(quantile_cont(m, 0.5) / 60.0, 6) AS median_hours,
       round(quantile_cont(m, 0.95) / 60.0, 6) AS p95_hours FROM (
         SELECT modality, date_diff('minute', requested_dt, message_dt) AS m FROM timed WHERE message_dt > requested_dt)
       GROUP BY 1""",
)
def _(t):
    probs = {"median_hours": 0.5, "p95_hours": 0.95}
    out = M.tat_percentiles(timed(t), "requested_dt", "message_dt", probs, "modality", exact=True)
    return rounded(out, *probs)


@query(
    "H5_tat_percentiles_approx",
    f"WITH {TIMED} SELECT DISTINCT modality, true AS median_close, true AS p95_close FROM timed",
)
def _(t):
    probs = {"median_hours": 0.5, "p95_hours": 0.95}
    args = (timed(t), "requested_dt", "message_dt", probs, "modality")
    exact = M.tat_percentiles(*args, exact=True).withColumnsRenamed({"median_hours": "m", "p95_hours": "p"})
    # The sketch returns a value of the data, the exact form interpolates.
    return M.tat_percentiles(*args).join(exact, "modality").select(
        "modality",
        (F.abs(F.col("median_hours") - F.col("m")) <= F.col("m") * 0.05).alias("median_close"),
        (F.abs(F.col("p95_hours") - F.col("p")) <= F.col("p") * 0.05).alias("p95_close"),
    )


def stored_sketches(t):
    """Turnaround sketches by day, modality and facility, written and read again."""
    by_day = timed(t).withColumn("day", F.col("message_dt").cast("date"))
    path = scratch_path(t.spark, "tat-sketches")
    minutes = S.minutes_between("requested_dt", "message_dt")
    S.quantile_sketches(by_day, minutes, ["day", "modality", "sending_facility"]).write.parquet(path)
    return t.spark.read.parquet(path)


def close_ranks(t, found, keys, probs):
    """Whether the share of turnarounds below and up to each estimate encloses its probability, with the stated error."""
    minutes = timed(t).select(
        F.col("modality"), F.trunc("message_dt", "month").alias("month"), S.minutes_between("requested_dt", "message_dt").alias("m")
    )
    checked = found.join(minutes.filter("m IS NOT NULL AND month BETWEEN '1995-03-01' AND '1997-06-01'"), keys)
    error = S.rank_error()
    return checked.groupBy(*keys, "n").agg(
        *[
            (
                (F.avg((F.col("m") < F.col(name)).cast("int")) <= p + error) & (F.avg((F.col("m") <= F.col(name)).cast("int")) >= p - error)
            ).alias(f"{name}_close")
            for name, p in probs.items()
        ]
    )


STORED_SQL = """WITH {timed} SELECT {keys}, count(*) AS n, true AS median_close, true AS p95_close FROM (
         SELECT modality, CAST(date_trunc('month', message_dt) AS DATE) AS month FROM timed WHERE message_dt > requested_dt
         AND message_dt >= DATE '1995-03-01' AND message_dt < DATE '1997-07-01') GROUP BY {keys}"""


@query("H5_stored_quantiles", STORED_SQL.format(timed=TIMED, keys="modality"))
def _(t):
    probs = {"median": 0.5, "p95": 0.95}
    days = stored_sketches(t).filter("day >= '1995-03-01' AND day < '1997-07-01'")
    return close_ranks(t, S.merged_quantiles(days, probs, "modality"), ["modality"], probs)


@query("H10_stored_trend", STORED_SQL.format(timed=TIMED, keys="modality, month"))
def _(t):
    probs = {"median": 0.5, "p95": 0.95}
    days = stored_sketches(t).filter("day >= '1995-03-01' AND day < '1997-07-01'")
    monthly = S.merged_quantiles(days.withColumn("month", F.trunc("day", "month")), probs, ["modality", "month"])
    return close_ranks(t, monthly, ["modality", "month"], probs)


def patient_sketches(t):
    """Patients by year, modality and facility, written and read again."""
    path = scratch_path(t.spark, "patient-sketches")
    by_year = exams(t).withColumn("year", F.year("requested_dt"))
    S.set_sketches(by_year, "patient_id", ["year", "modality", "sending_facility"]).write.parquet(path)
    return t.spark.read.parquet(path)


@query(
    "H1_stored_distinct",
    f"""WITH {EXAMS} SELECT modality, count(DISTINCT patient_id) AS n FROM exams
       WHERE year(requested_dt) BETWEEN 1995 AND 1997 GROUP BY modality""",
)
def _(t):
    return S.set_sizes(patient_sketches(t).filter("year BETWEEN 1995 AND 1997"), "modality")


@query(
    "H24_returning_patients",
    f"""WITH {EXAMS}, p AS (SELECT sending_facility, patient_id, bool_or(year(requested_dt) <= 1995) AS early,
         bool_or(year(requested_dt) >= 1996) AS late FROM exams GROUP BY ALL)
       SELECT sending_facility, count(*) FILTER (WHERE early) AS n_a, count(*) FILTER (WHERE late) AS n_b,
         count(*) FILTER (WHERE early AND late) AS n_both, count(*) FILTER (WHERE early AND NOT late) AS n_only_a,
         count(*) FILTER (WHERE late AND NOT early) AS n_only_b, count(*) AS n_either,
         round(100.0 * count(*) FILTER (WHERE early AND late) / nullif(count(*) FILTER (WHERE early), 0), 6) AS pct_kept
       FROM p GROUP BY 1""",
)
def _(t):
    sets = patient_sketches(t)
    found = S.compared_sets(sets.filter("year <= 1995"), sets.filter("year >= 1996"), "sending_facility")
    return found.withColumn("pct_kept", F.round("pct_kept", 6))


@query(
    "H6_tat_bubble",
    f"""WITH {TIMED} SELECT modality, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(m, 0.5) / 60.0, 6) AS median_hours,
       round(quantile_cont(m, 0.95) / 60.0, 6) AS p95_hours FROM (
         SELECT modality, date_diff('minute', requested_dt, message_dt) AS m FROM timed WHERE message_dt > requested_dt)
       GROUP BY 1""",
)
def _(t):
    return rounded(M.tat_bubble(timed(t), "modality", exact=True), "median_hours", "p95_hours")


@query(
    "H7_load_quality",
    f"""WITH {TIMED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, finalized AS report_finalized_dt,
       round(hours, 6) AS exam_to_report_hours, CAST(length(report_text) AS INTEGER) AS report_length, has_findings,
       has_impression, has_addendum, CAST(finalized AS DATE) AS report_date,
       CAST(date_trunc('week', finalized) AS DATE) AS report_week FROM quality
       WHERE message_dt >= DATE '1998-01-01'""",
)
def _(t):
    out = M.load_quality(timed(t), days=365, as_of="1999-01-01")
    return rounded(out, "exam_to_report_hours").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "report_finalized_dt", "exam_to_report_hours",
        "report_length", "has_findings", "has_impression", "has_addendum", "report_date", "report_week",
    )


def share(flag: str) -> str:
    return f"round(100.0 * count(*) FILTER (WHERE {flag}) / count(*), 6)"


@query(
    "H8_quality_summary",
    f"""WITH {TIMED} SELECT count(*) AS total, count(DISTINCT radiologist) AS radiologists,
       count(DISTINCT sending_facility) AS facilities, round(avg(hours), 6) AS mean_hours,
       round(median(hours), 6) AS median_hours, round(quantile_cont(hours, 0.9), 6) AS p90_hours,
       {share('has_addendum')} AS addendum_pct, {share('has_findings')} AS findings_pct,
       {share('has_impression')} AS impression_pct FROM quality""",
)
def _(t):
    names = ("mean_hours", "median_hours", "p90_hours", "addendum_pct", "findings_pct", "impression_pct")
    return rounded(M.quality_summary(quality(t)), *names)


@query(
    "H9_tat_by",
    f"""WITH {TIMED} SELECT modality, CAST(count(*) AS BIGINT) AS n, round(avg(hours), 6) AS mean_hours,
       round(median(hours), 6) AS median_hours, round(quantile_cont(hours, 0.9), 6) AS p90_hours FROM quality
       WHERE hours IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""",
)
def _(t):
    return rounded(M.tat_by(quality(t), "modality"), "mean_hours", "median_hours", "p90_hours")


@query(
    "H10_tat_trend",
    f"""WITH {TIMED}, q AS (SELECT *, CAST(finalized AS DATE) AS d,
         CAST(date_trunc('week', finalized) AS DATE) AS w FROM quality WHERE hours IS NOT NULL),
       x AS (SELECT *, CASE WHEN (SELECT max(d) - min(d) FROM q) <= 60 THEN d ELSE w END AS x FROM q)
       SELECT x, CAST(count(*) AS BIGINT) AS n, round(median(hours), 6) AS median_hours,
       round(quantile_cont(hours, 0.9), 6) AS p90_hours FROM x GROUP BY 1""",
)
def _(t):
    return rounded(M.tat_trend(quality(t)), "median_hours", "p90_hours")


@query(
    "H11_reader_metrics",
    f"""WITH {TIMED} SELECT l_linenumber, count(*) AS total_reports, round(avg(hours), 6) AS mean_tat,
       round(median(hours), 6) AS median_tat, {share('has_addendum')} AS addendum_rate,
       round(avg(length(report_text)), 6) AS avg_length FROM quality WHERE hours IS NOT NULL
       GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 4""",
)
def _(t):
    return rounded(
        M.reader_metrics(quality(t), "l_linenumber", 5, 4), "mean_tat", "median_tat", "addendum_rate", "avg_length"
    )


@query(
    "H12_section_completeness",
    f"""WITH {TIMED} SELECT modality, {share("trim(findings) <> ''")} AS findings_pct,
       {share("trim(impression) <> ''")} AS impression_pct, {share("trim(addendum) <> ''")} AS addendum_pct,
       {share("sending_facility <> 'R'")} AS diagnosis_pct FROM timed GROUP BY 1""",
)
def _(t):
    dx = diagnosis_array((F.col("sending_facility"), F.col("modality")))
    some = timed(t).withColumn(
        "diagnoses",
        F.when(F.col("sending_facility") == "A", dx).when(
            F.col("sending_facility") == "N", F.concat(dx, dx)
        ).otherwise(F.filter(dx, lambda d: F.lit(False))),
    )
    out = M.section_completeness(some, by="modality")
    return rounded(out, "findings_pct", "impression_pct", "addendum_pct", "diagnosis_pct")


ROLLUP = f"""{EXAMS}, dx AS (SELECT o_custkey AS patient_id, count(DISTINCT l_partkey) AS d FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1),
  rollup AS (SELECT e.patient_id, count(*) AS exam_count, count(DISTINCT modality) AS modality_count,
    min(requested_dt) AS first_exam_dt, max(requested_dt) AS last_exam_dt, max(patient_age) AS latest_age,
    min(patient_age) AS first_age, max(sex) AS sex, max(race) AS race, max(ethnic_group) AS ethnic_group,
    max(sending_facility) AS sending_facility, coalesce(max(d), 0) AS distinct_diagnoses,
    date_diff('day', min(requested_dt), max(requested_dt)) AS span_days,
    CASE WHEN count(*) <= 2 THEN CAST(count(*) AS VARCHAR) WHEN count(*) <= 5 THEN '3-5'
      WHEN count(*) <= 10 THEN '6-10' ELSE '11+' END AS exam_count_bucket,
    CASE WHEN count(DISTINCT modality) <= 2 THEN CAST(count(DISTINCT modality) AS VARCHAR) ELSE '3+' END
      AS modality_count_bucket FROM exams e LEFT JOIN dx ON dx.patient_id = e.patient_id GROUP BY 1)"""


def rollup(t):
    dx = t.lineitem.filter("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    dx = dx.select(F.col("o_custkey").alias("patient_id"), F.col("l_partkey").alias("diagnosis_code"))
    return M.patient_rollup(exams(t), dx, event="requested_dt")


@query("H13_patient_rollup", f"WITH {ROLLUP} SELECT * FROM rollup")
def _(t):
    return rollup(t)


@query(
    "H14_patient_metrics",
    f"""WITH {ROLLUP} SELECT count(*) AS patients, round(100.0 * count(*) FILTER (WHERE exam_count >= 2) / count(*), 6)
       AS pct_returning, round(avg(exam_count), 6) AS avg_exams, round(avg(modality_count), 6) AS avg_modalities,
       round(avg(distinct_diagnoses), 6) AS avg_diagnoses FROM rollup""",
)
def _(t):
    names = ("pct_returning", "avg_exams", "avg_modalities", "avg_diagnoses")
    return rounded(M.patient_metrics(rollup(t)), *names)


@query(
    "H15_histogram",
    f"""WITH {EXAMS} SELECT patient_age AS value, sex, count(*) AS n FROM exams WHERE patient_age < 80 GROUP BY ALL""",
)
def _(t):
    return M.histogram(exams(t), "patient_age", "sex", 80, below=True)


@query(
    "H15_histogram_rollup",
    f"WITH {ROLLUP} SELECT distinct_diagnoses AS value, count(*) AS n FROM rollup WHERE distinct_diagnoses <= 30 GROUP BY 1",
)
def _(t):
    return M.histogram(rollup(t), "distinct_diagnoses", upper=30)


@query(
    "H16_top_by_patients",
    """SELECT p_brand, p_type, count(DISTINCT o_custkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15""",
)
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    return M.top_by_patients(joined, ["p_brand", "p_type"], "o_custkey", 15)


def judged(t):
    """Classified documents; those with a label were reviewed."""
    stamp = F.when(F.col("followup_detected").isNotNull(), F.col("message_dt"))
    return doc_reports(t).withColumns(
        {"followup_processed_at": F.col("message_dt"), "human_reviewed_at": stamp}
    )


@query(
    "H17_classifier_metrics",
    f"""WITH {DOCS} SELECT modality, count(*) AS n, count(*) AS processed,
       round(100.0 * count(*) FILTER (WHERE followup_detected) / count(*), 6) AS detection_rate,
       count(human_ground_truth) AS reviewed, round(100.0 * count(human_ground_truth) / count(*), 6) AS coverage_pct,
       round(100.0 * count(*) FILTER (WHERE followup_detected = human_ground_truth) / nullif(count(human_ground_truth), 0), 6)
         AS agreement_pct,
       round(100.0 * count(*) FILTER (WHERE followup_detected AND human_ground_truth)
         / nullif(count(*) FILTER (WHERE followup_detected AND human_ground_truth IS NOT NULL), 0), 6) AS precision_pct,
       round(100.0 * count(*) FILTER (WHERE followup_detected AND human_ground_truth)
         / nullif(count(*) FILTER (WHERE human_ground_truth), 0), 6) AS recall_pct FROM docs GROUP BY 1""",
)
def _(t):
    names = ("detection_rate", "coverage_pct", "agreement_pct", "precision_pct", "recall_pct")
    return rounded(M.classifier_metrics(judged(t), "modality"), *names)


@query(
    "H18_confusion_matrix",
    f"""WITH {DOCS}, g AS (SELECT * FROM (VALUES (true, true), (true, false), (false, true), (false, false)) v(t, p)),
       c AS (SELECT human_ground_truth AS t, followup_detected AS p, count(*) AS n FROM docs
         WHERE human_ground_truth IS NOT NULL GROUP BY 1, 2)
       SELECT CASE WHEN t THEN 'Reviewer: Yes' ELSE 'Reviewer: No' END AS reviewer,
         CASE WHEN p THEN 'Model: Yes' ELSE 'Model: No' END AS model, coalesce(n, 0) AS cell_count,
         CASE WHEN t = p THEN coalesce(n, 0) ELSE -coalesce(n, 0) END AS signed_count FROM g LEFT JOIN c USING (t, p)""",
)
def _(t):
    return M.confusion_matrix(doc_reports(t))


@query(
    "H19_detection_by",
    f"""WITH {DOCS} SELECT modality, round(avg(patient_age), 6) AS avg_age,
       round(100.0 * count(*) FILTER (WHERE followup_detected) / count(*), 6) AS detection_rate, count(*) AS n
       FROM docs WHERE patient_age < 110 GROUP BY 1""",
)
def _(t):
    return rounded(M.detection_by(doc_reports(t)), "avg_age", "detection_rate")


@query(
    "H20_detection_trend",
    f"""WITH {DOCS} SELECT CAST(date_trunc('day', message_dt) AS DATE) AS period, count(*) AS n,
       round(100.0 * count(*) FILTER (WHERE followup_detected) / count(*), 6) AS detection_rate FROM docs GROUP BY 1""",
)
def _(t):
    return rounded(M.detection_trend(doc_reports(t), grain="day"), "detection_rate")


@query(
    "H20_followup_examples",
    f"""WITH {DOCS} SELECT message_dt, modality, split_part(followup_finding, ':', 1) AS finding_category,
       sending_facility AS followup_snippet FROM docs WHERE followup_detected
       ORDER BY message_dt DESC LIMIT 1000""",
)
def _(t):
    found = doc_reports(t).withColumn("followup_snippet", F.col("sending_facility"))
    return M.followup_examples(found, 1000)


@query(
    "H21_run_summary",
    f"""WITH {DOCS}, e AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY 1)
       SELECT 'totals' AS part, 'total' AS label, count(*) AS n FROM docs
       UNION ALL SELECT 'totals', 'processed', count(human_ground_truth) FROM docs
       UNION ALL SELECT 'totals', 'positives', count(*) FILTER (WHERE followup_detected) FROM docs
       UNION ALL SELECT 'totals', 'high_conf_pos', count(*) FILTER (WHERE followup_detected AND followup_confidence = 'high') FROM docs
       UNION ALL SELECT 'by_status', concat_ws('/', followup_detected, followup_confidence), count(*) FROM docs GROUP BY 2
       UNION ALL (SELECT 'findings', followup_finding, count(*) AS n FROM docs
         WHERE followup_detected AND followup_confidence = 'high' GROUP BY 2 ORDER BY n DESC, 2 LIMIT 15)
       UNION ALL SELECT 'errors', 'errors', CAST(sum(c) AS BIGINT) FROM e
       UNION ALL SELECT 'errors', 'reports', count(*) FROM e
       UNION ALL SELECT 'errors', 'abandoned', count(*) FILTER (WHERE c >= 3) FROM e""",
)
def _(t):
    errors = t.events.filter("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("primary_report_identifier")
    )
    parts = M.run_summary(doc_reports(t), errors, processed="human_ground_truth")

    def tall(name, *cols):
        cells = [F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in cols]
        return parts[name].select(F.lit(name).alias("part"), F.inline(F.array(*cells)))

    status = parts["by_status"].select(
        F.lit("by_status").alias("part"),
        F.concat_ws("/", F.col("followup_detected").cast("string"), "followup_confidence").alias("label"),
        "n",
    )
    findings = parts["findings"].select(
        F.lit("findings").alias("part"), F.col("followup_finding").alias("label"), "n"
    )
    return (
        tall("totals", "total", "processed", "positives", "high_conf_pos")
        .unionByName(status)
        .unionByName(findings)
        .unionByName(tall("errors", "errors", "reports", "abandoned"))
    )


def with_scores(t):
    """Documents with LI-RADS scores; the source is the patient."""
    base = scored(t).withColumnsRenamed({"text": "report_text", "source": "patient_id"})
    return scores.score_reports(base, "LIRADS").drop("report_text")


LR = f"""{SCORED}, s AS (SELECT doc_id, source AS patient_id, n, {duck_scores('LIRADS')} AS sc FROM scored),
  p AS (SELECT *, {duck_primary('LIRADS')} AS primary_score FROM s),
  m AS (SELECT doc_id, patient_id, unnest(sc) AS score FROM s)"""


@query(
    "H22_score_distribution",
    f"""WITH {LR} SELECT score, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM m), 1) AS percentage
       FROM m GROUP BY 1""",
)
def _(t):
    return scores.score_distribution(with_scores(t))


@query(
    "H22_score_overview",
    f"""WITH {LR}, a AS (SELECT score, count(*) AS mentions, count(DISTINCT patient_id) AS patients FROM m GROUP BY 1)
       SELECT score, mentions, round(100.0 * mentions / (SELECT count(*) FROM m), 1) AS mention_pct, patients,
       round(100.0 * patients / (SELECT count(DISTINCT patient_id) FROM m), 1) AS patient_pct FROM a""",
)
def _(t):
    return scores.score_overview(with_scores(t))


BANDS = """CASE WHEN {a} > 0 AND {a} <= 40 THEN '<40' WHEN {a} > 40 AND {a} <= 50 THEN '40-49'
  WHEN {a} > 50 AND {a} <= 60 THEN '50-59' WHEN {a} > 60 AND {a} <= 70 THEN '60-69'
  WHEN {a} > 70 AND {a} <= 80 THEN '70-79' WHEN {a} > 80 AND {a} <= 200 THEN '80+' END"""


@query(
    "H23_crosstab",
    f"""WITH {EXAMS}, newest AS (SELECT *, row_number() OVER (PARTITION BY patient_id
         ORDER BY requested_dt DESC, o_orderkey DESC) AS rn FROM exams),
       c AS (SELECT modality, {BANDS.format(a='patient_age')} AS age_group FROM newest WHERE rn = 1)
       SELECT coalesce(modality, 'All') AS modality, coalesce(age_group, 'All') AS age_group, count(*) AS n
       FROM c WHERE age_group IS NOT NULL GROUP BY CUBE (modality, age_group)""",
)
def _(t):
    newest = scores.newest_per_patient(exams(t), "patient_id", "requested_dt", ["o_orderkey"])
    banded = newest.withColumn("age_group", curate.age_cut(F.col("patient_age")))
    return scores.crosstab(banded, "modality", "age_group")


@query(
    "H23_top_values",
    f"""WITH {EXAMS} SELECT race, count(*) AS n FROM exams GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
)
def _(t):
    return scores.top_values(exams(t), "race", 10)


@query(
    "H24_patient_stats",
    f"""WITH {EXAMS}, newest AS (SELECT *, row_number() OVER (PARTITION BY patient_id
         ORDER BY requested_dt DESC, o_orderkey DESC) AS rn FROM exams)
       SELECT count(patient_id) AS patients, round(avg(patient_age), 6) AS mean_age,
       round(median(patient_age), 6) AS median_age, round(stddev_samp(patient_age), 6) AS std_age FROM newest WHERE rn = 1""",
)
def _(t):
    out = scores.patient_stats(exams(t), "patient_id", "requested_dt", tiebreak=["o_orderkey"])
    return rounded(out, "mean_age", "median_age", "std_age")


@query(
    "H24_share_of",
    """SELECT c_mktsegment, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS percentage
       FROM customer GROUP BY 1""",
)
def _(t):
    return rounded(scores.share_of(t.customer, "c_mktsegment"), "percentage")


def dated_scores(t):
    """Line items as score mentions of a date."""
    score = F.array(F.concat(F.lit("LR-"), F.col("l_linenumber").cast("string")), F.col("l_returnflag"))
    return t.lineitem.select("l_shipdate", score.alias("scores"))


DATED = """d AS (SELECT l_shipdate, unnest(['LR-' || l_linenumber, l_returnflag]) AS score FROM lineitem)"""


@query(
    "H25_score_trend",
    f"""WITH {DATED} SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, score, count(*) AS n FROM d
       GROUP BY 1, 2""",
)
def _(t):
    return scores.score_trend(dated_scores(t), "l_shipdate", "month")


def _compare(span, now, then):
    @query(
        f"H26_period_compare_{span}",
        f"""WITH {DATED}, a AS (SELECT CAST(max(l_shipdate) AS DATE) AS a FROM lineitem)
            SELECT score, count(*) FILTER (WHERE {now}) AS current, count(*) FILTER (WHERE {then}) AS previous
            FROM d, a WHERE {now} OR {then} GROUP BY 1""",
    )
    def _(t):
        return scores.period_compare(dated_scores(t), "l_shipdate", span)


_compare(
    "month",
    "l_shipdate >= date_trunc('month', a) AND l_shipdate < a + 1",
    "l_shipdate >= date_trunc('month', a) - INTERVAL 1 MONTH AND l_shipdate < date_trunc('month', a)",
)
_compare(
    "quarter",
    "l_shipdate >= date_trunc('quarter', a) AND l_shipdate < a + 1",
    "l_shipdate >= date_trunc('quarter', a) - INTERVAL 3 MONTH AND l_shipdate < date_trunc('quarter', a)",
)
_compare(
    "year",
    "l_shipdate >= date_trunc('year', a) AND l_shipdate < a + 1",
    "l_shipdate >= date_trunc('year', a) - INTERVAL 5 YEAR AND l_shipdate < date_trunc('year', a) - INTERVAL 4 YEAR",
)

STEPS = """steps AS (
  SELECT o_custkey AS patient_id, o_orderkey, o_orderdate, 'LR-' || left(o_orderpriority, 1) AS score,
    count(*) OVER (PARTITION BY o_custkey) AS c,
    row_number() OVER w AS report_sequence, lag('LR-' || left(o_orderpriority, 1)) OVER w AS previous_score
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
progress AS (SELECT patient_id, o_orderkey, score, previous_score, report_sequence,
  CAST(substr(score, 4) AS INTEGER) - CAST(substr(previous_score, 4) AS INTEGER) AS score_change FROM steps WHERE c > 1)"""


def progress(t, runs=None):
    base = t.orders.select(
        F.col("o_custkey").alias("patient_id"),
        "o_orderkey",
        "o_orderdate",
        F.concat(F.lit("LR-"), F.substring("o_orderpriority", 1, 1)).alias("score"),
    )
    return scores.progression(base, "patient_id", "o_orderdate", "score", ["o_orderkey"], runs=runs).drop(
        "o_orderdate"
    )


@query(
    "H27_progression_summary",
    f"""WITH {STEPS} SELECT count(*) FILTER (WHERE score_change > 0) AS increased,
       count(*) FILTER (WHERE score_change < 0) AS decreased, count(*) FILTER (WHERE score_change = 0) AS stable,
       round(count(*) / count(DISTINCT patient_id), 6) AS avg_reports_per_patient FROM progress""",
)
def _(t):
    return rounded(scores.progression_summary(progress(t), "patient_id"), "avg_reports_per_patient")


CATEGORICAL = """WITH c AS (SELECT nullif({c}, '') AS label, count(*) AS n FROM {t} GROUP BY 1),
  f AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER (WHERE label IS NULL), 0) AS e, count(label) AS d FROM c),
  named AS (SELECT CASE WHEN d > 3 - (e > 0)::INT THEN greatest(1, 2 - (e > 0)::INT) ELSE greatest(1, 3 - (e > 0)::INT) END AS k FROM f),
  r AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS rn FROM c WHERE label IS NOT NULL),
  rows AS (SELECT label, 'value' AS kind, n FROM r WHERE rn <= (SELECT k FROM named)
    UNION ALL SELECT 'other', 'other', sum(n) FROM r WHERE rn > (SELECT k FROM named) HAVING sum(n) > 0
    UNION ALL SELECT 'empty', 'empty', e FROM f WHERE e > 0)
  SELECT label, kind, CAST(n AS BIGINT) AS n, round(100.0 * n / (SELECT total FROM f), 6) AS pct FROM rows"""


@query("H28_profile_categorical", CATEGORICAL.format(c="event_type", t="events"))
def _(t):
    return rounded(profile.profile_categorical(t.events, "event_type"), "pct")


@query(
    "H28_profile_categorical_empty",
    CATEGORICAL.format(c="CASE WHEN lang = 'en' THEN lang WHEN lang = 'fr' THEN '' ELSE source END", t="documents"),
)
def _(t):
    c = F.when(F.col("lang") == "en", F.col("lang")).when(F.col("lang") == "fr", "").otherwise(F.col("source"))
    return rounded(profile.profile_categorical(t.documents.withColumn("c", c), "c"), "pct")


@query(
    "H29_profile_numeric",
    """WITH f AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi FROM events),
       g AS (SELECT *, (hi - lo) / least(20, ceil(sqrt(n))) AS rough FROM f),
       s AS (SELECT *, pow(10, floor(log10(rough))) AS mag FROM g),
       w AS (SELECT *, CASE WHEN rough <= mag THEN mag WHEN rough <= 2 * mag THEN 2 * mag
         WHEN rough <= 5 * mag THEN 5 * mag ELSE 10 * mag END AS step FROM s),
       cells AS (SELECT unnest(range(CAST(floor(lo / step) AS BIGINT), CAST(floor(hi / step) AS BIGINT) + 1)) AS cell, w.* FROM w),
       c AS (SELECT CAST(floor(value / step) AS BIGINT) AS cell, count(*) AS n FROM events, w GROUP BY 1)
       SELECT round(cells.cell * step, 6) AS low, round((cells.cell + 1) * step, 6) AS high, coalesce(c.n, 0) AS n,
       lo AS min, hi AS max FROM cells LEFT JOIN c ON c.cell = cells.cell""",
)
def _(t):
    return rounded(profile.profile_numeric(t.events, "value", 20), "low", "high")


@query(
    "H30_profile_temporal",
    """WITH c AS (SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS b, count(*) AS n FROM events GROUP BY 1),
       g AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 2 DAY)) AS b FROM c)
       SELECT g.b AS bucket_start, g.b + INTERVAL 2 DAY AS bucket_end, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.b = g.b""",
)
def _(t):
    out = profile.profile_temporal(t.events, "ts", 20)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bucket_start", "bucket_end")})


@query(
    "H30_profile_temporal_quarters",
    """WITH c AS (SELECT date_trunc('quarter', l_shipdate) AS b, count(*) AS n FROM lineitem GROUP BY 1),
       g AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 3 MONTH)) AS b FROM c)
       SELECT CAST(g.b AS TIMESTAMP) AS bucket_start, CAST(g.b + INTERVAL 3 MONTH AS TIMESTAMP) AS bucket_end,
       coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.b = g.b""",
)
def _(t):
    out = profile.profile_temporal(t.lineitem, "l_shipdate", 30)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bucket_start", "bucket_end")})


@query("H31_profile_identifier", "SELECT count(DISTINCT l_orderkey) AS distinct FROM lineitem")
def _(t):
    return profile.profile_identifier(t.lineitem, "l_orderkey")


@query(
    "H31_column_kinds",
    f"""WITH {EXAMS}, texts AS (SELECT bool_and(regexp_matches(nullif(modality, ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS m,
         bool_and(regexp_matches(CAST(CAST(requested_dt AS DATE) AS VARCHAR), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS d FROM exams)
       SELECT column_name, CASE kind WHEN 'modality' THEN CASE WHEN m THEN 'temporal' WHEN NOT m THEN 'categorical' ELSE 'none' END
         WHEN 'day' THEN CASE WHEN d THEN 'temporal' WHEN NOT d THEN 'categorical' ELSE 'none' END ELSE kind END AS kind
       FROM texts, (VALUES ('accession_number', 'identifier'), ('modality', 'modality'), ('patient_age', 'numeric'),
       ('requested_dt', 'temporal'), ('day', 'day'), ('diagnoses', 'none')) v(column_name, kind)""",
)
def _(t):
    base = exams(t).select(
        "accession_number", "modality", "patient_age", "requested_dt",
        F.col("requested_dt").cast("date").cast("string").alias("day"),
        diagnosis_array((F.col("modality"), F.col("sex"))).alias("diagnoses"),
    )
    return profile.column_kinds(base)


@query(
    "H32_cohort_metrics",
    f"""WITH {EXAMS}, f AS (SELECT *, modality = '1-URGENT' OR race = 'BUILDING' AS inc, report_status <> 'P' AS rev,
         CASE sex WHEN 'F' THEN patient_age > 50 END AS decision FROM exams)
       SELECT count(*) AS total, count(*) FILTER (WHERE inc) AS included, count(*) FILTER (WHERE NOT inc) AS excluded,
       count(*) FILTER (WHERE rev) AS reviewed, count(*) FILTER (WHERE rev AND decision IS NULL) AS uncertain,
       count(DISTINCT patient_id) AS patients FROM f""",
)
def _(t):
    return M.cohort_metrics(cohort_rows(t), decisions(t))


@query(
    "H33_agreement",
    """WITH d AS (SELECT d.doc_id, toxic = 1 AS p, l.doc_id IS NOT NULL AS seen,
         CASE WHEN d.lang <> 'fr' THEN quality = 1 END AS g FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       SELECT count(*) AS total, count(*) FILTER (WHERE seen AND g) AS yes, count(*) FILTER (WHERE seen AND NOT g) AS no,
       count(*) FILTER (WHERE seen AND g IS NULL) AS uncertain, count(*) FILTER (WHERE seen AND p = g) AS agree,
       round(100.0 * count(*) FILTER (WHERE seen AND p = g) / count(*) FILTER (WHERE seen AND g IS NOT NULL), 6) AS agree_pct,
       round(100.0 * count(*) FILTER (WHERE seen) / count(*), 6) AS progress_pct FROM d""",
)
def _(t):
    notes = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").cast("string").alias("primary_report_identifier"),
        F.lit(True).alias("reviewed"),
        F.when(F.col("lang") != "fr", F.col("quality") == 1).alias("ground_truth"),
    )
    return rounded(M.agreement(doc_reports(t), notes), "agree_pct", "progress_pct")


@query(
    "H34_big_number",
    """SELECT 'messages' AS label, count(*) AS n FROM lineitem
       UNION ALL SELECT 'exams', count(DISTINCT l_orderkey) FROM lineitem""",
)
def _(t):
    every = M.big_number(t.lineitem).select(F.lit("messages").alias("label"), "n")
    return every.unionByName(M.big_number(t.lineitem, "l_orderkey").select(F.lit("exams").alias("label"), "n"))


@query(
    "H35_filtered_agg",
    f"""WITH {EXAMS} SELECT sending_facility, count(*) FILTER (WHERE modality = '1-URGENT') AS urgent,
       any_value(ethnic_group) AS region, array_to_string(list_sort(array_agg(DISTINCT modality)), ',') AS modalities,
       min_by(o_orderkey, CAST(requested_dt AS VARCHAR) || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS first_exam
       FROM exams GROUP BY 1""",
)
def _(t):
    return M.filtered_agg(
        exams(t),
        "sending_facility",
        {
            "urgent": F.count_if(F.col("modality") == "1-URGENT"),
            "region": F.any_value("ethnic_group"),
            "modalities": F.array_join(F.array_sort(F.collect_set("modality")), ","),
            "first_exam": F.min_by("o_orderkey", F.struct("requested_dt", "o_orderkey")),
        },
    )


@query(
    "H36_listing",
    f"""WITH {EXAMS} SELECT requested_dt, modality, sending_facility, count(*) AS n FROM exams
       GROUP BY 1, 2, 3 ORDER BY 1 DESC, 2, 3 LIMIT 100""",
)
def _(t):
    cols = ["requested_dt", "modality", "sending_facility"]
    return M.listing(exams(t), cols, [F.desc("requested_dt"), F.col("modality"), F.col("sending_facility")], 100)


@query(
    "I1_newest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def _(t):
    newest = windows.newest_per(t.orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "I2_duplicate_rank",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END
       ORDER BY o_orderkey) > 1 AS is_duplicate FROM orders""",
)
def _(t):
    pairs = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("mpi"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("epic_mrn"),
    )
    return windows.duplicate_rank(pairs, ["mpi", "epic_mrn"], "o_orderkey").select("o_orderkey", "is_duplicate")


@query(
    "I3_stratified",
    f"""WITH {DOCS} SELECT doc_id, modality, followup_detected, followup_confidence FROM (
         SELECT *, row_number() OVER (PARTITION BY modality, followup_detected, followup_confidence
           ORDER BY message_dt DESC, primary_report_identifier) AS rn FROM docs
         WHERE followup_detected IS NOT NULL AND followup_confidence IS NOT NULL) WHERE rn <= 5""",
)
def _(t):
    strata = ["modality", "followup_detected", "followup_confidence"]
    order = [F.desc("message_dt"), F.col("primary_report_identifier")]
    return windows.stratified(doc_reports(t), strata, 5, order).select("doc_id", *strata)


@query(
    "I4_tag_new_returning",
    """SELECT o_custkey, o_orderkey, CASE WHEN date_trunc('month', o_orderdate) =
       date_trunc('month', min(o_orderdate) OVER (PARTITION BY o_custkey)) THEN 'new' ELSE 'returning' END AS cohort
       FROM orders""",
)
def _(t):
    return windows.tag_new_returning(t.orders, "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey", "cohort")


BURSTS = """burst AS (
  SELECT patient_id, min(o_orderdate) AS burst_first, min_by(third, CAST(o_orderdate AS VARCHAR) || CAST(third AS VARCHAR)) AS burst_last FROM (
    SELECT o_custkey AS patient_id, o_orderdate,
      lead(o_orderdate, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS third FROM orders)
  WHERE datesub('month', o_orderdate, third) <= 6 GROUP BY 1)"""


def _bursts(name, runs):
    @query(name, f"WITH {BURSTS} SELECT * FROM burst")
    def _(t):
        base = t.orders.withColumnRenamed("o_custkey", "patient_id")
        return windows.bursts(base, "patient_id", "o_orderdate", 3, 6, ["o_orderkey"], runs)


def _progression(name, runs):
    @query(name, f"WITH {STEPS} SELECT * FROM progress")
    def _(t):
        return progress(t, runs)


# The second of each pair cuts the rows into many runs, so most patients near a cut are split.
_bursts("I5_bursts", None)
_bursts("I5_bursts_hot_keys", 97)
_progression("I6_progression", None)
_progression("I6_progression_hot_keys", 97)


@query(
    "I7_newest_per_patient",
    f"""WITH {EXAMS} SELECT patient_id, accession_number, patient_age FROM (SELECT *, row_number() OVER (
       PARTITION BY patient_id ORDER BY requested_dt DESC, accession_number DESC) AS rn FROM exams) WHERE rn = 1""",
)
def _(t):
    newest = scores.newest_per_patient(exams(t), "patient_id", "requested_dt", ["accession_number"])
    return newest.select("patient_id", "accession_number", "patient_age")


@query(
    "I8_latest_status",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
       ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t):
    return windows.latest_status(t.events, "user_id", "ts", ["event_id"]).select("user_id", "event_id", "event_type")


@query(
    "I9_display_id",
    f"""WITH {EXAMS} SELECT primary_report_identifier, CASE WHEN sex = 'F' THEN epic_mrn WHEN modality <> '5-LOW'
       THEN mpi ELSE CAST(patient_id AS VARCHAR) END AS label FROM exams""",
)
def _(t):
    return exams(t).select(
        "primary_report_identifier",
        windows.display_id(
            F.when(F.col("sex") == "F", F.col("epic_mrn")),
            F.when(F.col("modality") != "5-LOW", F.col("mpi")),
            F.col("patient_id").cast("string"),
        ).alias("label"),
    )
