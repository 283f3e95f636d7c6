"""Counts, turnaround times, quality and classifier metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import has_text
from ..functions.text import finding_category
from .longitudinal import pad_grid

# Longest plausible turnaround in hours, shortest section that
# counts as present, and the volume thresholds of the summaries.
MAX_TURNAROUND_HOURS = 720
SECTION_MIN_LENGTH = 10
MIN_GROUP = 10
MIN_READER = 50
MAX_DAILY_SPAN = 60


def _list(c) -> list:
    return [] if c is None else [c] if isinstance(c, (str, Column)) else list(c)


def pct(part: Column, whole: Column) -> Column:
    """Percentage, NULL for an empty whole."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def count_true(c: Column) -> Column:
    return F.count_if(c)


def count_by(
    df: DataFrame, keys: str | Sequence[str], distinct: str | None = None
) -> DataFrame:
    """Rows per group, or distinct values of a column per group."""
    metric = F.count(F.lit(1)) if distinct is None else F.count_distinct(distinct)
    return df.groupBy(*_list(keys)).agg(metric.alias("n"))


def usable(df: DataFrame, keys: Sequence[str], exclude: Sequence = ("",)) -> DataFrame:
    """Rows whose keys are neither NULL nor one of the excluded values."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
        if exclude:
            df = df.filter(~F.col(k).cast("string").isin(*exclude))
    return df


def top_n(
    df: DataFrame,
    keys: str | Sequence[str],
    n: int,
    distinct: str | None = None,
    exclude: Sequence = ("",),
) -> DataFrame:
    """The ``n`` biggest groups; ties go to the smaller key."""
    keys = _list(keys)
    counted = count_by(usable(df, keys, exclude), keys, distinct)
    return counted.orderBy(F.desc("n"), *keys).limit(n)


def top_series(
    df: DataFrame,
    x: str | Column,
    series: str,
    n: int,
    distinct: str | None = None,
    x_name: str = "x",
) -> DataFrame:
    """Counts per ``x`` for the ``n`` biggest series only."""
    biggest = top_n(df, series, n, distinct).select(series)
    metric = F.count(F.lit(1)) if distinct is None else F.count_distinct(distinct)
    x = F.col(x) if isinstance(x, str) else x
    kept = df.join(biggest, series, "left_semi")
    return kept.groupBy(x.alias(x_name), series).agg(metric.alias("n"))


# Time grains of the charts.
GRAINS = {"P1D": "day", "P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year"}


def period(ts: str | Column, grain: str) -> Column:
    """Start of the period as a date; weeks start on Monday."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(GRAINS.get(grain, grain), ts).cast("date")


def count_over_time(
    df: DataFrame,
    ts: str,
    grain: str,
    keys: str | Sequence[str] | None = None,
    distinct: str | None = None,
) -> DataFrame:
    metric = F.count(F.lit(1)) if distinct is None else F.count_distinct(distinct)
    return df.groupBy(period(ts, grain).alias("period"), *_list(keys)).agg(metric.alias("n"))


def histogram(
    df: DataFrame, c: str, by: str | None = None, upper: float | None = None, below: bool = False
) -> DataFrame:
    """Count per integer value, up to ``upper`` (or strictly ``below`` it)."""
    known = df.filter(F.col(c).isNotNull())
    if upper is not None:
        known = known.filter(F.col(c) < upper if below else F.col(c) <= upper)
    return known.groupBy(F.col(c).alias("value"), *_list(by)).agg(F.count(F.lit(1)).alias("n"))


def top_by_patients(
    df: DataFrame, keys: str | Sequence[str], patient: str, n: int
) -> DataFrame:
    """Groups with the most distinct patients."""
    return top_n(df, keys, n, distinct=patient)


def big_number(df: DataFrame, distinct: str | None = None) -> DataFrame:
    metric = F.count(F.lit(1)) if distinct is None else F.count_distinct(distinct)
    return df.agg(metric.alias("n"))


def filtered_agg(df: DataFrame, keys: str | Sequence[str], spec: dict[str, Column]) -> DataFrame:
    """Arbitrary aggregates per group, for instance ``count_if`` or ``min_by``."""
    return df.groupBy(*_list(keys)).agg(*[c.alias(name) for name, c in spec.items()])


def listing(
    df: DataFrame, cols: Sequence[str], order: Sequence[Column], n: int | None = None
) -> DataFrame:
    """Distinct column combinations, ordered."""
    out = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(*order)
    return out.limit(n) if n is not None else out


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: str | Sequence[str] | None = None,
    exact: bool = False,
    count: str | None = None,
    mean: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles per group, with the row count and the mean if named, in one pass.

    Approximate by default: a sketch of fixed size per group.  ``exact``
    interpolates; it first counts equal values, which combines before the
    shuffle, so what reaches a group is its distinct values and not its rows.
    """
    keys = _list(by)
    known = df.filter(F.col(value).isNotNull())
    if exact:
        known = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_freq"))
        rows = F.sum("_freq")
        total = F.sum(F.col(value) * F.col("_freq"))
    else:
        rows, total = F.count(F.lit(1)), F.sum(value)
    aggs = []
    if count is not None:
        aggs.append(rows.alias(count))
    if mean is not None:
        aggs.append((total / rows).alias(mean))
    for name, p in probs.items():
        q = (
            F.percentile(F.col(value), F.lit(p), F.col("_freq"))
            if exact
            else F.percentile_approx(value, F.lit(p), F.lit(accuracy))
        )
        aggs.append(q.alias(name))
    return known.groupBy(*keys).agg(*aggs)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start.cast("timestamp"), end.cast("timestamp"))


def tat_percentiles(
    df: DataFrame,
    start: str,
    end: str,
    probs: dict[str, float],
    by: str | Sequence[str] | None = None,
    exact: bool = False,
    count: str | None = None,
) -> DataFrame:
    """Turnaround percentiles in hours, over rows that end after they start.

    Whole minutes are counted, as the charts do.
    """
    keys = _list(by)
    minutes = F.timestamp_diff(
        "MINUTE", F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    )
    timed = df.filter(F.col(end) > F.col(start)).select(*keys, minutes.alias("_minutes"))
    out = quantiles(timed, "_minutes", probs, keys, exact, count)
    return out.withColumns({name: F.col(name) / 60.0 for name in probs})


def tat_bubble(
    df: DataFrame, by: str, start: str = "requested_dt", end: str = "message_dt",
    exact: bool = False,
) -> DataFrame:
    """Volume, median and 95th percentile per group."""
    probs = {"median_hours": 0.5, "p95_hours": 0.95}
    return tat_percentiles(df, start, end, probs, by, exact, count="n")


def load_quality(
    df: DataFrame,
    days: int | None = None,
    as_of: dt.date | str | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Per report: turnaround hours, lengths, section flags and periods.

    ``names`` maps the expected column names to those of the table.  Hours at or
    below zero or above 720 are NULL.
    """
    names = names or {}

    def c(name: str) -> Column:
        return F.col(names.get(name, name))

    def present(name: str) -> Column:
        return F.coalesce(F.length(c(name)) > SECTION_MIN_LENGTH, F.lit(False))

    finalized = F.coalesce(c("results_report_status_change_dt"), c("message_dt"))
    seconds = seconds_between(F.coalesce(c("observation_dt"), c("requested_dt")), finalized)
    valid = (seconds > 0) & (seconds <= MAX_TURNAROUND_HOURS * 3600)
    if days is not None:
        anchor = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
        df = df.filter(c("message_dt") >= F.date_sub(anchor, days))
    return df.select(
        "*",
        finalized.alias("report_finalized_dt"),
        F.when(valid, seconds).alias("exam_to_report_seconds"),
        (F.when(valid, seconds) / 3600.0).alias("exam_to_report_hours"),
        F.length(c("report_text")).alias("report_length"),
        present("report_section_findings").alias("has_findings"),
        present("report_section_impression").alias("has_impression"),
        present("report_section_addendum").alias("has_addendum"),
        finalized.cast("date").alias("report_date"),
        period(finalized, "week").alias("report_week"),
    )


def _hours(df: DataFrame, probs: dict[str, float], by=None, count=None, mean=None) -> DataFrame:
    """Exact percentiles of the turnaround in hours.

    At most 720 * 3600 distinct whole seconds exist, which bounds the state.
    """
    out = quantiles(df, "exam_to_report_seconds", probs, by, True, count, mean)
    scaled = [*probs, *([mean] if mean else [])]
    return out.withColumns({name: F.col(name) / 3600.0 for name in scaled})


def _hour_quantile(p: float, freq: str = "_n") -> Column:
    """Exact percentile in hours over counted seconds."""
    return F.percentile(F.col("exam_to_report_seconds"), F.lit(p), F.col(freq)) / 3600.0


def _mean_hours(freq: str = "_n") -> Column:
    seconds = F.col("exam_to_report_seconds")
    known = F.sum(F.when(seconds.isNotNull(), F.col(freq)))
    return F.sum(seconds * F.col(freq)) / F.nullif(known, F.lit(0)) / 3600.0


def quality_summary(
    df: DataFrame, reader: str = "radiologist", facility: str = "sending_facility"
) -> DataFrame:
    """One row of headline numbers over ``load_quality`` rows, read once.

    Equal (reader, facility, seconds) are counted first; all else comes from there.
    """
    flags = ("has_addendum", "has_findings", "has_impression")
    counted = df.groupBy(reader, facility, "exam_to_report_seconds").agg(
        F.count(F.lit(1)).alias("_n"), *[count_true(F.col(f)).alias(f"_{f}") for f in flags]
    )
    total = F.sum("_n")
    return counted.agg(
        F.coalesce(total, F.lit(0)).alias("total"),
        F.count_distinct(reader).alias("radiologists"),
        F.count_distinct(facility).alias("facilities"),
        pct(F.sum("_has_addendum"), total).alias("addendum_pct"),
        pct(F.sum("_has_findings"), total).alias("findings_pct"),
        pct(F.sum("_has_impression"), total).alias("impression_pct"),
        _mean_hours().alias("mean_hours"),
        _hour_quantile(0.5).alias("median_hours"),
        _hour_quantile(0.9).alias("p90_hours"),
    )


def _timed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    timed = df.filter(F.col("exam_to_report_seconds").isNotNull())
    for k in keys:
        timed = timed.filter(F.col(k).isNotNull())
    return timed


def tat_by(df: DataFrame, by: str, min_count: int = MIN_GROUP) -> DataFrame:
    """Turnaround per group, the groups with enough reports, biggest first."""
    probs = {"median_hours": 0.5, "p90_hours": 0.9}
    grouped = _hours(_timed(df, [by]), probs, by, count="n", mean="mean_hours")
    return grouped.filter(F.col("n") >= min_count).orderBy(F.desc("n"), by)


def tat_trend(df: DataFrame, max_daily_span: int = MAX_DAILY_SPAN) -> DataFrame:
    """Turnaround per day, or per week when the data spans more days than given.

    Equal (day, week, seconds) are counted first.  Days and weeks are few, so both
    the span and the groups are taken from that one table.
    """
    counted = _timed(df, []).groupBy("report_date", "report_week", "exam_to_report_seconds").agg(
        F.count(F.lit(1)).alias("_n")
    )
    daily = counted.agg(
        F.date_diff(F.max("report_date"), F.min("report_date")) <= max_daily_span
    ).scalar()
    x = F.when(daily, F.col("report_date")).otherwise(F.col("report_week"))
    return (
        counted.groupBy(x.alias("x"))
        .agg(
            F.sum("_n").alias("n"),
            _hour_quantile(0.5).alias("median_hours"),
            _hour_quantile(0.9).alias("p90_hours"),
        )
        .orderBy("x")
    )


def reader_metrics(
    df: DataFrame, reader: str = "radiologist", min_count: int = MIN_READER, n: int | None = None
) -> DataFrame:
    """Readers with enough timed reports, the busiest first; the first ``n`` if given.

    Equal (reader, seconds) are counted first, in one read of the reports.
    """
    counted = _timed(df, [reader]).groupBy(reader, "exam_to_report_seconds").agg(
        F.count(F.lit(1)).alias("_n"),
        count_true(F.col("has_addendum")).alias("_addenda"),
        F.sum("report_length").alias("_length"),
        F.count("report_length").alias("_lengths"),
    )
    total = F.sum("_n")
    readers = (
        counted.groupBy(reader)
        .agg(
            total.alias("total_reports"),
            _mean_hours().alias("mean_tat"),
            pct(F.sum("_addenda"), total).alias("addendum_rate"),
            (F.sum("_length") / F.nullif(F.sum("_lengths"), F.lit(0))).alias("avg_length"),
            _hour_quantile(0.5).alias("median_tat"),
        )
        .filter(F.col("total_reports") >= min_count)
        .orderBy(F.desc("total_reports"), reader)
    )
    return readers if n is None else readers.limit(n)


def section_completeness(
    df: DataFrame,
    sections: dict[str, str] | None = None,
    dx: str | None = "diagnoses",
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Percentage of reports with each section, and with a diagnosis."""
    # Sections the completeness chart covers.
    sections = sections or {
        "findings_pct": "report_section_findings",
        "impression_pct": "report_section_impression",
        "addendum_pct": "report_section_addendum",
    }
    total = F.count(F.lit(1))
    aggs = [
        pct(count_true(has_text(F.col(c))), total).alias(name) for name, c in sections.items()
    ]
    if dx is not None:
        some = F.coalesce(F.array_size(F.col(dx)) > 0, F.lit(False))
        aggs.append(pct(count_true(some), total).alias("diagnosis_pct"))
    return df.groupBy(*_list(by)).agg(*aggs)


def bucket(n: Column, edges: Sequence[tuple[int, int | None, str]]) -> Column:
    """Label of the first inclusive range that holds ``n``."""
    out = None
    for low, high, label in edges:
        inside = (n >= low) if high is None else n.between(low, high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


# Buckets of the patient roll-up.
EXAM_BUCKETS = ((1, 1, "1"), (2, 2, "2"), (3, 5, "3-5"), (6, 10, "6-10"), (11, None, "11+"))
MODALITY_BUCKETS = ((1, 1, "1"), (2, 2, "2"), (3, None, "3+"))


def patient_rollup(
    exams: DataFrame,
    dx: DataFrame,
    patient: str = "patient_id",
    event: str = "event_dt",
    modality: str = "modality",
    age: str = "patient_age",
    carry: Sequence[str] = ("sex", "race", "ethnic_group", "sending_facility"),
    code: str = "diagnosis_code",
) -> DataFrame:
    """One row per patient over exams, with the number of distinct diagnoses."""
    base = exams.groupBy(patient).agg(
        F.count(F.lit(1)).alias("exam_count"),
        F.count_distinct(modality).alias("modality_count"),
        F.min(event).alias("first_exam_dt"),
        F.max(event).alias("last_exam_dt"),
        F.max(age).alias("latest_age"),
        F.min(age).alias("first_age"),
        *[F.max(c).alias(c) for c in carry],
    )
    codes = (
        dx.filter(F.col(code).isNotNull())
        .groupBy(patient)
        .agg(F.count_distinct(code).alias("distinct_diagnoses"))
    )
    return base.join(codes, patient, "left").withColumns(
        {
            "distinct_diagnoses": F.coalesce("distinct_diagnoses", F.lit(0)),
            "span_days": F.timestamp_diff(
                "DAY",
                F.col("first_exam_dt").cast("timestamp"),
                F.col("last_exam_dt").cast("timestamp"),
            ),
            "exam_count_bucket": F.coalesce(
                bucket(F.col("exam_count"), EXAM_BUCKETS), F.lit("11+")
            ),
            "modality_count_bucket": F.coalesce(
                bucket(F.col("modality_count"), MODALITY_BUCKETS), F.lit("3+")
            ),
        }
    )


def patient_metrics(rollup: DataFrame) -> DataFrame:
    """Returning share and averages over a patient roll-up."""
    total = F.count(F.lit(1))
    return rollup.agg(
        total.alias("patients"),
        pct(count_true(F.col("exam_count") >= 2), total).alias("pct_returning"),
        F.avg("exam_count").alias("avg_exams"),
        F.avg("modality_count").alias("avg_modalities"),
        F.avg("distinct_diagnoses").alias("avg_diagnoses"),
    )


def classifier_metrics(
    df: DataFrame,
    by: str | Sequence[str] | None = None,
    pred: str = "followup_detected",
    truth: str = "human_ground_truth",
    processed: str = "followup_processed_at",
    reviewed: str = "human_reviewed_at",
) -> DataFrame:
    """Volume, coverage, agreement, precision and recall of a classifier."""
    p, t = F.col(pred), F.col(truth)
    done = F.col(processed).isNotNull()
    judged = t.isNotNull()
    seen = F.col(reviewed).isNotNull() & judged
    return df.groupBy(*_list(by)).agg(
        F.count(F.lit(1)).alias("n"),
        count_true(done).alias("processed"),
        pct(count_true(p), count_true(done)).alias("detection_rate"),
        count_true(seen).alias("reviewed"),
        pct(count_true(seen), count_true(done)).alias("coverage_pct"),
        pct(count_true(judged & (p == t)), count_true(judged)).alias("agreement_pct"),
        pct(count_true(p & t), count_true(p & judged)).alias("precision_pct"),
        pct(count_true(p & t), count_true(t)).alias("recall_pct"),
    )


def confusion_matrix(
    df: DataFrame, truth: str = "human_ground_truth", pred: str = "followup_detected"
) -> DataFrame:
    """Always four cells; the signed count is negative off the diagonal."""
    counted = df.filter(F.col(truth).isNotNull()).groupBy(truth, pred).agg(
        F.count(F.lit(1)).alias("cell_count")
    )
    grid = pad_grid(counted, {truth: [True, False], pred: [True, False]}, {"cell_count": 0})
    return grid.select(
        F.when(F.col(truth), "Reviewer: Yes").otherwise("Reviewer: No").alias("reviewer"),
        F.when(F.col(pred), "Model: Yes").otherwise("Model: No").alias("model"),
        "cell_count",
        F.when(F.col(truth) == F.col(pred), F.col("cell_count"))
        .otherwise(-F.col("cell_count"))
        .alias("signed_count"),
    )


def detection_by(
    df: DataFrame,
    by: str = "modality",
    pred: str = "followup_detected",
    age: str = "patient_age",
    max_age: int = 110,
) -> DataFrame:
    """Average age, detection rate and volume per group."""
    known = usable(df, [by]).filter(F.col(age) < max_age)
    return known.groupBy(by).agg(
        F.avg(age).alias("avg_age"),
        pct(count_true(F.col(pred)), F.count(F.lit(1))).alias("detection_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def detection_trend(
    df: DataFrame, ts: str = "message_dt", grain: str = "week", pred: str = "followup_detected"
) -> DataFrame:
    return df.groupBy(period(ts, grain).alias("period")).agg(
        F.count(F.lit(1)).alias("n"),
        pct(count_true(F.col(pred)), F.count(F.lit(1))).alias("detection_rate"),
    )


def followup_examples(
    df: DataFrame,
    n: int | None = None,
    ts: str = "message_dt",
    modality: str = "modality",
    pred: str = "followup_detected",
    finding: str = "followup_finding",
    snippet: str = "followup_snippet",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Detected follow-ups that carry a snippet, the newest first; the first ``n`` if given."""
    shown = df.filter(F.col(pred) & F.col(snippet).isNotNull()).orderBy(F.desc(ts), *tiebreak)
    return (shown if n is None else shown.limit(n)).select(
        ts, modality, finding_category(F.col(finding)).alias("finding_category"), snippet
    )


def run_totals(
    df: DataFrame,
    pred: str = "followup_detected",
    confidence: str = "followup_confidence",
    processed: str = "followup_processed_at",
) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(processed).alias("processed"),
        count_true(F.col(pred)).alias("positives"),
        count_true(F.col(pred) & (F.col(confidence) == "high")).alias("high_conf_pos"),
    )


def run_summary(
    df: DataFrame,
    errors: DataFrame,
    key: str = "primary_report_identifier",
    max_attempts: int = 3,
    n: int = 15,
    pred: str = "followup_detected",
    confidence: str = "followup_confidence",
    finding: str = "followup_finding",
    processed: str = "followup_processed_at",
) -> dict[str, DataFrame]:
    """Tables of a classifier run: totals, status, findings and errors."""
    high = df.filter(F.col(pred) & (F.col(confidence) == "high"))
    per_report = errors.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return {
        "totals": run_totals(df, pred, confidence, processed),
        "by_status": df.groupBy(pred, confidence).agg(F.count(F.lit(1)).alias("n")),
        "findings": top_n(high, finding, n),
        "errors": per_report.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("errors"),
            F.count(F.lit(1)).alias("reports"),
            count_true(F.col("_n") >= max_attempts).alias("abandoned"),
        ),
    }


def cohort_metrics(
    df: DataFrame,
    annotations: DataFrame,
    key: str = "accession_number",
    patient: str = "patient_id",
) -> DataFrame:
    """Inclusion and review progress; ``annotations`` holds ``key, reviewed, included``."""
    joined = df.join(annotations.select(key, "reviewed", "included"), key, "left")
    seen = F.coalesce(F.col("reviewed"), F.lit(False))
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        count_true(F.col("included_in_cohort")).alias("included"),
        count_true(~F.col("included_in_cohort")).alias("excluded"),
        count_true(seen).alias("reviewed"),
        count_true(seen & F.col("included").isNull()).alias("uncertain"),
        F.count_distinct(patient).alias("patients"),
    )


def agreement(
    df: DataFrame,
    annotations: DataFrame,
    key: str = "primary_report_identifier",
    pred: str = "followup_detected",
) -> DataFrame:
    """Reviewer answers against the model; ``annotations`` holds ``key, reviewed, ground_truth``."""
    joined = df.join(annotations.select(key, "reviewed", "ground_truth"), key, "left")
    seen = F.coalesce(F.col("reviewed"), F.lit(False))
    truth = F.col("ground_truth")
    judged = seen & truth.isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        count_true(seen & truth).alias("yes"),
        count_true(seen & ~truth).alias("no"),
        count_true(seen & truth.isNull()).alias("uncertain"),
        count_true(judged & (F.col(pred) == truth)).alias("agree"),
        pct(count_true(judged & (F.col(pred) == truth)), count_true(judged)).alias("agree_pct"),
        pct(count_true(seen), F.count(F.lit(1))).alias("progress_pct"),
    )
