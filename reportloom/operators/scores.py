"""Analysis of structured scores: distributions, crosstabs, trends, progression."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cohort import CohortConfig, cohort_condition
from .metrics import pct, period
from .windows import newest_per, with_neighbours

# Order of the scores for change over time; others count as 0.
PROGRESSION_RANK = {
    "LR-1": 1,
    "LR-2": 2,
    "LR-3": 3,
    "LR-4": 4,
    "LR-5": 5,
    "LR-M": 6,
    "LR-NC": 0,
    "LR-TIV": 7,
}


def score_reports(df: DataFrame, kind: str, text: str = "report_text") -> DataFrame:
    """Reports with at least one score: ``scores`` and ``primary_score``.

    The list is produced by a generator that drops empty ones.  A filter on a
    computed list would be pushed below the projection and extract twice.
    """
    extracted = F.array(F.struct(T.extract_scores(F.col(text), kind).alias("scores")))
    found = df.filter(T.mentions_score(F.col(text), kind)).select(
        "*", F.inline(F.filter(extracted, lambda r: F.size(r["scores"]) > 0))
    )
    return found.withColumn("primary_score", T.primary_score(F.col("scores"), kind))


@dataclass
class ScoreSearch:
    """Search for scored reports.  Empty parts do not restrict.

    ``service`` lists alternatives, separated by ``|`` or commas.
    """

    kind: str = "LIRADS"
    modalities: Sequence[str] = ()
    service: str = ""
    facilities: Sequence[str] = ()
    min_age: int | None = None
    max_age: int | None = None
    date_start: str | None = None
    date_end: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def condition(self) -> Column:
        config = CohortConfig(
            modalities=self.modalities,
            service_names=self.service.replace("|", ","),
            facilities=self.facilities,
            min_age=self.min_age,
            max_age=self.max_age,
            date_start=self.date_start,
            date_end=self.date_end,
            columns=self.columns,
        )
        return cohort_condition(config)


def score_search(df: DataFrame, search: ScoreSearch) -> DataFrame:
    """Reports the search asks for that carry a score, with ``scores`` and ``primary_score``."""
    text = search.columns.get("report_text", "report_text")
    return score_reports(df.filter(search.condition()), search.kind, text)


def severity(score: Column, kind: str) -> Column:
    """Place in the risk order; scores outside it come last."""
    order = F.lit(999)
    for place, name in reversed(list(enumerate(T.SCORE_PRIORITY.get(kind, ())))):
        order = F.when(score == name, place).otherwise(order)
    return order


def _score_counts(df: DataFrame, scores: str, patient: str | None = None) -> DataFrame:
    """Per score the mentions and patients, and those of all, from one read.

    Every row also counts for a NULL score, which gives the totals.  Scores are few,
    so the window over them is.
    """
    every = F.array_append(F.coalesce(F.col(scores), F.array().cast("array<string>")), F.lit(None).cast("string"))
    kept = [] if patient is None else [F.col(patient)]
    people = F.lit(0).cast("bigint") if patient is None else F.count_distinct(patient)
    counted = (
        df.select(F.explode(every).alias("score"), *kept)
        .groupBy("score")
        .agg(F.count(F.lit(1)).alias("mentions"), people.alias("patients"))
    )
    whole = Window.partitionBy()
    named = F.col("score").isNotNull()
    return counted.withColumns(
        {
            "all_mentions": F.sum(F.when(named, F.col("mentions"))).over(whole),
            "all_patients": F.max(F.when(~named, F.col("patients"))).over(whole),
        }
    ).filter(named)


def _share(part: str, whole: str) -> Column:
    return F.round(pct(F.col(part), F.col(whole)), 1)


def score_distribution(
    df: DataFrame,
    kind: str = "LIRADS",
    by_patients: bool = False,
    scores: str = "scores",
    patient: str = "patient_id",
) -> DataFrame:
    """Count and percentage per score, the highest risk first.

    Counts mentions against all mentions, or distinct patients against all
    patients.  The percentage has one decimal.
    """
    n, total = ("patients", "all_patients") if by_patients else ("mentions", "all_mentions")
    counted = _score_counts(df, scores, patient if by_patients else None)
    return (
        counted.filter(F.col(n) > 0)
        .select("score", F.col(n).alias("n"), _share(n, total).alias("percentage"))
        .orderBy(severity(F.col("score"), kind), "score")
    )


def score_overview(
    df: DataFrame, kind: str = "LIRADS", scores: str = "scores", patient: str = "patient_id"
) -> DataFrame:
    """Mentions and patients per score side by side, 0 where one has none."""
    counted = _score_counts(df, scores, patient)
    return (
        counted.select(
            "score",
            "mentions",
            _share("mentions", "all_mentions").alias("mention_pct"),
            "patients",
            _share("patients", "all_patients").alias("patient_pct"),
        )
        .fillna(0)
        .orderBy(severity(F.col("score"), kind), "score")
    )


def crosstab(
    df: DataFrame, a: str, b: str, margins: bool = True, all_label: str = "All"
) -> DataFrame:
    """Counts per pair of values as ``a, b, n``, with totals labelled ``All``.

    Long form: the number of columns does not depend on the data.  NULLs are
    left out before the totals are taken.
    """
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b)
    )
    counted = known.cube(a, b) if margins else known.groupBy(a, b)
    return counted.agg(F.count(F.lit(1)).alias("n")).fillna(all_label, [a, b])


def newest_per_patient(
    df: DataFrame, patient: str, ts: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    return newest_per(df, patient, [F.desc(ts), *[F.desc(t) for t in tiebreak]])


def top_values(df: DataFrame, c: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller value."""
    counted = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), c).limit(n)


def patient_stats(
    df: DataFrame,
    patient: str,
    ts: str,
    age: str = "patient_age",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Number of patients and their age at the newest report."""
    newest = newest_per_patient(df, patient, ts, tiebreak)
    # Ages are few: all numbers are taken over their counts.
    ages = newest.groupBy(F.col(age).cast("double").alias("_age")).agg(
        F.count(F.lit(1)).alias("_freq"), F.count(patient).alias("_patients")
    )
    known = F.sum(F.when(F.col("_age").isNotNull(), F.col("_freq")))
    total, squares = F.sum(F.col("_age") * F.col("_freq")), F.sum(F.col("_age") * F.col("_age") * F.col("_freq"))
    spread = F.greatest(squares - total * total / known, F.lit(0.0))
    return ages.agg(
        F.coalesce(F.sum("_patients"), F.lit(0)).alias("patients"),
        (total / F.nullif(known, F.lit(0))).alias("mean_age"),
        F.sqrt(F.when(known > 1, spread / (known - 1))).alias("std_age"),
        F.percentile(F.col("_age"), F.lit(0.5), F.col("_freq")).alias("median_age"),
    )


def share_of(df: DataFrame, c: str) -> DataFrame:
    """Count and percentage per value of a column, NULLs left out."""
    known = df.filter(F.col(c).isNotNull())
    counted = known.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select(c, "n", pct(F.col("n"), total).alias("percentage"))


def score_trend(
    df: DataFrame, ts: str, grain: str = "month", scores: str = "scores"
) -> DataFrame:
    """Mentions per period and score."""
    exploded = df.select(period(ts, grain).alias("period"), F.explode(scores).alias("score"))
    return exploded.groupBy("period", "score").agg(F.count(F.lit(1)).alias("n"))


def period_bounds(which: str, anchor: Column) -> tuple[Column, Column]:
    """First day of a named period and the day after its last, measured from the anchor."""

    def start(unit: str, months: int = 0) -> Column:
        first = F.trunc(anchor, unit)
        return F.add_months(first, months) if months else first

    tomorrow = F.date_add(anchor, 1)
    bounds = {
        "current_month": (start("month"), tomorrow),
        "last_month": (start("month", -1), start("month")),
        "current_quarter": (start("quarter"), tomorrow),
        "last_quarter": (start("quarter", -3), start("quarter")),
        "current_year": (start("year"), tomorrow),
        "5_years_ago": (start("year", -60), start("year", -48)),
    }
    if which not in bounds:
        raise ValueError(f"unknown period {which!r}")
    return bounds[which]


# Periods that are compared.
COMPARISONS = {
    "month": ("current_month", "last_month"),
    "quarter": ("current_quarter", "last_quarter"),
    "year": ("current_year", "5_years_ago"),
}


def period_compare(
    df: DataFrame,
    ts: str,
    span: str,
    anchor: dt.date | None = None,
    scores: str = "scores",
) -> DataFrame:
    """Mentions per score in a period and in the one it is compared with.

    The anchor defaults to the newest date of the data, a scalar subquery.
    """
    last = df.agg(F.max(ts).cast("date")).scalar() if anchor is None else F.lit(str(anchor)).cast("date")
    inside = []
    for which in COMPARISONS[span]:
        start, after = period_bounds(which, last)
        inside.append((F.col(ts) >= start) & (F.col(ts) < after))
    chosen = df.filter(inside[0] | inside[1]).select(
        inside[0].alias("_now"), inside[1].alias("_then"), F.explode(scores).alias("score")
    )
    return chosen.groupBy("score").agg(
        F.count_if("_now").alias("current"), F.count_if("_then").alias("previous")
    )


def score_rank(score: Column) -> Column:
    """Rank of a score for progression; unknown scores are 0, NULL stays NULL."""
    rank = F.lit(0)
    for name, value in PROGRESSION_RANK.items():
        rank = F.when(score == name, value).otherwise(rank)
    return F.when(score.isNotNull(), rank)


def progression(
    df: DataFrame,
    patient: str,
    ts: str,
    score: str,
    tiebreak: Sequence[str] = (),
    rank=score_rank,
    runs: int | None = None,
) -> DataFrame:
    """Sequence, previous score and change of patients with several reports."""
    ordered = with_neighbours(
        df,
        patient,
        [ts, *tiebreak],
        lags={"previous_score": (score, 1)},
        number="report_sequence",
        size="_reports",
        runs=runs,
    )
    return (
        ordered.filter("_reports > 1")
        .drop("_reports")
        .withColumn("score_change", rank(F.col(score)) - rank(F.col("previous_score")))
    )


def progression_summary(df: DataFrame, patient: str, change: str = "score_change") -> DataFrame:
    """Steps up, down and unchanged, and reports per patient."""
    c = F.col(change)
    return df.agg(
        F.count_if(c > 0).alias("increased"),
        F.count_if(c < 0).alias("decreased"),
        F.count_if(c == 0).alias("stable"),
        (F.count(F.lit(1)) / F.nullif(F.count_distinct(patient), F.lit(0))).alias(
            "avg_reports_per_patient"
        ),
    )
