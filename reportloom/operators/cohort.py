"""Cohort search: build, scope, filter and review sets of reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T

# Columns of a cohort row.
COHORT_COLUMNS = (
    "accession_number",
    "patient_id",
    "epic_mrn",
    "mpi",
    "patient_age",
    "sex",
    "race",
    "ethnic_group",
    "modality",
    "service_name",
    "requested_dt",
    "observation_dt",
    "report_text",
    "diagnoses",
    "sending_facility",
    "message_dt",
)
# Columns a saved search must carry, and text columns a listing
# leaves out.
REQUIRED_COLUMNS = ("primary_report_identifier", "accession_number")
HEAVY_COLUMNS = (
    "report_text",
    "report_section_findings",
    "report_section_impression",
    "report_section_addendum",
)
COHORT_SLOT = "{{cohort}}"
# Columns and tables reports may be read by.
READ_COLUMNS = (
    "primary_report_identifier",
    "accession_number",
    "epic_mrn",
    "patient_mpi",
    "patient_id",
)
READ_TABLES = (
    "reports_curated",
    "reports_curated_epic_view",
    "reports_latest",
    "reports_latest_epic_view",
)


@dataclass
class CohortConfig:
    """Search form.  Empty parts do not restrict."""

    diagnosis_codes: Sequence[str] = ()
    diagnosis_text: str = ""
    text_terms: Sequence[str] | str = ()
    modalities: Sequence[str] = ()
    service_names: Sequence[str] | str = ()
    facilities: Sequence[str] = ()
    min_age: int | None = None
    max_age: int | None = None
    sex: str | None = None
    date_start: str | None = None
    date_end: str | None = None
    end_inclusive: bool = False
    patient_ids: Sequence[str] | str = ()
    columns: dict[str, str] = field(default_factory=dict)

    def col(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))


def primary_condition(config: CohortConfig) -> Column | None:
    """Diagnosis or text condition; they are alternatives."""
    preds = []
    if config.diagnosis_codes:
        preds.append(P.has_code(config.col("diagnoses"), config.diagnosis_codes))
    if config.diagnosis_text.strip():
        preds.append(P.code_text_matches(config.col("diagnoses"), config.diagnosis_text))
    if P.split_terms(config.text_terms):
        preds.append(P.text_terms(config.col("report_text"), config.text_terms))
    return P.any_of(preds) if preds else None


def cohort_condition(config: CohortConfig) -> Column:
    """All restrictions together, the cheap scalar ones first."""
    col = config.col
    preds = []
    if config.modalities:
        preds.append(P.in_ci(col("modality"), config.modalities))
    if config.facilities:
        preds.append(col("sending_facility").isin(*config.facilities))
    preds.append(P.number_between(col("patient_age"), config.min_age, config.max_age))
    if config.sex and config.sex != "all":
        preds.append(col("sex") == config.sex)
    preds.append(
        P.date_between(
            col("requested_dt"), config.date_start, config.date_end, config.end_inclusive
        )
    )
    if config.patient_ids:
        preds.append(
            P.patient_in(
                config.patient_ids,
                [col(c) for c in ("resolved_epic_mrn", "resolved_mpi", "patient_id")],
            )
        )
    if P.split_terms(config.service_names, ","):
        preds.append(P.name_any(col("service_name"), config.service_names))
    primary = primary_condition(config)
    return P.all_of(preds if primary is None else [*preds, primary])


def cohort(
    df: DataFrame,
    config: CohortConfig,
    columns: Sequence[str] | None = None,
    order: Sequence[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct matching rows; ``order`` and ``limit`` make it a newest-first page."""
    found = df.filter(cohort_condition(config))
    if columns is not None:
        found = found.select(*columns)
    found = found.distinct()
    if order is not None:
        found = found.orderBy(*order)
    return found.limit(limit) if limit is not None else found


def in_ids(df: DataFrame, ids: DataFrame | Sequence[str], col: str) -> DataFrame:
    """Rows whose column is listed; a list DataFrame has its ids in ``id``."""
    if not isinstance(ids, DataFrame):
        return df.filter(F.col(col).cast("string").isin(*[str(i) for i in ids]))
    listed = ids.select(F.col("id").alias("_id")).distinct()
    return df.join(listed, F.col(col).cast("string") == F.col("_id"), "left_semi")


def any_listed(df: DataFrame, ids: DataFrame | Sequence, cols: Sequence[str | Column]) -> DataFrame:
    """Rows of which some column is listed; a list DataFrame has its ids in ``id``.

    A table of ids may have any size: each column is looked up by a join with the
    distinct ids, and no row is repeated.  NULL is not listed.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    if not isinstance(ids, DataFrame):
        return df.filter(P.any_of([F.coalesce(c.isin(*ids), F.lit(False)) for c in cols]))
    out = df
    for i, c in enumerate(cols):
        listed = ids.select(F.col("id").cast("string").alias(f"_id{i}")).filter(f"_id{i} IS NOT NULL").distinct()
        out = out.join(listed.withColumn(f"_listed{i}", F.lit(True)), c.cast("string") == F.col(f"_id{i}"), "left")
    return out.filter(P.any_of([F.col(f"_listed{i}").isNotNull() for i in range(len(cols))])).select(*df.columns)


def apply_cohort(
    spark: SparkSession, template: str, ids: DataFrame, col: str, view: str = "_cohort_ids"
) -> DataFrame:
    """Run SQL whose ``{{cohort}}`` slot becomes membership of ``col`` in the list."""
    seen = template.count(COHORT_SLOT)
    if seen != 1:
        raise ValueError(f"sql must hold {COHORT_SLOT} exactly once, found {seen}")
    if not col.replace("_", "").isalnum():
        raise ValueError(f"not a column name: {col!r}")
    ids.select(F.col("id")).createOrReplaceTempView(view)
    member = f"(CAST({col} AS STRING) IN (SELECT id FROM {view}))"
    return spark.sql(template.replace(COHORT_SLOT, member))


def query(
    spark: SparkSession,
    sql: str,
    args: dict | None = None,
    tables: dict[str, DataFrame] | None = None,
    ids: DataFrame | None = None,
    col: str = "primary_report_identifier",
) -> DataFrame:
    """Ad-hoc SQL over named tables, optionally scoped to an id list."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    if ids is not None:
        return apply_cohort(spark, sql, ids, col)
    return spark.sql(sql, args=args or {})


def unmatched(ids: DataFrame, df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """Listed ids no row carries, in list order; ``strict`` rejects a list without any match."""
    known = df.select(F.col(col).cast("string").alias("id")).distinct()
    if strict and ids.join(known, "id", "left_semi").isEmpty():
        raise ValueError(f"none of the ids match {col}")
    return ids.join(known, "id", "left_anti").orderBy("ord")


def flag_inclusion(
    df: DataFrame,
    codes: Sequence[str],
    patterns: Sequence[str],
    text: str = "report_text",
    dx: str = "diagnoses",
    **negation,
) -> DataFrame:
    """Keep every row; say whether it belongs and why.

    A diagnosis code is a strong indicator and settles the matter; otherwise the
    text must mention a pattern that is not negated.
    """
    strong = (
        F.coalesce(P.has_code(dx, codes), F.lit(False)) if codes else F.lit(False)
    )
    positive = T.positive_mention(F.col(text), patterns, **negation) if patterns else F.lit(True)
    return (
        df.withColumn("has_strong_indicator", strong)
        .withColumn(
            "has_positive_mention",
            F.when(F.col("has_strong_indicator"), F.lit(True)).otherwise(positive),
        )
        .withColumn("included_in_cohort", F.col("has_positive_mention"))
    )


def build_cohort(
    df: DataFrame, config: CohortConfig, apply_negation: bool = True, **negation
) -> DataFrame:
    """Matching rows with ``has_strong_indicator, has_positive_mention, included_in_cohort``.

    With text terms every row is tested for a mention that is not negated, unless
    ``apply_negation`` is off.  Without the test all rows belong and none is strong.
    """
    found = df.filter(cohort_condition(config))
    terms = [P.term_pattern(t) for t in P.split_terms(config.text_terms)]
    if not terms or not apply_negation:
        return found.withColumns(
            {
                "has_strong_indicator": F.lit(False),
                "has_positive_mention": F.lit(True),
                "included_in_cohort": F.lit(True),
            }
        )
    name = config.columns.get
    return flag_inclusion(
        found,
        config.diagnosis_codes,
        terms,
        name("report_text", "report_text"),
        name("diagnoses", "diagnoses"),
        **negation,
    )


def grid_filter(
    df: DataFrame,
    contains: dict[str, str] | None = None,
    members: dict[str, Sequence[str]] | None = None,
    numbers: dict[str, tuple] | None = None,
    dates: dict[str, tuple] | None = None,
) -> DataFrame:
    """Column filters of a listing.

    Substrings ignore case, ranges include both ends, a date range compares days,
    and NULL never matches a range.
    """
    preds = []
    for name, needle in (contains or {}).items():
        if needle.strip():
            preds.append(
                F.contains(
                    F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))),
                    F.lit(needle.strip().lower()),
                )
            )
    for name, wanted in (members or {}).items():
        if wanted:
            preds.append(F.col(name).cast("string").isin(*wanted))
    for name, (low, high) in (numbers or {}).items():
        if low is not None or high is not None:
            preds.append(P.number_between(F.col(name).try_cast("double"), low, high))
    for name, (low, high) in (dates or {}).items():
        preds.append(P.date_between(F.col(name), low, high, end_inclusive=True))
    return df.filter(P.all_of(preds))


def scope(
    df: DataFrame,
    dates: tuple | None = None,
    modalities: Sequence[str] = (),
    facilities: Sequence[str] = (),
    date_col: str = "message_dt",
    modality_col: str = "modality",
    facility_col: str = "sending_facility",
) -> DataFrame:
    """Filters shared by every metric of a page; the end day is included."""
    preds = []
    if dates:
        preds.append(P.date_between(F.col(date_col), *dates, end_inclusive=True))
    if modalities:
        preds.append(F.col(modality_col).isin(*modalities))
    if facilities:
        preds.append(F.col(facility_col).isin(*facilities))
    return df.filter(P.all_of(preds))


def detection_state(state: str) -> Column:
    """Named state of a classified report."""
    detected, confidence = F.col("followup_detected"), F.col("followup_confidence")
    reviewed = F.coalesce(F.col("reviewed"), F.lit(False))
    # Names of the review states.
    states = {
        "all": F.lit(True),
        "followup_yes": detected,
        "followup_no": ~detected,
        "high_conf": confidence == "high",
        "low_conf": confidence == "low",
        "high_conf_yes": detected & (confidence == "high"),
        "low_conf_yes": detected & (confidence == "low"),
        "annotated_only": reviewed,
        "unannotated_only": ~reviewed,
    }
    return states[state]


def review_filter(
    df: DataFrame,
    annotations: DataFrame,
    state: str = "all",
    key: str = "primary_report_identifier",
    modality: str | None = None,
    facility: str | None = None,
    reader: str | None = None,
    finding: str | None = None,
    last_days: int | None = None,
    as_of=None,
) -> DataFrame:
    """Classified reports a reviewer asked for; ``annotations`` holds ``key, reviewed``."""
    joined = df.join(annotations.select(key, "reviewed"), key, "left")
    preds = [detection_state(state)]
    if modality:
        preds.append(F.col("modality") == modality)
    if facility:
        preds.append(F.col("sending_facility") == facility)
    if reader:
        preds.append(F.col("principal_result_interpreter") == reader)
    if finding and finding.strip():
        preds.append(
            F.contains(F.lower(F.col("followup_finding")), F.lit(finding.strip().lower()))
        )
    if last_days is not None:
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        preds.append(F.col("message_dt") >= now - F.make_interval(days=F.lit(last_days)))
    return joined.filter(P.all_of(preds)).select(*df.columns)


def cohort_review_filter(
    df: DataFrame, annotations: DataFrame, state: str | Sequence[str], key: str = "accession_number"
) -> DataFrame:
    """Cohort rows by inclusion, evidence, review progress and decision.

    Several states must all hold.  ``annotations`` holds ``key, reviewed, included``.
    """
    joined = df.join(annotations.select(key, "reviewed", "included"), key, "left")
    reviewed = F.coalesce(F.col("reviewed"), F.lit(False))
    # Names of the review states.
    states = {
        "all": F.lit(True),
        "included": F.col("included_in_cohort"),
        "excluded": ~F.col("included_in_cohort"),
        "strong": F.col("included_in_cohort") & F.col("has_strong_indicator"),
        "text_only": F.col("included_in_cohort") & ~F.col("has_strong_indicator"),
        "reviewed": reviewed,
        "unreviewed": ~reviewed,
        "decided_in": reviewed & F.col("included"),
        "decided_out": reviewed & ~F.col("included"),
        "uncertain": reviewed & F.col("included").isNull(),
    }
    wanted = [state] if isinstance(state, str) else list(state)
    return joined.filter(P.all_of([states[s] for s in wanted])).select(*df.columns)


def read_by_ids(
    df: DataFrame,
    ids: DataFrame | Sequence[str],
    col: str,
    table: str = "reports_curated",
    columns: Sequence[str] = READ_COLUMNS,
    tables: Sequence[str] = READ_TABLES,
) -> DataFrame:
    """Full rows by id, over allow-listed tables and columns.

    The patient id exists on the patient views only.
    """
    if table not in tables:
        raise ValueError(f"table must be one of {list(tables)}, got {table!r}")
    if col not in columns:
        raise ValueError(f"id column must be one of {list(columns)}, got {col!r}")
    if col == "patient_id" and not table.endswith("_epic_view"):
        raise ValueError("patient_id lookups need a patient view")
    return in_ids(df, ids, col)


def rows(
    df: DataFrame,
    page: int | None = None,
    after: str | None = None,
    order: str = "primary_report_identifier",
    required: Sequence[str] = REQUIRED_COLUMNS,
    heavy: Sequence[str] = HEAVY_COLUMNS,
) -> DataFrame:
    """Rows without the heavy text columns: all of them, or one page in order.

    A page holds the first ``page`` rows that follow ``after`` in ``order``, a unique
    column, and says in ``more`` whether others come behind them.  The last row's
    value is the next page's ``after``.
    """
    absent = sorted(set(required) - set(df.columns))
    if absent:
        raise ValueError(f"a listing needs {', '.join(absent)}")
    lean = df.drop(*heavy)
    if after is not None:
        lean = lean.filter(F.col(order) > after)
    if page is None:
        return lean
    # One row beyond the page tells whether more follow; the windows see no others.
    top = lean.orderBy(order).limit(page + 1)
    whole = Window.partitionBy()
    counted = top.withColumns(
        {"more": F.count(F.lit(1)).over(whole) > page, "_nth": F.row_number().over(whole.orderBy(order))}
    )
    return counted.filter(F.col("_nth") <= page).drop("_nth")


def accessions(df: DataFrame, col: str = "accession_number") -> DataFrame:
    """Distinct non-NULL accession numbers, sorted."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


@dataclass
class Search:
    """A saved search: the recipe, evaluated anew on every read."""

    source: Callable[[], DataFrame]
    key: str = "primary_report_identifier"
    terms: Sequence[str] = ()
    prefixes: Sequence[str] = ()

    def count(self) -> DataFrame:
        return self.source().agg(F.count(F.lit(1)).alias("n"))

    def sample(self, n: int) -> DataFrame:
        """The first ``n`` rows by key."""
        return self.source().drop(*HEAVY_COLUMNS).orderBy(self.key).limit(n)

    def rows(self, page: int | None = None, after: str | None = None) -> DataFrame:
        return rows(self.source(), page, after, self.key)

    def accessions(self) -> DataFrame:
        return accessions(self.source())

    def evidence(self, dx: str = "diagnoses") -> DataFrame:
        """Excerpt and matching diagnoses of every row."""
        df = self.source()
        texts = [
            F.col(c)
            for c in ("report_section_impression", "report_section_findings", "report_text")
            if c in df.columns
        ]
        return df.select(
            self.key,
            T.excerpt(texts, self.terms).alias("excerpt"),
            T.matched_diagnoses(F.col(dx), self.prefixes, self.terms).alias("matched_diagnoses"),
        )
