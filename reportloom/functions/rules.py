"""Curation rules as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plausibility limits for patients.
OLDEST_BIRTH_DATE = "1905-01-01"
HIGHEST_AGE = 109


@dataclass(frozen=True)
class IdRules:
    """Which identifier columns name a patient, per message version.

    ``default`` columns serve every version that is not listed.
    """

    primary: tuple[tuple[str, tuple[str, ...]], ...]
    mpi: tuple[tuple[str, tuple[str, ...]], ...]
    epic: tuple[tuple[str, tuple[str, ...]], ...]
    default_primary: tuple[str, ...] = ("mpi",)
    default_mpi: tuple[str, ...] = ("mpi",)
    default_epic: tuple[str, ...] = ()


# Identifier columns per message version, first non-NULL wins.
DEFAULT_RULES = IdRules(
    primary=(
        ("2.7", ("epic_mrn", "mbmc_mr", "empi_mr")),
        ("2.4", ("bjh_mr", "bjwc_mr", "slch_mr")),
    ),
    mpi=(
        ("2.7", ("empi_mr",)),
        ("2.4", ("bjh_ee", "bjwc_ee", "slch_ee")),
    ),
    epic=(("2.7", ("epic_mrn", "mbmc_mr")),),
)


def first_non_empty(a: Column, b: Column) -> Column:
    """``a`` unless it is NULL or the empty string; blanks count as content."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def anticipated(df: DataFrame, name: str) -> Column:
    """The column, or NULL where this table has not seen it yet."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def by_version(
    df: DataFrame,
    version: str,
    cases: tuple[tuple[str, tuple[str, ...]], ...],
    default: tuple[str, ...],
    labelled: bool = False,
) -> Column:
    """First non-NULL identifier among the columns of the row's version."""

    def first(names: tuple[str, ...]) -> Column:
        values = [
            F.concat(F.lit(f"{n}_"), anticipated(df, n)) if labelled else anticipated(df, n)
            for n in names
        ]
        return F.coalesce(*values) if values else F.lit(None).cast("string")

    chosen = None
    for value, names in cases:
        condition = F.col(version) == F.lit(value)
        chosen = (
            F.when(condition, first(names))
            if chosen is None
            else chosen.when(condition, first(names))
        )
    return first(default) if chosen is None else chosen.otherwise(first(default))


def primary_patient_id(
    df: DataFrame, version: str = "version_id", rules: IdRules = DEFAULT_RULES
) -> Column:
    """Patient identifier prefixed with the column it came from."""
    return by_version(df, version, rules.primary, rules.default_primary, labelled=True)


def patient_mpi(
    df: DataFrame, version: str = "version_id", rules: IdRules = DEFAULT_RULES
) -> Column:
    return by_version(df, version, rules.mpi, rules.default_mpi)


def patient_epic(
    df: DataFrame, version: str = "version_id", rules: IdRules = DEFAULT_RULES
) -> Column:
    return by_version(df, version, rules.epic, rules.default_epic)


def exam_date(observed: Column, requested: Column) -> Column:
    return F.coalesce(observed, requested)


def sane_birth_date(c: Column, floor: str = OLDEST_BIRTH_DATE) -> Column:
    """The date when it lies strictly after ``floor``."""
    return F.when(c > F.lit(floor).cast("date"), c)


def age_years(birth: Column, at: Column) -> Column:
    """Complete years between the two instants."""
    return F.timestamp_diff("YEAR", birth.cast("timestamp"), at.cast("timestamp")).cast("int")


def has_text(c: Column) -> Column:
    """Neither NULL nor blank (never NULL itself)."""
    return F.coalesce(F.trim(c) != "", F.lit(False))
