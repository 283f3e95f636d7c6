"""Governed views: who may read a table, which rows, and which columns in clear.

The policy is data.  Decisions about tables are taken before a DataFrame is
returned; rows and columns are restricted by the plan itself, so Catalyst pushes
the row filter into the scan like any other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shape of an admissible attribute value, the wildcard, the mask
# and the groups that grant access.
VALUE_PATTERN = re.compile(r"^[A-Za-z0-9 _-]+$")
WILDCARD = "*"
REDACTED = "[REDACTED]"
APPROVED_GROUPS = ("user", "admin")


@dataclass(frozen=True)
class AttributeFilter:
    """Rows are limited by ``column`` to the values of a user attribute.

    ``tables`` overrides the policy's filtered tables; an entry ending in ``*``
    names a prefix.
    """

    column: str
    tables: Sequence[str] | None = None


@dataclass(frozen=True)
class Policy:
    filtered_tables: Sequence[str] = ("reports*",)
    attribute_filters: dict[str, AttributeFilter] = field(default_factory=dict)
    masked_columns: Sequence[str] = ()
    hidden_tables: Sequence[str] = (
        "reports_report_patient_mapping",
        "reports_report_patient_mapping_history",
    )
    approved_groups: Sequence[str] = APPROVED_GROUPS


@dataclass(frozen=True)
class User:
    """Attributes are lists of strings; ``service`` principals are not restricted."""

    name: str = ""
    groups: Sequence[str] = ()
    enabled: bool = True
    attributes: dict[str, Sequence[str]] = field(default_factory=dict)
    service: bool = False

    def flag(self, name: str) -> bool:
        values = list(self.attributes.get(name, ()))
        return bool(values) and values[0] == "true"


class AccessDenied(PermissionError):
    """The user may not read the table at all."""


def listed(table: str, entries: Sequence[str]) -> bool:
    return any(
        table.startswith(e[:-1]) if e.endswith("*") else table == e for e in entries
    )


def check_access(table: str, user: User, policy: Policy) -> None:
    """Raise unless the user is enabled, approved and may see the table."""
    if user.service:
        return
    if not user.enabled or not set(user.groups) & set(policy.approved_groups):
        raise AccessDenied(f"{user.name or 'user'} is disabled or not approved")
    if listed(table, policy.hidden_tables) and not user.flag("bypass_hidden_tables"):
        raise AccessDenied(f"{table} is not open to direct reads")


def row_filter(df: DataFrame, table: str, user: User, policy: Policy) -> DataFrame:
    """Rows whose columns carry the user's attribute values.

    Attributes add up with AND.  The wildcard lifts one attribute; no admissible
    value for an attribute leaves no rows.
    """
    if user.service or listed(table, policy.hidden_tables):
        return df
    for name, rule in policy.attribute_filters.items():
        scope = policy.filtered_tables if rule.tables is None else rule.tables
        values = list(user.attributes.get(name, ()))
        if not listed(table, scope) or WILDCARD in values:
            continue
        valid = [v for v in values if VALUE_PATTERN.fullmatch(v)]
        df = df.filter(F.col(rule.column).isin(*valid) if valid else F.lit(False))
    return df


def mask(df: DataFrame, user: User, masked: Sequence[str]) -> DataFrame:
    """Hide columns from users flagged for redaction: text as a marker, others as NULL."""
    if user.service or not user.flag("redact_select_identifiers"):
        return df
    hidden = {}
    for f in df.schema.fields:
        if f.name in masked:
            hidden[f.name] = (
                F.lit(REDACTED)
                if isinstance(f.dataType, T.StringType)
                else F.lit(None).cast(f.dataType)
            )
    return df.withColumns(hidden) if hidden else df


def governed(df: DataFrame, table: str, user: User, policy: Policy) -> DataFrame:
    """The table as this user may see it; raises when they may not see it."""
    check_access(table, user, policy)
    return mask(row_filter(df, table, user, policy), user, policy.masked_columns)
