"""Search predicates as column expressions.

Literals are escaped once, for the regular expression; the DataFrame API passes
them to the engine unchanged, so nothing is escaped a second time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that hint at a follow-up recommendation, and the
# modalities worth reading first.
FOLLOWUP_KEYWORDS = (
    r"follow.?up",
    r"repeat",
    r"recommend",
    r"suggest",
    r"interval",
    r"re-?evaluate",
    r"re-?assess",
    r"correlat",
    r"clinical",
    r"short.?term",
    r"further",
    r"additional",
    r"consider",
    r"refer",
    r"return",
    r"continue",
    r"monitor",
    r"surveillance",
    r"re-?exam",
    r"comparison",
)
PRIORITY_MODALITIES = ("CT", "MR", "US", "MG", "PT")

# Cues that negate a finding later in the same clause.  The bare
# "no" needs letter boundaries, the others are distinctive.
CLAUSE_NEGATIONS = (
    r"(?<![a-zA-Z])no(?![a-zA-Z])",
    r"without",
    r"negative for",
    r"absence of",
    r"(?:rules?|ruled) out",
    r"excludes?",
    r"denies?",
)


# Letters match in either case and classes such as \\s and \\b beyond ASCII, a dot any character.
FLAGS = "(?isU)"


def literal(term: str) -> str:
    """Regular expression that matches ``term`` itself."""
    return re.escape(term)


def any_of(preds: Iterable[Column]) -> Column:
    """Some predicate holds; none does in an empty list."""
    preds = list(preds)
    return reduce(or_, preds) if preds else F.lit(False)


def all_of(preds: Iterable[Column]) -> Column:
    preds = list(preds)
    return reduce(and_, preds) if preds else F.lit(True)


def has_code(dx: Column | str, codes: Sequence[str], field: str = "diagnosis_code") -> Column:
    """Some diagnosis carries one of the codes."""
    return F.exists(dx, lambda d: d[field].isin(*codes))


def code_prefix(
    dx: Column | str, prefixes: Sequence[str], field: str = "diagnosis_code"
) -> Column:
    """Some diagnosis code starts with one of the prefixes (a trailing % is ignored)."""
    stems = [p.rstrip("%") for p in prefixes]
    return F.exists(dx, lambda d: any_of([d[field].startswith(s) for s in stems]))


def code_text_matches(
    dx: Column | str, text: str, field: str = "diagnosis_code_text"
) -> Column:
    """Some diagnosis text contains ``text``, ignoring case."""
    return F.exists(dx, lambda d: d[field].rlike(FLAGS + literal(text.strip())))


def term_pattern(term: str) -> str:
    """A term holding a bounded gap ``.{`` is a pattern already; others are literal."""
    return term if ".{" in term else literal(term)


def split_terms(terms: str | Sequence[str], sep: str = "\n") -> list[str]:
    parts = terms.split(sep) if isinstance(terms, str) else terms
    return [p.strip() for p in parts if p.strip()]


def text_terms(c: Column, terms: str | Sequence[str]) -> Column:
    """Some term (one per line) occurs in the text."""
    return any_of([c.rlike(FLAGS + term_pattern(t)) for t in split_terms(terms)])


def name_any(c: Column, terms: str | Sequence[str]) -> Column:
    """Some comma-separated term occurs in the name."""
    return any_of([c.rlike(FLAGS + literal(t)) for t in split_terms(terms, ",")])


def in_ci(c: Column, values: Sequence[str]) -> Column:
    return F.lower(c).isin(*[v.lower() for v in values])


def number_between(c: Column, low=None, high=None) -> Column:
    preds = []
    if low is not None:
        preds.append(c >= low)
    if high is not None:
        preds.append(c <= high)
    return all_of(preds)


def date_between(c: Column, start=None, end=None, end_inclusive: bool = False) -> Column:
    """Timestamp range given by dates.

    A plain ``end`` cuts at its midnight; ``end_inclusive`` takes the whole day.
    """
    preds = []
    if start is not None:
        preds.append(c >= F.lit(str(start)).cast("date"))
    if end is not None:
        last = F.lit(str(end)).cast("date")
        preds.append(c < F.date_add(last, 1) if end_inclusive else c <= last)
    return all_of(preds)


def patient_in(ids: str | Sequence[str], cols: Sequence[Column]) -> Column:
    """Any of the identifier columns is listed (commas or line breaks separate ids)."""
    listed = (
        [i.strip() for i in re.split(r"[,\n]+", ids) if i.strip()]
        if isinstance(ids, str)
        else list(ids)
    )
    return any_of([c.isin(*listed) for c in cols])


def near(a: str, b: str, gap: int) -> str:
    """Pattern for two concepts within ``gap`` characters, in either order."""
    return f"(?:{a}).{{0,{gap}}}(?:{b})|(?:{b}).{{0,{gap}}}(?:{a})"


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search across lines; NULL text does not match."""
    return F.coalesce(c, F.lit("")).rlike(FLAGS + pattern)


def section_match(
    pattern: str,
    impression: Column | None = None,
    findings: Column | None = None,
    text: Column | None = None,
) -> Column:
    """Search the parsed sections; the whole text only where both are missing.

    A blank section counts as missing: parsing yields an empty string, not NULL,
    for a report without that section.
    """
    impression = F.col("report_section_impression") if impression is None else impression
    findings = F.col("report_section_findings") if findings is None else findings
    text = F.col("report_text") if text is None else text
    impression, findings = (
        F.when(F.trim(c) != "", c) for c in (impression, findings)
    )
    whole = impression.isNull() & findings.isNull() & matches(text, pattern)
    return matches(impression, pattern) | matches(findings, pattern) | whole


def negated_pattern(
    pattern: str, cues: Sequence[str] = CLAUSE_NEGATIONS, reach: int = 40
) -> str:
    return f"(?:{'|'.join(cues)})[^.;:]{{0,{reach}}}(?:{pattern})"


def unnegated(
    c: Column, pattern: str, cues: Sequence[str] = CLAUSE_NEGATIONS, reach: int = 40
) -> Column:
    """No cue precedes the finding within its clause."""
    return ~matches(c, negated_pattern(pattern, cues, reach))


def likely_followup(text: Column, modality: Column) -> Column:
    return F.lower(text).rlike("|".join(FOLLOWUP_KEYWORDS)) & modality.isin(
        *PRIORITY_MODALITIES
    )
