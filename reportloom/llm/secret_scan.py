"""Secret scans with DataFrame functions only: fixed patterns, and sliding-window entropy.

Patterns give the ``assign``, ``access`` and ``hex`` spans.  Besides, every run of
token characters is a candidate for the entropy test of its narrowest character class
(hex digits, letters and digits, base64).  A window of ``WINDOW`` characters slides over
the candidate; it carries how often each character occurs and the sum of c * log2(c),
and a step changes only the counts of the character that enters and of the one that
leaves.  The entropy of a window is log2(WINDOW) - sum / WINDOW.  Windows at or above
the threshold of the class are merged into spans ``entropy_<class>``.  Candidates that
the allow-list knows (words, numbers, identifiers, placeholders) are left out, unless a
token between separators looks like a key of its own; it never suppresses a pattern's
span.  The class is that of the whole run: a hex key behind ``key_`` is judged as base64.

Positions are code points, the end is exclusive.  They come from splitting the text at
the matches and adding up lengths, so long texts cost linear time.

Defined results: a null or empty text has no spans; null ids and repeated rows are
scanned like others; other columns are carried, except that ``spans`` is replaced; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import whole_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of the class is maximal either way, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
# Character classes from narrow to wide: pattern of the whole candidate, least entropy.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "alnum": (r"^[A-Za-z0-9]+$", 3.6), "base64": (r"", 3.9)}
KINDS = ("assign", "access", "hex", *(f"entropy_{c}" for c in CLASSES))

# A token of letters in mixed case like no words': three times from small to capital, and two capitals together.
_MIXED = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[A-Z]{2})(?=[A-Z]*(?:[a-z]+[A-Z]+){3})[A-Za-z]{20,}(?![A-Za-z0-9])"
_MARKERS = r"example|sample|placeholder|dummy|changeme|your[-_]|redacted|xxxx|0123456789|abcdefghij"

# None of them hides a token, between separators, that is long enough for a key and does not fit the rule itself.
ALLOWED = (
    rf"^(?!.*{_MIXED})[^0-9]*$",  # words and paths
    r"^[^A-Za-z]*$",  # numbers, rulers
    r"^[A-Za-z]+[0-9]{1,4}$",  # a word and a year or counter
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?!.*[A-Za-z0-9]{20})",  # dates
    rf"^(?!.*{_MIXED})([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))+$",  # slugs: words and numbers, joined
    rf"(?i)^(?!(?:.*[-_/=+])?(?![A-Za-z0-9]*(?:{_MARKERS}))[A-Za-z0-9]{{20,}}).*(?:{_MARKERS})",
)

SPANS = "array<struct<start:int,kind_order:int,end:int,kind:string>>"
# From the first character a candidate may hold to the last.
_FIRST, _LAST = ord("+"), ord("z")


def _located(text: Column, pattern: str, group: int | None = None) -> Column:
    """Matches in order, as array of (start, end, value, inner); empty without a match."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(
        F.arrays_zip(pieces.alias("gap"), hits.alias("value"), inner.alias("inner")),
        lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["value"].alias("value"), p["inner"].alias("inner")),
    )
    kind = "array<struct<start:int,end:int,value:string,inner:string>>"

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.length(part["value"])
        hit = F.struct(
            start.alias("start"), end.alias("end"), part["value"].alias("value"), part["inner"].alias("inner")
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(hit)).alias("out"))

    # The last piece follows the last match and has none of its own.
    matched = F.filter(parts, lambda p: p["value"].isNotNull())
    found = F.aggregate(
        matched, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"]
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(KINDS.index(kind)).alias("kind_order"),
        end.cast("int").alias("end"),
        F.lit(kind).alias("kind"),
    )


def _weight(count: Column) -> Column:
    """c * log2(c), 0 for none."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _dense(value: Column, least: Column) -> Column:
    """Merged stretches of ``value`` whose windows reach ``least`` bits, as (start, end)."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - F.lit(_FIRST))
    stretch = "array<struct<start:int,end:int>>"
    # Each character next to the one that leaves the window as it enters.
    steps = F.zip_with(
        codes, F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), lambda new, old: F.struct(new.alias("new"), old.alias("old"))
    )
    start = F.struct(
        F.lit(0).alias("seen"),
        F.array_repeat(F.lit(0), _LAST - _FIRST + 1).alias("counts"),
        F.lit(0.0).alias("total"),
        F.array().cast(stretch).alias("out"),
    )

    def step(state: Column, s: Column) -> Column:
        counts, same = state["counts"], s["new"] == s["old"]
        entering = F.get(counts, s["new"])
        leaving = F.coalesce(F.get(counts, F.greatest(s["old"], F.lit(0))), F.lit(0))
        total = F.when(same, state["total"]).otherwise(
            state["total"]
            + _weight(entering + 1)
            - _weight(entering)
            + F.when(s["old"] >= 0, _weight(leaving - 1) - _weight(leaving)).otherwise(F.lit(0.0))
        )
        moved = F.transform(
            counts,
            lambda c, k: c + (k == s["new"]).cast("int") - (k == s["old"]).cast("int"),
        )
        seen = state["seen"] + 1
        bits = F.lit(WINDOW).cast("double")
        high = (seen >= WINDOW) & (F.log2(bits) - total / bits >= least)
        out, begin = state["out"], seen - F.lit(WINDOW)
        last = F.try_element_at(out, F.lit(-1))
        grown = F.when(
            last["end"] >= begin,
            F.concat(
                F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))),
                F.array(F.struct(last["start"].alias("start"), seen.alias("end"))),
            ),
        ).otherwise(F.concat(out, F.array(F.struct(begin.alias("start"), seen.alias("end")))))
        return F.struct(
            seen.alias("seen"),
            moved.alias("counts"),
            total.alias("total"),
            F.when(high, grown).otherwise(out).alias("out"),
        )

    # split() of a text by nothing ends with the last character
    return F.aggregate(F.filter(steps, lambda s: s["new"].isNotNull() & (s["new"] >= 0)), start, step, lambda s: s["out"])


def _entropy_spans(text: Column, allowed: Sequence[str]) -> Column:
    known = lambda c: F.lit(False)
    if allowed:
        known = lambda c: c["value"].rlike("|".join(f"(?:{a})" for a in allowed))
    candidates = F.filter(_located(text, CANDIDATE), lambda c: ~known(c))

    def of(kind: str, least: float):
        return F.transform(
            F.filter(classed, lambda c: c["kind"] == kind),
            lambda c: F.transform(
                _dense(c["value"], F.lit(least)),
                lambda s: _span(c["start"] + s["start"], c["start"] + s["end"], f"entropy_{kind}"),
            ),
        )

    def narrowest(value: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for name, (pattern, _) in reversed(CLASSES.items()):
            chosen = F.when(value.rlike(pattern), F.lit(name)).otherwise(chosen) if pattern else F.lit(name)
        return chosen

    classed = F.transform(
        candidates, lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), narrowest(c["value"]).alias("kind"))
    )
    return F.flatten(F.flatten(F.array(*(of(k, least) for k, (_, least) in CLASSES.items()))))


def secret_spans(text: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """All spans of a text, by start, then kind."""
    assign = F.transform(
        F.filter(_located(text, ASSIGN, 2), lambda m: F.length(m["inner"]) >= LEAST_VALUE),
        lambda m: _span(m["start"], m["end"], "assign"),
    )

    def plain(kind: str, pattern: str) -> Column:
        return F.transform(_located(text, pattern), lambda m: _span(m["start"], m["end"], kind))

    return F.array_sort(F.concat(assign, plain("access", ACCESS), plain("hex", HEX), _entropy_spans(text, allowed)).cast(SPANS))


def scan(docs: DataFrame, *, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind_order, end, kind)."""
    return docs.withColumn("spans", secret_spans(whole_text(text), allowed))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[secret]", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with every span of the text, overlapping ones as one, replaced by ``mark``."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in map("secret_spans_{}".format, range(len(taken) + 1)) if n not in taken)
    scanned = docs.withColumn(name, secret_spans(whole_text(text), allowed))
    body = F.col(text)

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(body, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        F.col(name),
        start,
        step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(body, s["at"] + 1, F.length(body))),
    )
    return scanned.withColumn(text, F.when(F.size(name) > 0, clean).otherwise(body)).select(docs.columns)
