"""Text evidence: negation, scores, excerpts and spans as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .predicates import FLAGS, any_of, literal

# Phrases that negate a mention following within the window.
NEGATION_PHRASES = (
    r"no\s+(mri?\s+)?evidence",
    r"without\s+(mri?\s+)?evidence",
    r"negative\s+for",
    r"absence\s+of",
    r"ruled?\s+out",
    r"rules?\s+out",
    r"excluding",
    r"excluded",
    r"evaluat(?:e|ion)\s+(for)?",
    r"concern\s+(for)?",
    r"no\s+\w+\s+(suggest|indication|sign)",
    r"no\s+",
)

# Score patterns; the first group holds the score.
SCORE_PATTERNS = {
    "LIRADS": (
        r"LI-?RADS[-\s]*((?:LR-)?(?:1|2|3|4|5|M|NC|TIV|TR))",
        r"LR[-\s]*([1-5]|M|NC|TIV|TR)",
        r"LIRADS[-\s]*([1-5]|M|NC|TIV|TR)",
    ),
    "BIRADS": (
        r"BI-?RADS[-\s]*((?:Category\s*)?[0-6](?:[ABC])?)",
        r"BIRADS[-\s]*((?:Category\s*)?[0-6](?:[ABC])?)",
        r"(?:Category\s*)?([0-6](?:[ABC])?)\s*(?:BI-?RADS|BIRADS)",
    ),
    "PIRADS": (
        r"PI-?RADS[-\s]*([1-5])",
        r"PIRADS[-\s]*([1-5])",
    ),
}

# What every score pattern of a kind holds, in lower case.
SCORE_STEMS = {"LIRADS": ("rads", "lr"), "BIRADS": ("rads",), "PIRADS": ("rads",)}

# Scores from the highest risk to the lowest.
SCORE_PRIORITY = {
    "LIRADS": ("LR-M", "LR-5", "LR-TIV", "LR-4", "LR-TR", "LR-3", "LR-2", "LR-1", "LR-NC"),
    "BIRADS": (
        "BI-RADS-6",
        "BI-RADS-5",
        "BI-RADS-4C",
        "BI-RADS-4B",
        "BI-RADS-4A",
        "BI-RADS-4",
        "BI-RADS-3",
        "BI-RADS-2",
        "BI-RADS-1",
        "BI-RADS-0",
    ),
    "PIRADS": ("5", "4", "3", "2", "1"),
}

# Broad test for a report that may carry a score.
SCORE_MENTIONS = {
    "LIRADS": r"(?isU)(LI-?RADS|LR-[1-5M])",
    "BIRADS": r"(?isU)(BI-?RADS|BIRADS)",
    "PIRADS": r"(?isU)(PI-?RADS)",
}

# Phrases of the keyword follow-up rule.
FOLLOWUP_PHRASES = ("recommend follow", "follow-up", "follow up", "repeat imaging")

_WHITESPACE = " \t\n\r\f\x0b"


def checked(patterns: Sequence[str]) -> list[str]:
    """The patterns, each one that the engine can run; any other is an error here, not in a task."""
    java = SparkSession.active()._jvm.java.util.regex.Pattern
    for p in patterns:
        try:
            java.compile(FLAGS + p)
        except IllegalArgumentException as error:
            raise ValueError(f"not a usable pattern: {p!r}") from error
    return list(patterns)


def _negation(phrases: Sequence[str]) -> str:
    return FLAGS + "|".join(phrases)


def _gaps_and_hits(lowered: Column, pattern: str) -> Column:
    """Text before each hit, and the hit; the last element has no hit."""
    flagged = FLAGS + pattern
    return F.arrays_zip(
        F.split(lowered, flagged).alias("gap"),
        F.regexp_extract_all(lowered, F.lit(flagged), F.lit(0)).alias("hit"),
    )


def positive_mention(
    c: Column,
    patterns: Sequence[str],
    negations: Sequence[str] = NEGATION_PHRASES,
    window: int = 50,
) -> Column:
    """Some hit has no negation phrase in the ``window`` characters before it.

    One pass over the hits: the fold carries only the last ``window`` characters
    read so far, so its cost grows with the number of hits and not with their
    square, and a long text needs no positions.
    """
    lowered = F.lower(c)
    negation = _negation(negations)

    def step(state: Column, piece: Column) -> Column:
        before = F.right(F.concat(state["tail"], piece["gap"]), F.lit(window))
        is_hit = piece["hit"].isNotNull()
        return F.struct(
            F.right(F.concat(before, F.coalesce(piece["hit"], F.lit(""))), F.lit(window)).alias(
                "tail"
            ),
            (state["found"] | (is_hit & ~before.rlike(negation))).alias("found"),
        )

    def one(pattern: str) -> Column:
        # Most texts have no hit, which a test tells before anything is taken apart.
        found = F.aggregate(
            _gaps_and_hits(lowered, pattern),
            F.struct(F.lit("").alias("tail"), F.lit(False).alias("found")),
            step,
            lambda state: state["found"],
        )
        return F.when(lowered.rlike(FLAGS + pattern), found).otherwise(False)

    usable = checked(patterns)
    if not usable:
        return F.lit(False)
    return F.coalesce(any_of([one(p) for p in usable]), F.lit(False))


def match_spans(
    c: Column,
    patterns: Sequence[str],
    negations: Sequence[str] = NEGATION_PHRASES,
    window: int = 50,
) -> Column:
    """Non-overlapping hits as ``array<struct<start, end, negated>>``.

    Offsets are 0-based, end exclusive.  Where hits overlap the earliest start
    wins, then the longer one.
    """
    lowered = F.lower(c)
    negation = _negation(negations)
    span_type = "array<struct<start:int,end:int,negated:boolean>>"

    def step(state: Column, piece: Column) -> Column:
        before = F.right(F.concat(state["tail"], piece["gap"]), F.lit(window))
        hit = F.coalesce(piece["hit"], F.lit(""))
        start = state["pos"] + F.length(piece["gap"])
        end = start + F.length(hit)
        span = F.array(
            F.struct(
                start.alias("start"), end.alias("end"), before.rlike(negation).alias("negated")
            )
        )
        return F.struct(
            F.right(F.concat(before, hit), F.lit(window)).alias("tail"),
            end.alias("pos"),
            F.when(F.length(hit) > 0, F.concat(state["spans"], span))
            .otherwise(state["spans"])
            .cast(span_type)
            .alias("spans"),
        )

    def one(pattern: str) -> Column:
        found = F.aggregate(
            _gaps_and_hits(lowered, pattern),
            F.struct(
                F.lit("").alias("tail"),
                F.lit(0).alias("pos"),
                F.array().cast(span_type).alias("spans"),
            ),
            step,
            lambda state: state["spans"],
        )
        searched = lowered.isNull() | lowered.rlike(FLAGS + pattern)
        return F.when(searched, found).otherwise(F.array().cast(span_type))

    usable = checked(patterns)
    if not usable:
        return F.array().cast(span_type)
    found = F.concat(*[one(p) for p in usable]) if len(usable) > 1 else one(usable[0])
    ordered = F.transform(
        F.array_sort(
            F.transform(
                found,
                lambda s: F.struct(
                    s["start"].alias("start"),
                    (-s["end"]).alias("neg_end"),
                    s["negated"].alias("negated"),
                ),
            )
        ),
        lambda s: F.struct(
            s["start"].alias("start"), (-s["neg_end"]).alias("end"), s["negated"].alias("negated")
        ),
    )
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("edge"), F.array().cast(span_type).alias("kept")),
        lambda state, s: F.when(
            s["start"] >= state["edge"],
            F.struct(
                s["end"].alias("edge"),
                F.concat(state["kept"], F.array(s)).cast(span_type).alias("kept"),
            ),
        ).otherwise(state),
        lambda state: state["kept"],
    )


def extract_scores(c: Column, kind: str) -> Column:
    """Distinct normalised scores, by pattern and then by position."""

    def normalise(score: Column) -> Column:
        score = F.upper(score)
        if kind == "LIRADS":
            return F.when(score.startswith("LR-"), score).otherwise(F.concat(F.lit("LR-"), score))
        if kind == "BIRADS":
            bare = F.regexp_replace(score, r"(?U)CATEGORY\s*", "")
            return F.when(bare.startswith("BI-RADS-"), bare).otherwise(
                F.concat(F.lit("BI-RADS-"), bare)
            )
        return score

    found = F.concat(
        *[
            F.regexp_extract_all(c, F.lit("(?iU)" + p), F.lit(1))
            for p in SCORE_PATTERNS[kind]
        ]
    )
    # Every pattern holds one of these; a text without them is not searched.  The long s is an s in either case.
    plain = F.replace(F.lower(c), F.lit("ſ"), F.lit("s"))
    possible = any_of([F.contains(plain, F.lit(stem)) for stem in SCORE_STEMS[kind]])
    none = F.array().cast("array<string>")
    return F.when(possible, F.array_distinct(F.transform(found, normalise))).otherwise(none)


def primary_score(scores: Column, kind: str) -> Column:
    """Highest-risk score of an extracted list; NULL for an empty one.

    The list is bound to a lambda variable, so an extraction passed in is not
    evaluated once per candidate.
    """
    ranked = F.array(*[F.lit(s) for s in SCORE_PRIORITY[kind]])

    def best(found: Column) -> Column:
        present = F.filter(ranked, lambda s: F.array_contains(found, s))
        return F.coalesce(F.get(present, F.lit(0)), F.get(found, F.lit(0)))

    return F.get(F.transform(F.array(scores), best), F.lit(0))


def mentions_score(c: Column, kind: str) -> Column:
    return c.rlike(SCORE_MENTIONS[kind])


def word_pattern(terms: Sequence[str]) -> str | None:
    """Whole-word alternation of literal terms."""
    atoms = [literal(t.strip()) for t in terms if t and t.strip()]
    return r"(?isU)\b(?:" + "|".join(atoms) + r")\b" if atoms else None


def excerpt(cols: Sequence[Column], terms: Sequence[str], window: int = 80) -> Column:
    """Surroundings of the first hit in the first column that has one."""
    pattern = word_pattern(terms)
    if pattern is None:
        return F.lit(None).cast("string")

    def around(text: Column) -> Column:
        start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
        end = start + F.length(F.regexp_extract(text, pattern, 0))
        low = F.greatest(F.lit(0), start - F.lit(window))
        high = F.least(F.length(text), end + F.lit(window))
        body = F.btrim(
            F.replace(F.substr(text, low + F.lit(1), high - low), F.lit("\n"), F.lit(" ")),
            F.lit(_WHITESPACE),
        )
        shown = F.concat(
            F.when(low > 0, F.lit("…")).otherwise(F.lit("")),
            body,
            F.when(high < F.length(text), F.lit("…")).otherwise(F.lit("")),
        )
        return F.when(text.rlike(pattern), shown)

    return F.coalesce(*[around(c) for c in cols])


def matched_diagnoses(
    dx: Column,
    prefixes: Sequence[str] = (),
    terms: Sequence[str] = (),
    code: str = "diagnosis_code",
    text: str = "diagnosis_code_text",
) -> Column:
    """Diagnoses named by a code prefix or by a term in "code text"."""
    stems = [p.strip().rstrip("%").lower() for p in prefixes if p and p.strip()]
    pattern = word_pattern(terms)

    def wanted(d: Column) -> Column:
        tests = [F.lower(d[code]).startswith(s) for s in stems]
        if pattern is not None:
            tests.append(
                F.concat_ws(" ", d[code], F.coalesce(d[text], F.lit(""))).rlike(pattern)
            )
        return (d[code] != "") & any_of(tests) if tests else F.lit(False)

    return F.transform(
        F.filter(dx, wanted),
        lambda d: F.struct(
            d[code].alias("code"), F.coalesce(d[text], F.lit("")).alias("text")
        ),
    )


def _folded(c: Column) -> Column:
    """Lower case of the same length: the one letter that grows is replaced first."""
    return F.replace(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))), F.lit("ς"), F.lit("σ"))


_GAP = r"(?U)\s+"
# The characters that pattern takes for white space.
_UNICODE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _spaced(c: Column) -> Column:
    """The words joined by single spaces."""
    return F.btrim(F.regexp_replace(c, _GAP, " "), F.lit(" "))


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def locate_snippet(c: Column, snippet: Column) -> Column:
    """Where a snippet lies in the text, whatever the case and the white space between words.

    ``struct<start, end>`` with 0-based offsets, end exclusive; NULL when the
    snippet is shorter than five characters or absent.  Both are joined by single
    spaces and compared.  Where no gap of the text is wider than a character, places are
    the same but for the white space in front.  Else the words before a place are counted
    by the spaces, and the text that follows as many words tells the place: a few passes
    over the text, however many words it has.
    """
    spaces = F.lit(_UNICODE_SPACE)

    def place(f: Column, at: Column) -> Column:
        before = F.substr(f["flat"], F.lit(1), at)

        def after(before: Column) -> Column:
            words = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
            rest = F.element_at(F.split(c, _GAP, words + F.least(f["lead"], F.lit(1)) + 1), -1)
            return F.length(c) - F.length(rest) + F.length(F.substring_index(before, " ", -1))

        return F.when(f["plain"], f["lead"] + at).otherwise(_bound(before, after))

    def searched(raw: Column) -> Column:
        wanted = F.when(F.length(F.btrim(raw, spaces)) >= 5, _folded(_spaced(raw)))
        return F.struct(_folded(_spaced(c)).alias("flat"), wanted.alias("wanted"))

    def found(both: Column) -> Column:
        return F.struct(
            both["flat"].alias("flat"),
            (F.position(both["wanted"], both["flat"]) - 1).alias("first"),
            F.length(both["wanted"]).alias("size"),
            (F.length(c) - F.length(F.ltrim(c, spaces))).alias("lead"),
            (F.length(F.btrim(c, spaces)) == F.length(both["flat"])).alias("plain"),
        )

    def mapped(f: Column) -> Column:
        last = f["first"] + f["size"] - 1
        span = F.struct(place(f, f["first"]).alias("start"), (place(f, last) + 1).alias("end"))
        return F.when(f["first"] >= 0, span)

    return _bound(_bound(_bound(snippet, searched), found), mapped)


def finding_category(c: Column) -> Column:
    """Text before the first colon, or all of it."""
    return F.trim(F.substring_index(c, ":", 1))


def finding_detail(c: Column) -> Column:
    """Text after the first colon; NULL without one."""
    at = F.locate(":", c)
    return F.when(at > 0, F.trim(F.substr(c, at + F.lit(1))))


def finding_parts(c: Column) -> Column:
    """``struct<category, detail>`` of a finding."""
    return F.struct(finding_category(c).alias("category"), finding_detail(c).alias("detail"))


def keyword_followup(c: Column) -> Column:
    """Keyword rule: some follow-up phrase occurs; NULL text does not."""
    return F.coalesce(
        any_of([F.contains(F.lower(c), F.lit(p)) for p in FOLLOWUP_PHRASES]), F.lit(False)
    )
