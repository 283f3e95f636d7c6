"""Cohort search, text evidence and classification over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import cohort as K
from ..operators import dictionary, evidence, scores
from ..operators.textindex import TextIndex
from ..session import scratch_path
from ..sources.lists import clean_ids
from .registry import query
from .shapes import DOCS, EXAMS, diagnosis_array, doc_reports, exams, part_reports

PART_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PARTS = "lineitem JOIN part ON l_partkey = p_partkey"


def flagged(t, pred):
    return part_reports(t).filter(pred).select(*PART_KEYS)


@query(
    "F1_has_code",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {PARTS}
       WHERE p_brand IN ('Brand#1', 'Brand#7') OR p_type || '-' || p_size IN ('Brand#1', 'SMALL-7')""",
)
def _(t):
    return flagged(t, P.has_code("diagnoses", ["Brand#1", "Brand#7", "SMALL-7"]))


@query(
    "F2_code_text_matches",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {PARTS}
       WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')""",
)
def _(t):
    return flagged(t, P.code_text_matches("diagnoses", " RED "))


@query(
    "F3_code_prefix",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {PARTS}
       WHERE p_brand LIKE 'Brand#1%' OR p_type || '-' || p_size LIKE 'SMALL-4%' OR p_brand LIKE 'SMALL-4%'""",
)
def _(t):
    return flagged(t, P.code_prefix("diagnoses", ["Brand#1%", "SMALL-4"]))


@query(
    "F4_text_terms",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?is)the.{0,20}license')
       OR contains(lower(text), 'c++') OR contains(lower(text), 'data')""",
)
def _(t):
    return t.documents.filter(P.text_terms(F.col("text"), "the.{0,20}license\n c++ \n\nData")).select("doc_id")


def text_index(t):
    return TextIndex.build(t.documents, scratch_path(t.spark, "text-index"), key="doc_id", text="text")


# A literal, alternatives with a gap, and two terms of which one requires no trigram.
INDEXED = {
    "literal": ["Apache License"],
    "gap": [P.near("released", "mit|apache", 40)],
    "scan": [r"\d\d@", "data"],
    "none": ["no text holds this"],
}


@query(
    "F4_text_index",
    """SELECT 'literal' AS search, doc_id FROM documents WHERE contains(lower(text), 'apache license')
       UNION ALL SELECT 'gap', doc_id FROM documents WHERE regexp_matches(text, '(?is)released.{0,40}(mit|apache)')
         OR regexp_matches(text, '(?is)(mit|apache).{0,40}released')
       UNION ALL SELECT 'scan', doc_id FROM documents WHERE regexp_matches(text, '[0-9][0-9]@') OR contains(lower(text), 'data')""",
)
def _(t):
    index = text_index(t)
    found = [index.search(t.documents, p).select(F.lit(n).alias("search"), "doc_id") for n, p in INDEXED.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(
    "F4_text_index_share",
    """WITH d AS (SELECT lower(coalesce(text, '')) AS s FROM documents),
       g AS (SELECT s, p, list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)) AS grams
         FROM d, (VALUES ('apache license'), ('no text holds this')) v(p))
       SELECT p AS pattern, count(*) AS n_texts,
         count(*) FILTER (WHERE len(list_filter(grams, lambda x: contains(s, x))) = len(grams)) AS n_read FROM g GROUP BY p""",
)
def _(t):
    index = text_index(t)
    found = [index.share_read([p]).withColumn("pattern", F.lit(p.lower())) for p in ("Apache License", "no text holds this")]
    return found[0].unionByName(found[1])


COHORT_SQL = f"""WITH {EXAMS} SELECT DISTINCT patient_id, modality, sending_facility, sex FROM exams
  WHERE (starts_with(modality, '1') OR regexp_matches(service_name, '(?is)house'))
  AND lower(modality) IN ('1-urgent', '5-low', '3-medium') AND sending_facility <> 'NATION_3'
  AND patient_age >= 20 AND patient_age <= 60 AND sex = 'F'"""


@query("F5_any_all", COHORT_SQL)
def _(t):
    either = P.any_of([F.col("modality").startswith("1"), P.text_terms(F.col("service_name"), "house")])
    rest = [
        P.in_ci(F.col("modality"), ["1-URGENT", "5-low", "3-Medium"]),
        F.col("sending_facility") != "NATION_3",
        P.number_between(F.col("patient_age"), 20, 60),
        F.col("sex") == "F",
    ]
    found = exams(t).filter(P.all_of([either, *rest]))
    return found.select("patient_id", "modality", "sending_facility", "sex").distinct()


@query(
    "F6_scalar_filters",
    f"""WITH {EXAMS} SELECT primary_report_identifier, true AS end_inclusive FROM exams
       WHERE lower(modality) IN ('1-urgent') AND requested_dt >= DATE '1996-01-01' AND requested_dt < DATE '1997-01-01'
       UNION ALL SELECT primary_report_identifier, false FROM exams WHERE lower(modality) IN ('1-urgent')
       AND requested_dt + INTERVAL 1 HOUR >= DATE '1996-01-01' AND requested_dt + INTERVAL 1 HOUR <= DATE '1996-12-31'""",
)
def _(t):
    e = exams(t).filter(P.in_ci(F.col("modality"), ["1-Urgent"]))
    whole = e.filter(P.date_between(F.col("requested_dt"), "1996-01-01", "1996-12-31", end_inclusive=True))
    later = F.col("requested_dt") + F.expr("INTERVAL 1 HOUR")
    cut = e.filter(P.date_between(later, "1996-01-01", "1996-12-31"))
    return whole.select("primary_report_identifier", F.lit(True).alias("end_inclusive")).unionByName(
        cut.select("primary_report_identifier", F.lit(False).alias("end_inclusive"))
    )


@query(
    "F7_name_any",
    f"""WITH {EXAMS} SELECT primary_report_identifier FROM exams
       WHERE contains(lower(service_name), 'urgent house') OR contains(lower(service_name), 'low mach')""",
)
def _(t):
    return exams(t).filter(P.name_any(F.col("service_name"), "urgent HOUSE, low mach,")).select(
        "primary_report_identifier"
    )


@query(
    "F8_patient_in",
    f"""WITH {EXAMS} SELECT primary_report_identifier FROM exams
       WHERE epic_mrn IN ('E1', 'M2', '3', '96') OR mpi IN ('E1', 'M2', '3', '96')
       OR CAST(patient_id AS VARCHAR) IN ('E1', 'M2', '3', '96')""",
)
def _(t):
    pred = P.patient_in("E1, M2\n3\n\n96", [F.col("epic_mrn"), F.col("mpi"), F.col("patient_id").cast("string")])
    return exams(t).filter(pred).select("primary_report_identifier")


@query(
    "F8_patient_table",
    f"""WITH {EXAMS}, ids AS (SELECT CAST(s_suppkey * 3 AS VARCHAR) AS id FROM supplier
         UNION ALL SELECT 'E' || s_suppkey FROM supplier UNION ALL SELECT 'E' || s_suppkey FROM supplier)
       SELECT primary_report_identifier FROM exams
       WHERE epic_mrn IN (SELECT id FROM ids) OR CAST(patient_id AS VARCHAR) IN (SELECT id FROM ids)""",
)
def _(t):
    numbers = t.supplier.select((F.col("s_suppkey") * 3).cast("string").alias("id"))
    named = t.supplier.select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("id"))
    ids = numbers.union(named).union(named)
    return K.any_listed(exams(t), ids, ["epic_mrn", "patient_id"]).select("primary_report_identifier")


@query(
    "F9_cohort",
    f"""WITH {EXAMS} SELECT DISTINCT accession_number, modality, requested_dt FROM exams
       WHERE (contains(lower(service_name), 'house') OR contains(lower(service_name), 'low'))
       AND lower(modality) IN ('1-urgent', '5-low') AND sending_facility IN ('NATION_1', 'NATION_5', 'NATION_9')
       AND patient_age <= 80 AND requested_dt >= DATE '1996-01-01'
       ORDER BY requested_dt DESC, accession_number LIMIT 100""",
)
def _(t):
    config = K.CohortConfig(
        text_terms="house\nlow",
        modalities=["1-urgent", "5-LOW"],
        facilities=["NATION_1", "NATION_5", "NATION_9"],
        max_age=80,
        date_start="1996-01-01",
        columns={"report_text": "service_name"},
    )
    return K.cohort(
        exams(t),
        config,
        ["accession_number", "modality", "requested_dt"],
        [F.desc("requested_dt"), F.col("accession_number")],
        100,
    )


def buyer_ids(t):
    """Suppliers' numbers as an uploaded list of customer ids, some unknown."""
    raw = t.supplier.select((F.col("s_suppkey") * 40).cast("string").alias("c0"))
    return clean_ids(raw, "c0")


@query(
    "F10_in_ids",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT s_suppkey * 40 FROM supplier)""",
)
def _(t):
    return K.in_ids(t.orders, buyer_ids(t), "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "F11_apply_cohort",
    """SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT s_suppkey * 40 FROM supplier)
       AND o_orderstatus = 'F' GROUP BY 1""",
)
def _(t):
    t.orders.createOrReplaceTempView("reports_latest")
    sql = "SELECT o_custkey, count(*) AS n FROM reports_latest WHERE {{cohort}} AND o_orderstatus = 'F' GROUP BY 1"
    return K.apply_cohort(t.spark, sql, buyer_ids(t), "o_custkey")


@query(
    "F12_unmatched",
    """SELECT CAST(s_suppkey * 40 AS VARCHAR) AS id FROM supplier
       WHERE s_suppkey * 40 NOT IN (SELECT o_custkey FROM orders)""",
)
def _(t):
    # Some suppliers' numbers are certain to be no customer's.
    ids = buyer_ids(t)
    return K.unmatched(ids, t.orders, "o_custkey", strict=True).select("id")


def duck_mentions(pattern: str, negation: str) -> str:
    """Positive mention by positions: the context of each hit, rebuilt from the split text."""
    return f"""list_bool_or([NOT regexp_matches(right(array_to_string(
        [s[j] || h[j] for j in range(1, k)], '') || s[k], 50), '{negation}')
        for k in range(1, len(h) + 1)])"""


PIECES = """pieces AS (SELECT doc_id, lang, string_split_regex(lower(text), '(?is){p}') AS s,
  regexp_extract_all(lower(text), '(?is){p}') AS h FROM documents)"""
NEG = "(?i)" + "|".join(p for p in T.NEGATION_PHRASES if "\\w" not in p)
MENTION = r"licen[sc]e|\bdata\b|ich thon|ion onth"


@query(
    "F13_positive_mention",
    f"""WITH {PIECES.format(p=MENTION)} SELECT doc_id, coalesce({duck_mentions(MENTION, NEG)}, false) AS positive
       FROM pieces""",
)
def _(t):
    return t.documents.select("doc_id", T.positive_mention(F.col("text"), [MENTION]).alias("positive"))


@query(
    "F13_dense_mentions",
    r"""SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '(?s)\bthe\b')) >
       len(regexp_extract_all(lower(text), '(?s)\bof\s+the\b')), false) AS positive FROM documents""",
)
def _(t):
    # A word that occurs thousands of times in a long text, negated by the word before it.
    return t.documents.select(
        "doc_id",
        T.positive_mention(F.col("text"), [r"\bthe\b"], [r"\bof\s+$"]).alias("positive"),
    )


# Terms that occur, also inside of words; the query adds two thousand that do not.
TERMS = ["License", "data", "of the", "thion", "ion onth", "c++"]
TERM_LITERALS = ["license", "data", "of the", "thion", "ion onth", r"c\\+\\+"]


@query(
    "F13_dictionary_positive",
    " UNION ALL ".join(
        f"""SELECT doc_id, '{term}' AS term FROM (WITH {PIECES.format(p=literal)}
          SELECT doc_id, {duck_mentions(literal, NEG)} AS positive FROM pieces) WHERE positive"""
        for term, literal in zip(TERMS, TERM_LITERALS)
    ),
)
def _(t):
    listed = [*TERMS, " DATA ", "", *(f"no such term {i}" for i in range(2000))]
    found = dictionary.with_positive(t.documents.select("doc_id", "text"), listed, "text")
    return found.select("doc_id", F.explode("positive").alias("i")).select(
        "doc_id", F.get(F.array(*[F.lit(x) for x in TERMS]), F.col("i")).alias("term")
    )


@query(
    "F14_flag_inclusion",
    f"""WITH {PIECES.format(p=MENTION)}, f AS (SELECT doc_id, lang = 'de' AS has_strong_indicator,
         coalesce({duck_mentions(MENTION, NEG)}, false) AS positive FROM pieces)
       SELECT doc_id, has_strong_indicator, has_strong_indicator OR positive AS has_positive_mention,
         has_strong_indicator OR positive AS included_in_cohort FROM f""",
)
def _(t):
    docs = t.documents.withColumn("diagnoses", diagnosis_array((F.col("lang"), F.col("source"))))
    return K.flag_inclusion(docs, ["de"], [MENTION], "text").select(
        "doc_id", "has_strong_indicator", "has_positive_mention", "included_in_cohort"
    )


@query(
    "F15_unnegated",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?is)license') AND NOT regexp_matches(text,
       '(?is)(?:(?:^|[^a-zA-Z])no[^a-zA-Z]|without|negative for|absence of|(?:rules?|ruled) out|excludes?|denies?)[^.;:]{0,39}license')
       AND NOT regexp_matches(text, '(?is)(?:without|negative for|absence of|(?:rules?|ruled) out|excludes?|denies?)[^.;:]{40}license')""",
)
def _(t):
    text = F.col("text")
    return t.documents.filter(P.matches(text, "license") & P.unnegated(text, "license")).select("doc_id")


@query(
    "F16_section_match",
    """SELECT doc_id FROM documents WHERE regexp_matches(CASE WHEN lang IN ('en', 'de') THEN source ELSE text END,
       '(?is)src1|tion la')""",
)
def _(t):
    en, de = F.col("lang") == "en", F.col("lang") == "de"
    found = P.section_match(
        "src1|tion la",
        impression=F.when(en, F.col("source")).when(~de, F.lit("  ")),
        findings=F.when(de, F.col("source")),
        text=F.col("text"),
    )
    return t.documents.filter(found).select("doc_id")


@query(
    "F17_near",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?is)the.{0,15}thousand')
       OR regexp_matches(text, '(?is)thousand.{0,15}the') OR regexp_matches(text, '(?is)data.{0,15}the')
       OR regexp_matches(text, '(?is)the.{0,15}data')""",
)
def _(t):
    return t.documents.filter(P.matches(F.col("text"), P.near("the", "thousand|data", 15))).select("doc_id")


@query(
    "F18_grid_filter",
    f"""WITH {EXAMS} SELECT primary_report_identifier FROM exams WHERE contains(lower(service_name), 'med')
       AND sex IN ('F') AND patient_age BETWEEN 10 AND 90
       AND CAST(requested_dt AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1999-06-30'""",
)
def _(t):
    return K.grid_filter(
        exams(t),
        contains={"service_name": " MED ", "epic_mrn": ""},
        members={"sex": ["F"]},
        numbers={"patient_age": (10, 90)},
        dates={"requested_dt": ("1997-02-01", "1999-06-30")},
    ).select("primary_report_identifier")


@query(
    "F19_review_filter",
    f"""WITH {DOCS} SELECT d.primary_report_identifier FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE NOT coalesce(l.quality = 1, false) AND modality = 'CT' AND contains(lower(followup_finding), 'stable')
       AND message_dt >= TIMESTAMP '2024-01-01 02:00:00'""",
)
def _(t):
    seen = t.labels.select(
        F.col("doc_id").cast("string").alias("primary_report_identifier"), (F.col("quality") == 1).alias("reviewed")
    )
    return K.review_filter(
        doc_reports(t), seen, "unannotated_only", modality="CT", finding="Stable",
        last_days=10, as_of="2024-01-11 02:00:00",
    ).select("primary_report_identifier")


@query(
    "F20_read_by_ids",
    f"""WITH {EXAMS} SELECT primary_report_identifier, accession_number, modality FROM exams
       WHERE patient_id IN (SELECT s_suppkey * 40 FROM supplier)""",
)
def _(t):
    found = K.read_by_ids(exams(t), buyer_ids(t), "patient_id", "reports_latest_epic_view")
    return found.select("primary_report_identifier", "accession_number", "modality")


@query(
    "F21_rows",
    f"""WITH {EXAMS}, all_rows AS (SELECT primary_report_identifier, accession_number, NULL AS more FROM exams),
       page AS (SELECT primary_report_identifier, accession_number, (SELECT count(*) > 500 FROM exams
         WHERE primary_report_identifier > '1') AS more FROM exams WHERE primary_report_identifier > '1'
         ORDER BY primary_report_identifier LIMIT 500)
       SELECT 'all' AS part, primary_report_identifier, accession_number, CAST(more AS BOOLEAN) AS more FROM all_rows
       UNION ALL SELECT 'page', primary_report_identifier, accession_number, more FROM page""",
)
def _(t):
    df = exams(t).select("primary_report_identifier", "accession_number").withColumn("report_text", F.lit("x"))
    whole = K.rows(df).select(F.lit("all").alias("part"), "*", F.lit(None).cast("boolean").alias("more"))
    page = K.rows(df, page=500, after="1")
    return whole.unionByName(page.select(F.lit("page").alias("part"), "*"))


@query(
    "F22_accessions",
    "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS accession_number FROM lineitem WHERE l_returnflag = 'R'",
)
def _(t):
    return K.accessions(
        t.lineitem.select(
            F.when(F.col("l_returnflag") == "R", F.col("l_orderkey").cast("string")).alias("accession_number")
        )
    )


FOLLOW = "|".join(P.FOLLOWUP_KEYWORDS)


@query(
    "F23_likely_followup",
    f"""WITH {DOCS} SELECT doc_id FROM docs WHERE regexp_matches(lower(report_text || followup_finding), '{FOLLOW}')
       AND modality IN ('CT', 'MR', 'US', 'MG', 'PT')""",
)
def _(t):
    text = F.concat("report_text", "followup_finding")
    return doc_reports(t).filter(P.likely_followup(text, F.col("modality"))).select("doc_id")


@query(
    "F24_scope",
    f"""WITH {EXAMS} SELECT sending_facility, count(*) AS n, count(DISTINCT patient_id) AS patients FROM exams
       WHERE requested_dt >= DATE '1996-03-01' AND requested_dt < DATE '1999-01-01'
       AND modality IN ('1-URGENT', '2-HIGH') GROUP BY 1""",
)
def _(t):
    page = K.scope(exams(t), ("1996-03-01", "1998-12-31"), ["1-URGENT", "2-HIGH"], date_col="requested_dt")
    return page.groupBy("sending_facility").agg(
        F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients")
    )


@query(
    "F25_ad_hoc_sql",
    f"""WITH {EXAMS} SELECT modality, count(*) AS n, CAST(max(patient_age) AS INTEGER) AS oldest FROM exams
       WHERE sending_facility = 'NATION_4' GROUP BY 1""",
)
def _(t):
    return K.query(
        t.spark,
        "SELECT modality, count(*) AS n, max(patient_age) AS oldest FROM reports_latest "
        "WHERE sending_facility = :facility GROUP BY 1",
        {"facility": "NATION_4"},
        {"reports_latest": exams(t)},
    )


REVIEWED = f"""{EXAMS}, f AS (
  SELECT *, modality = '1-URGENT' AS strong, modality = '1-URGENT' OR race = 'BUILDING' AS included_in_cohort,
    report_status <> 'P' AS reviewed, CASE sex WHEN 'F' THEN patient_age > 50 END AS decision FROM exams)"""


def cohort_rows(t):
    strong = F.col("modality") == "1-URGENT"
    return exams(t).withColumns(
        {"has_strong_indicator": strong, "included_in_cohort": strong | (F.col("race") == "BUILDING")}
    )


def decisions(t):
    e = exams(t)
    return e.select(
        "accession_number",
        (F.col("report_status") != "P").alias("reviewed"),
        F.when(F.col("sex") == "F", F.col("patient_age") > 50).alias("included"),
    )


@query(
    "F26_cohort_review_filter",
    f"""WITH {REVIEWED}
       SELECT 'excluded' AS state, count(*) AS n FROM f WHERE NOT included_in_cohort
       UNION ALL SELECT 'text_only', count(*) FROM f WHERE included_in_cohort AND NOT strong
       UNION ALL SELECT 'unreviewed', count(*) FROM f WHERE NOT reviewed
       UNION ALL SELECT 'decided_in', count(*) FROM f WHERE reviewed AND decision
       UNION ALL SELECT 'uncertain', count(*) FROM f WHERE reviewed AND decision IS NULL""",
)
def _(t):
    out = None
    for state in ("excluded", "text_only", "unreviewed", "decided_in", "uncertain"):
        part = K.cohort_review_filter(cohort_rows(t), decisions(t), state).agg(F.count("*").alias("n"))
        part = part.select(F.lit(state).alias("state"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def scored(t):
    """Documents with a sentence of scores appended to the whole text."""
    n = F.col("doc_id") % 7
    tail = F.concat(
        F.lit("\nIMPRESSION: LI-RADS "),
        F.element_at(F.array(*[F.lit(v) for v in ("5", "lr-4", "LR-M", "TIV", "3", "NC", "TR")]), (n + 1).cast("int")),
        F.lit(". Also LR-"),
        (n % 5 + 1).cast("string"),
        F.lit(" and Category 4b BI-RADS; BIRADS category "),
        (n % 4).cast("string"),
        F.lit("A, pirads "),
        (n % 5 + 1).cast("string"),
    )
    return t.documents.select("doc_id", "source", F.concat("text", tail).alias("text"))


SCORED = """scored AS (
  SELECT doc_id, source, doc_id % 7 AS n, text || chr(10) || 'IMPRESSION: LI-RADS ' ||
    ['5', 'lr-4', 'LR-M', 'TIV', '3', 'NC', 'TR'][doc_id % 7 + 1] || '. Also LR-' || (doc_id % 7 % 5 + 1) ||
    ' and Category 4b BI-RADS; BIRADS category ' || (doc_id % 7 % 4) || 'A, pirads ' || (doc_id % 7 % 5 + 1) AS text
  FROM documents)"""


def duck_scores(kind: str) -> str:
    found = " || ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in T.SCORE_PATTERNS[kind])
    if kind == "LIRADS":
        one = "CASE WHEN starts_with(upper(x), 'LR-') THEN upper(x) ELSE 'LR-' || upper(x) END"
    elif kind == "BIRADS":
        one = "'BI-RADS-' || regexp_replace(upper(x), 'CATEGORY\\s*', '', 'g')"
    else:
        one = "upper(x)"
    mapped = f"[{one} for x in ({found})]"
    return f"list_filter({mapped}, lambda v, i: list_position({mapped}, v) = i)"


@query(
    "G1_extract_scores",
    f"""WITH {SCORED} SELECT doc_id, array_to_string({duck_scores('LIRADS')}, ',') AS lirads,
       array_to_string({duck_scores('BIRADS')}, ',') AS birads,
       array_to_string({duck_scores('PIRADS')}, ',') AS pirads FROM scored""",
)
def _(t):
    return scored(t).select(
        "doc_id",
        *[
            F.array_join(T.extract_scores(F.col("text"), kind), ",").alias(kind.lower())
            for kind in ("LIRADS", "BIRADS", "PIRADS")
        ],
    )


def duck_primary(kind: str) -> str:
    order = "[" + ", ".join(f"'{s}'" for s in T.SCORE_PRIORITY[kind]) + "]"
    return f"coalesce(list_filter({order}, lambda p: list_contains(sc, p))[1], sc[1])"


@query(
    "G2_primary_score",
    f"""WITH {SCORED}, s AS (SELECT doc_id, {duck_scores('LIRADS')} AS sc FROM scored)
       SELECT doc_id, {duck_primary('LIRADS')} AS primary_score FROM s""",
)
def _(t):
    return scored(t).select(
        "doc_id", T.primary_score(T.extract_scores(F.col("text"), "LIRADS"), "LIRADS").alias("primary_score")
    )


@query(
    "G3_mentions_score",
    f"""WITH {SCORED} SELECT doc_id, regexp_matches(text, '(?is)(LI-?RADS|LR-[1-5M])') AS lirads,
       regexp_matches(text, '(?is)(BI-?RADS|BIRADS)') AS birads,
       regexp_matches(text, '(?is)(PI-?RADS)') AS pirads FROM scored""",
)
def _(t):
    text = F.col("text")
    return scored(t).select(
        "doc_id",
        T.mentions_score(text, "LIRADS").alias("lirads"),
        T.mentions_score(text, "BIRADS").alias("birads"),
        T.mentions_score(text, "PIRADS").alias("pirads"),
    )


def duck_excerpt(col: str, pattern: str) -> str:
    start = f"length(string_split_regex({col}, '{pattern}')[1])"
    end = f"({start} + length(regexp_extract({col}, '{pattern}')))"
    lo, hi = f"greatest(0, {start} - 80)", f"least(length({col}), {end} + 80)"
    return f"""CASE WHEN regexp_matches({col}, '{pattern}') THEN
      CASE WHEN {lo} > 0 THEN '…' ELSE '' END
      || trim(replace(substr({col}, {lo} + 1, {hi} - {lo}), chr(10), ' '), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))
      || CASE WHEN {hi} < length({col}) THEN '…' ELSE '' END END"""


EXCERPT = r"(?is)\b(?:with\ the|that\ of)\b"


@query(
    "G4_excerpt",
    f"""SELECT doc_id, coalesce({duck_excerpt('source', EXCERPT)}, {duck_excerpt('text', EXCERPT)}) AS excerpt
       FROM documents""",
)
def _(t):
    terms = ["with the", " that of", ""]
    return t.documents.select("doc_id", T.excerpt([F.col("source"), F.col("text")], terms).alias("excerpt"))


@query(
    "G5_matched_diagnoses",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter(
         [CASE WHEN lower(p_brand) LIKE 'brand#1%' OR regexp_matches(p_brand || ' ' || p_name, '(?is)\\b(?:ring)\\b')
            THEN p_brand || '=' || p_name END,
          CASE WHEN regexp_matches(p_type || '-' || p_size || ' ' || p_type, '(?is)\\b(?:ring)\\b')
            THEN p_type || '-' || p_size || '=' || p_type END], lambda x: x IS NOT NULL), ';') AS matched FROM {PARTS}""",
)
def _(t):
    found = T.matched_diagnoses(F.col("diagnoses"), ["BRAND#1%"], ["ring"])
    return part_reports(t).select(
        *PART_KEYS,
        F.array_join(F.transform(found, lambda d: F.concat_ws("=", d["code"], d["text"])), ";").alias("matched"),
    )


@query(
    "G6_match_spans",
    f"""WITH {PIECES.format(p=MENTION)}, spans AS (
         SELECT doc_id, unnest(range(1, len(h) + 1)) AS k, s, h FROM pieces)
       SELECT doc_id, start, start + length(hit) AS stop, negated FROM (
         SELECT doc_id, h[k] AS hit,
           CAST(coalesce(list_sum([length(x) for x in s[1:k]]), 0)
             + coalesce(list_sum([length(x) for x in h[1:k - 1]]), 0) AS INTEGER) AS start,
           regexp_matches(right(array_to_string([s[j] || h[j] for j in range(1, k)], '') || s[k], 50), '{NEG}')
             AS negated FROM spans)""",
)
def _(t):
    found = t.documents.select("doc_id", F.explode(T.match_spans(F.col("text"), [MENTION, r"\bdata\b"])).alias("m"))
    return found.select(
        "doc_id", F.col("m.start").alias("start"), F.col("m.end").cast("bigint").alias("stop"), F.col("m.negated").alias("negated")
    )


G6_TERMS = "license|data|thion|ion onth"


@query(
    "G6_dictionary_spans",
    f"""WITH {PIECES.format(p=G6_TERMS)}, spans AS (
         SELECT doc_id, unnest(range(1, len(h) + 1)) AS k, s, h FROM pieces)
       SELECT doc_id, hit AS term, start, start + length(hit) AS stop, negated FROM (
         SELECT doc_id, h[k] AS hit,
           CAST(coalesce(list_sum([length(x) for x in s[1:k]]), 0)
             + coalesce(list_sum([length(x) for x in h[1:k - 1]]), 0) AS INTEGER) AS start,
           regexp_matches(right(array_to_string([s[j] || h[j] for j in range(1, k)], '') || s[k], 50), '{NEG}')
             AS negated FROM spans)""",
)
def _(t):
    terms = G6_TERMS.split("|")
    found = dictionary.with_spans(t.documents.select("doc_id", "text"), terms, "text")
    return found.select("doc_id", F.explode("spans").alias("m")).select(
        "doc_id",
        F.get(F.array(*[F.lit(x) for x in terms]), F.col("m.term")).alias("term"),
        F.col("m.start").alias("start"),
        F.col("m.end").cast("bigint").alias("stop"),
        F.col("m.negated").alias("negated"),
    )


@query(
    "G7_locate_snippet",
    """SELECT doc_id, CAST(length(text) - length(ltrim(text, ' ' || chr(10) || chr(9) || chr(13))) AS INTEGER) AS start,
       CAST(length(rtrim(text, ' ' || chr(10) || chr(9) || chr(13))) AS INTEGER) AS stop FROM documents
       WHERE length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 5""",
)
def _(t):
    # The whole text with its white space changed is found at its own place.
    snippet = F.concat(F.lit("  "), F.regexp_replace("text", r"\s+", " \n "))
    return (
        t.documents.select("doc_id", T.locate_snippet(F.col("text"), snippet).alias("m"))
        .filter("m IS NOT NULL")
        .select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("stop"))
    )


@query(
    "G8_finding_parts",
    f"""WITH {DOCS}, v AS (SELECT doc_id, followup_finding AS f FROM docs UNION ALL
         SELECT -1 - p_partkey, p_name FROM part)
       SELECT doc_id, trim(split_part(f, ':', 1)) AS category,
       CASE WHEN position(':' IN f) > 0 THEN trim(substr(f, position(':' IN f) + 1)) END AS detail FROM v""",
)
def _(t):
    both = doc_reports(t).select("doc_id", F.col("followup_finding").alias("f")).unionByName(
        t.part.select((-1 - F.col("p_partkey")).alias("doc_id"), F.col("p_name").alias("f"))
    )
    return both.select(
        "doc_id",
        T.finding_category(F.col("f")).alias("category"),
        T.finding_detail(F.col("f")).alias("detail"),
    )


@query(
    "G9_classify",
    f"""WITH {DOCS} SELECT primary_report_identifier, contains(lower(followup_finding), 'follow-up') AS followup_detected,
       'high' AS followup_confidence,
       CASE WHEN contains(lower(followup_finding), 'recommend follow') THEN 'recommend follow' ELSE '' END AS followup_finding,
       CASE WHEN contains(lower(followup_finding), 'recommend follow') THEN 'Recommend follow' ELSE '' END AS followup_snippet,
       CAST(NULL AS VARCHAR) AS error FROM docs""",
)
def _(t):
    return evidence.classify(doc_reports(t), text="followup_finding")


@query(
    "G10_keyword_followup",
    f"""WITH {DOCS} SELECT modality, count(*) AS n FROM docs
       WHERE contains(lower(followup_finding), 'recommend follow') OR contains(lower(followup_finding), 'follow-up')
       GROUP BY 1""",
)
def _(t):
    return evidence.followups_by(doc_reports(t), "followup_finding", "modality")


@query(
    "G11_next_batch",
    f"""WITH {DOCS}, failed AS (SELECT CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'error'
         GROUP BY 1 HAVING count(*) >= 3)
       SELECT primary_report_identifier, message_dt FROM docs
       WHERE followup_detected IS NULL AND primary_report_identifier NOT IN (SELECT id FROM failed)
       AND modality IN ('MR', 'US') ORDER BY message_dt DESC, primary_report_identifier LIMIT 50""",
)
def _(t):
    errors = t.events.filter("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("primary_report_identifier")
    )
    docs = doc_reports(t)
    return evidence.next_batch(
        docs, errors, 50, F.col("modality").isin("MR", "US"), processed="followup_detected",
        columns=["primary_report_identifier", "message_dt"],
    )


SEARCH = """SELECT d.doc_id, {scores} AS sc FROM docs d JOIN scored USING (doc_id)
  WHERE lower(modality) IN ('ct', 'us') AND regexp_matches(sending_facility, '(?is)src1|src7') AND patient_age >= 10
  AND patient_age <= 100 AND message_dt >= DATE '2024-01-01' AND regexp_matches(text, '(?is)(LI-?RADS|LR-[1-5M])')"""


@query(
    "H22_score_search",
    f"""WITH {DOCS}, {SCORED}, s AS ({SEARCH.format(scores=duck_scores("LIRADS"))})
       SELECT doc_id, array_to_string(sc, ',') AS scores, {duck_primary("LIRADS")} AS primary_score FROM s WHERE len(sc) > 0""",
)
def _(t):
    texts = scored(t).select("doc_id", F.col("text").alias("report_text"))
    reports = doc_reports(t).drop("report_text").join(texts, "doc_id")
    search = scores.ScoreSearch(
        modalities=["ct", "US"], service="src1|src7", min_age=10, max_age=100, date_start="2024-01-01",
        columns={"service_name": "sending_facility", "requested_dt": "message_dt"},
    )
    found = scores.score_search(reports, search)
    return found.select("doc_id", F.array_join("scores", ",").alias("scores"), "primary_score")


@query(
    "F14_cohort_pipeline",
    f"""WITH {PIECES.format(p="license")}, {DOCS}, f AS (
         SELECT d.doc_id, modality = 'US' AS strong, coalesce({duck_mentions("license", NEG)}, false) AS positive
         FROM docs d JOIN pieces USING (doc_id) WHERE modality IN ('US', 'CT', 'MR') AND patient_age <= 100
         AND (modality = 'US' OR regexp_matches(report_text, '(?is)license')))
       SELECT 'tested' AS part, doc_id, strong AS has_strong_indicator, strong OR positive AS has_positive_mention,
         strong OR positive AS included_in_cohort FROM f
       UNION ALL SELECT 'all', doc_id, false, true, true FROM f""",
)
def _(t):
    docs = doc_reports(t).withColumn("diagnoses", diagnosis_array((F.col("modality"), F.col("sending_facility"))))
    config = K.CohortConfig(
        diagnosis_codes=["US"], text_terms="license", modalities=["us", "ct", "mr"], max_age=100
    )
    out = None
    for part, tested in (("tested", True), ("all", False)):
        rows = K.build_cohort(docs, config, tested).select(
            F.lit(part).alias("part"), "doc_id", "has_strong_indicator", "has_positive_mention", "included_in_cohort"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "F25_search_evidence",
    f"""WITH {DOCS} SELECT primary_report_identifier, {duck_excerpt("report_text", EXCERPT)} AS excerpt,
       CASE WHEN modality = 'US' THEN 'US' ELSE '' END AS codes FROM docs""",
)
def _(t):
    docs = doc_reports(t).withColumn("diagnoses", diagnosis_array((F.col("modality"), F.col("sending_facility"))))
    search = K.Search(lambda: docs, terms=["with the", "that of"], prefixes=["us"])
    codes = F.array_join(F.transform("matched_diagnoses", lambda d: d["code"]), ",")
    return search.evidence().select("primary_report_identifier", "excerpt", codes.alias("codes"))


@query(
    "F26_combined_filters",
    f"""WITH {REVIEWED} SELECT accession_number FROM f
       WHERE included_in_cohort AND NOT strong AND reviewed AND decision""",
)
def _(t):
    wanted = ["included", "text_only", "reviewed", "decided_in"]
    return K.cohort_review_filter(cohort_rows(t), decisions(t), wanted).select("accession_number")
