import datetime as dt

import pytest
from pyspark.sql import functions as F

from reportloom.operators import cohort, metrics, policy, profile, scores
from reportloom.sources import lists, sinks

SEED = [("A", "CT")] * 2 + [("A", "MR")] + [("B", "CT")] * 2 + [("HOME CARE", "CT"), ("C", "MR")]
RULES = policy.Policy(
    filtered_tables=("reports*",),
    attribute_filters={
        "facilities": policy.AttributeFilter("sending_facility"),
        "modalities": policy.AttributeFilter("modality", ("reports_latest",)),
    },
    masked_columns=("name", "person"),
)


def user(**attributes):
    return policy.User("u", ("user",), True, attributes)


@pytest.fixture(scope="module")
def seed(spark):
    rows = [(f, m, "Ann", ("Ann", "Ray")) for f, m in SEED]
    return spark.createDataFrame(
        rows, "sending_facility string, modality string, name string, person struct<given:string,family:string>"
    )


@pytest.mark.parametrize(
    "who, table, n",
    [
        (user(facilities=["A"]), "reports", 3),
        (user(facilities=["*"]), "reports", 7),
        (user(facilities=["HOME CARE"]), "reports", 1),
        (user(facilities=["A"], modalities=["CT"]), "reports_latest", 2),
        (user(facilities=["A"]), "reports_latest", 0),
        (user(), "reports", 0),
        (user(facilities=["x') OR ('1'='1"]), "reports", 0),
        (user(), "other", 7),
        (policy.User(service=True), "reports", 7),
    ],
)
def test_row_filter(seed, who, table, n):
    assert policy.governed(seed, table, who, RULES).count() == n


def test_mask_and_access(seed):
    shown = policy.governed(seed, "other", user(redact_select_identifiers=["true"]), RULES).first()
    assert (shown["name"], shown["person"]) == ("[REDACTED]", None)
    assert policy.governed(seed, "other", user(redact_select_identifiers=["yes"]), RULES).first()["name"] == "Ann"
    hidden = "reports_report_patient_mapping"
    for who in (user(), policy.User("u", ("guest",)), policy.User("u", ("user",), enabled=False)):
        with pytest.raises(policy.AccessDenied):
            policy.governed(seed, hidden, who, RULES)
    assert policy.governed(seed, hidden, user(bypass_hidden_tables=["true"]), RULES).count() == 7


@pytest.mark.parametrize("span, target, step", [(10, 10, 1), (95, 10, 10), (19, 10, 2), (0.37, 10, 0.05), (41, 10, 5)])
def test_round_width(spark, span, target, step):
    found = spark.range(1).select(profile.round_width(F.lit(float(span)) / target)).first()[0]
    assert found == pytest.approx(step)


def test_calendar_widths(spark):
    day = dt.datetime(2024, 3, 1)

    def width(length):
        chosen = profile.calendar_width(F.lit(day), F.lit(day + length), F.lit(10))
        return tuple(spark.range(1).select(chosen.alias("w")).first()["w"])[:2]

    assert width(dt.timedelta(hours=5)) == (1800, 0)
    assert width(dt.timedelta(days=8)) == (86400, 0)
    assert width(dt.timedelta(days=300)) == (0, 1)
    assert width(dt.timedelta(days=365 * 300)) == (0, 120)
    counts = [spark.range(1).select(profile.buckets(F.lit(n), F.lit(True), 20)).first()[0] for n in (1, 2, 4, 5, 10**6)]
    assert counts == [1, 2, 2, 3, 20]


def test_profiles_of_few_values(spark):
    one = spark.createDataFrame([(3, "a", None)], "n int, s string, e string")
    assert [tuple(r) for r in profile.profile_numeric(one, "n").collect()] == [(3.0, 4.0, 1, 3.0, 3.0)]
    assert profile.profile_categorical(one, "e").count() == 0
    assert [r["label"] for r in profile.profile_categorical(one, "s").collect()] == ["a"]
    kinds = {r["column_name"]: r["kind"] for r in profile.column_kinds(one).collect()}
    assert kinds == {"n": "numeric", "s": "categorical", "e": "none"}
    profiles = profile.profile_columns(one)
    assert [k for k, _ in profiles.values()] == ["numeric", "categorical", "none"] and profiles["e"][1] is None
    assert profile.profile_numeric(one.filter("n > 9"), "n").count() == 0


def test_confusion_matrix_always_has_four_cells(spark):
    none = spark.createDataFrame([], "human_ground_truth boolean, followup_detected boolean")
    assert [r["cell_count"] for r in metrics.confusion_matrix(none).collect()] == [0] * 4


def test_periods(spark):
    anchor = F.lit("2024-02-29").cast("date")
    bounds = lambda which: tuple(spark.range(1).select(*scores.period_bounds(which, anchor)).first())
    assert bounds("last_month") == (dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert bounds("last_quarter") == (dt.date(2023, 10, 1), dt.date(2024, 1, 1))
    assert bounds("current_quarter") == (dt.date(2024, 1, 1), dt.date(2024, 3, 1))
    assert bounds("5_years_ago") == (dt.date(2019, 1, 1), dt.date(2020, 1, 1))


def test_id_lists(spark):
    assert lists.resolve_id_column(["﻿Note", " Patient MRN"]) == ("epic_mrn", 1)
    assert lists.resolve_id_column(["mrn", "Acc_Num"]) == ("accession_number", 1)
    assert lists.resolve_id_column(["mrn", "EMPI"], "patient_mpi") == ("patient_mpi", 1)
    for header, column in ((["x"], None), (["mrn"], "nope"), (["mrn"], "accession_number")):
        with pytest.raises(ValueError):
            lists.resolve_id_column(header, column)
    ids = spark.createDataFrame([(" b ",), ("a",), ("b",), ("",), (None,)], "c string")
    assert [r["id"] for r in lists.clean_ids(ids, "c").orderBy("ord").collect()] == ["b", "a"]
    assert lists.clean_ids(ids.filter("c = ''"), "c").count() == 0


def test_uploads_with_line_breaks_and_latin_letters(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_bytes('Note,"Acc Num","accession"\n"two\nlines",x,É1\nplain,y,b2\n'.encode("latin-1"))
    ids, column = lists.read_id_list(spark, str(path))
    assert column == "accession_number" and {r["id"] for r in ids.collect()} == {"É1", "b2"}
    path.write_text("mrn\n \n")
    with pytest.raises(ValueError):
        lists.read_id_list(spark, str(path))


def test_cohort_guards(spark, seed):
    ids = spark.createDataFrame([("A", 0)], "id string, ord long")
    seed.createOrReplaceTempView("seed_rows")
    for sql in ("SELECT * FROM seed_rows", "SELECT {{cohort}}, {{cohort}} FROM seed_rows"):
        with pytest.raises(ValueError):
            cohort.apply_cohort(spark, sql, ids, "sending_facility")
    with pytest.raises(ValueError):
        cohort.apply_cohort(spark, "SELECT * FROM seed_rows WHERE {{cohort}}", ids, "a) OR (1")
    with pytest.raises(ValueError):
        cohort.read_by_ids(seed, ["x"], "patient_id", "reports_latest")
    with pytest.raises(ValueError):
        cohort.rows(seed)
    with pytest.raises(ValueError):
        cohort.unmatched(ids, seed, "modality", strict=True)
    lean = seed.select(F.lit("r").alias("primary_report_identifier"), F.lit("a").alias("accession_number"))
    assert cohort.rows(lean).count() == lean.count()
    numbered = lean.withColumn("primary_report_identifier", F.monotonically_increasing_id().cast("string"))
    seen, after = [], None
    while True:
        page = cohort.rows(numbered, page=3, after=after).collect()
        seen += [r["primary_report_identifier"] for r in page]
        if not page[-1]["more"]:
            break
        after = seen[-1]
    assert sorted(seen) == sorted(r[0] for r in numbered.select("primary_report_identifier").collect())


def test_formula_guard(spark):
    values = ["=1", "+1", "-1", "@x", "\tx", "plain", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(sinks.formula_guard(F.col("v")).alias("v"))
    assert [r["v"] for r in df.collect()] == ["'=1", "'+1", "'-1", "'@x", "'\tx", "plain", None]
