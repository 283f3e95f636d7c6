import random

import pytest

from reportloom.operators import identity as I

SCHEMA = "primary_report_identifier string, mpi string, epic_mrn string"
DAY1 = {
    "r0": ("01", None), "r1": ("02", None), "r2": ("02", None), "r3": (None, "03"), "r4": ("04", None),
    "r5": ("04", None), "r6": (None, "05"), "r7": ("06", "07"), "r8": ("08", "09"), "r9": ("10", "11"),
    "r10": ("10", "12"), "r11": ("13", None), "r12": ("13", "14"),
}
DAY2 = {
    "s0": ("01", None), "s1": (None, "03"), "s2": ("06", "07"), "s3": ("15", None), "s4": (None, "16"),
    "s5": ("17", "18"), "s6": ("17", "18"), "s7": ("02", "03"), "s8": ("04", "05"), "s9": ("01", "05"),
    "s10": ("19", "14"),
}


def frame(spark, reports):
    return spark.createDataFrame([(k, *v) for k, v in reports.items()], SCHEMA)


def webs(mapping):
    groups = {}
    for r in mapping.collect():
        groups.setdefault((r["patient_id"], r["consistent"]), set()).add(r["primary_report_identifier"])
    return {(frozenset(v), k[1]) for k, v in groups.items()}


def expect(consistent, inconsistent):
    return {(frozenset(w.split()), True) for w in consistent} | {
        (frozenset(w.split()), False) for w in inconsistent
    }


def test_two_days(spark):
    first, history = I.update_mapping(I.empty_mapping(spark), frame(spark, DAY1))
    assert webs(first) == expect(["r0", "r1 r2", "r3", "r4 r5", "r6", "r7", "r8", "r11 r12"], ["r9 r10"])
    assert history.count() == 0
    second, history = I.update_mapping(first, frame(spark, DAY2))
    assert webs(second) == expect(
        ["r3 s1 s7 r1 r2", "r7 s2", "s3", "s4", "s5 s6", "r8"],
        ["r0 s0 s9 r6 s8 r4 r5", "r9 r10", "r11 r12 s10"],
    )
    before = {r["primary_report_identifier"]: r for r in first.collect()}
    after = {r["primary_report_identifier"]: r for r in second.collect()}
    changed = {
        k for k, old in before.items()
        if (old["patient_id"], old["consistent"]) != (after[k]["patient_id"], after[k]["consistent"])
    }
    rows = history.collect()
    assert {r["primary_report_identifier"] for r in rows} == changed
    assert all(r["previous_patient_id"] == before[r["primary_report_identifier"]]["patient_id"] for r in rows)
    # A repeat of known reports changes nothing.
    again, history = I.update_mapping(second, frame(spark, DAY2))
    assert webs(again) == webs(second) and history.count() == 0


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(parent)}


@pytest.mark.parametrize("shape", ["chain", "random", "star"])
def test_components(spark, shape):
    rng = random.Random(3)
    if shape == "chain":
        order = [f"v{i:03d}" for i in range(120)]
        rng.shuffle(order)
        edges = list(zip(order, order[1:]))
    elif shape == "star":
        edges = [("hub", f"v{i}") for i in range(300)] + [("x", "x"), ("a", "b")]
    else:
        edges = [(f"a{rng.randrange(150)}", f"b{rng.randrange(150)}") for _ in range(140)]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["vertex"]: r["component"] for r in I.connected_components(df).collect()}
    assert got == components_by_hand(edges)


def random_reports(seed, n=60):
    rng = random.Random(seed)
    pick = lambda p: None if rng.random() < 0.35 else f"{p}{rng.randrange(25)}"
    return {f"r{i:02d}": (pick("m"), pick("e")) for i in range(n)}


@pytest.mark.parametrize("null_ids", ["group", "separate"])
def test_batches_do_not_matter(spark, null_ids):
    reports = random_reports(5)
    whole = I.build_mapping(frame(spark, reports), null_ids)
    mapping = I.empty_mapping(spark)
    names = list(reports)
    random.Random(1).shuffle(names)
    for part in (names[:20], names[20:45], names[45:]):
        mapping, _ = I.update_mapping(mapping, frame(spark, {k: reports[k] for k in part}), null_ids)
    assert webs(mapping) == webs(whole)
    without = {k for k, v in reports.items() if v == (None, None)}
    sizes = [len(w) for w, _ in webs(whole) if w & without]
    assert sizes == ([len(without)] if null_ids == "group" else [1] * len(without))


def test_a_report_without_ids_touches_one_row(spark):
    reports = {f"r{i:02d}": (None, None) if i % 2 else (f"m{i}", f"e{i}") for i in range(60)}
    mapping = I.build_mapping(frame(spark, reports))
    old, new = I.resolve_batch(mapping, frame(spark, {"z": (None, None)}))
    assert old.count() == 0 and new.count() == 1
    assert new.first()["patient_id"] == mapping.filter("primary_report_identifier = 'r01'").first()["patient_id"]
    # A known patient's further report alters none of the rows it has, a second id all of them.
    old, new = I.resolve_batch(mapping, frame(spark, {"z": ("m0", "e0")}))
    assert old.count() == 0 and new.first()["consistent"]
    old, new = I.resolve_batch(mapping, frame(spark, {"z": ("m0", "other")}))
    assert old.count() == 1 and not any(r["consistent"] for r in new.collect())
    old, new = I.resolve_batch(mapping, frame(spark, {"z": ("m0", "e2")}))
    assert old.count() == 2 and len({r["patient_id"] for r in new.collect()}) == 1
