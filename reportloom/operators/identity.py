"""Patient identity: reports that share an identifier belong to one patient.

Identifiers are vertices, a report carrying two of them is an edge, a patient is
a connected component.  Components are found by alternating star contraction on
DataFrames: every round is a minimum per vertex, which combines before the
shuffle, and a join.  The number of rounds grows with the logarithm of the graph
and no round emits more rows than a few per edge, so a component holding a large
share of all reports is as cheap as many small ones.

Updates are incremental.  The stored mapping already knows the component of each
stored identifier, so the graph of one batch holds the batch's identifiers and,
as extra vertices, the stored patients they touch.  Its size follows the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..session import cut
from .cohort import any_listed
from .windows import newest_per

MAPPING_COLUMNS = (
    "patient_id",
    "primary_report_identifier",
    "mpi",
    "epic_mrn",
    "consistent",
)
HISTORY_COLUMNS = MAPPING_COLUMNS + ("previous_patient_id",)
REPORT = "primary_report_identifier"
NO_IDS = "none:"


def resolve_ids(
    df: DataFrame,
    rule_set: rules.IdRules = rules.DEFAULT_RULES,
    version: str = "version_id",
    report: str = REPORT,
) -> DataFrame:
    """``report, mpi, epic_mrn`` by the identifier rules of each message version."""
    return df.select(
        F.col(report).alias(REPORT),
        rules.patient_mpi(df, version, rule_set).alias("mpi"),
        rules.patient_epic(df, version, rule_set).alias("epic_mrn"),
    )


def unmapped(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Reports the mapping does not hold yet."""
    return df.join(mapping.select(REPORT), REPORT, "left_anti")


def _pairs(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("mpi").alias(f"{prefix}mpi"), F.col("epic_mrn").alias(f"{prefix}epic"))


def _exact(prefix: str) -> Column:
    return F.col("mpi").eqNullSafe(F.col(f"{prefix}mpi")) & F.col("epic_mrn").eqNullSafe(
        F.col(f"{prefix}epic")
    )


def defer_exact(df: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rest, deferred)``: deferred reports repeat a known pair of identifiers.

    A pair is known when the mapping holds it or another report of the batch with
    a smaller identifier does.
    """
    known = _pairs(mapping, "_k_").distinct()
    first = df.groupBy("mpi", "epic_mrn").agg(F.min(REPORT).alias("_first"))
    first = first.join(known, _exact("_k_"), "left_anti").select(F.col("_first"))
    rest = df.join(first, F.col(REPORT) == F.col("_first"), "left_semi")
    deferred = df.join(first, F.col(REPORT) == F.col("_first"), "left_anti")
    return rest, deferred


def disjoint_new(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Reports whose identifiers occur nowhere else, each a new patient.

    ``df`` holds one report per identifier pair, as ``defer_exact`` leaves it.
    """
    shared = []
    for name in ("mpi", "epic_mrn"):
        counted = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
        repeated = counted.filter("_n > 1").select(name)
        known = mapping.filter(F.col(name).isNotNull()).select(name).distinct()
        shared.append(repeated.unionByName(known))
    alone = df.join(shared[0], "mpi", "left_anti").join(shared[1], "epic_mrn", "left_anti")
    return _as_new(alone.filter(F.coalesce("mpi", "epic_mrn").isNotNull()))


def _as_new(df: DataFrame) -> DataFrame:
    return df.select(
        F.sha2(F.col(REPORT), 256).alias("patient_id"),
        REPORT,
        "mpi",
        "epic_mrn",
        F.lit(True).alias("consistent"),
    )


def _id_owner(mapping: DataFrame) -> DataFrame:
    """``kind, id, patient_id, consistent`` of every stored identifier."""
    by_kind = [
        mapping.filter(F.col(name).isNotNull()).select(
            F.lit(name).alias("kind"), F.col(name).alias("id"), "patient_id", "consistent"
        )
        for name in ("mpi", "epic_mrn")
    ]
    return (
        by_kind[0]
        .unionByName(by_kind[1])
        .groupBy("kind", "id")
        .agg(
            F.min("patient_id").alias("patient_id"),
            F.min("consistent").alias("consistent"),
        )
    )


def inherit_single(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Reports with one identifier: its patient, or a new one per identifier."""
    single = df.filter(F.col("mpi").isNull() != F.col("epic_mrn").isNull()).select(
        "*",
        F.when(F.col("mpi").isNotNull(), "mpi").otherwise("epic_mrn").alias("kind"),
        F.coalesce("mpi", "epic_mrn").alias("id"),
    )
    fresh = single.groupBy("kind", "id").agg(F.min(REPORT).alias("_first"))
    return (
        single.join(_id_owner(mapping), ["kind", "id"], "left")
        .join(fresh, ["kind", "id"])
        .select(
            F.coalesce("patient_id", F.sha2(F.col("_first"), 256)).alias("patient_id"),
            REPORT,
            "mpi",
            "epic_mrn",
            F.coalesce("consistent", F.lit(True)).alias("consistent"),
        )
    )


def attach_deferred(deferred: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapping rows for reports whose identifier pair the mapping holds."""
    owners = mapping.groupBy(
        F.col("mpi").alias("_k_mpi"), F.col("epic_mrn").alias("_k_epic")
    ).agg(F.min("patient_id").alias("patient_id"), F.min("consistent").alias("consistent"))
    return deferred.join(owners, _exact("_k_")).select(
        "patient_id", REPORT, "mpi", "epic_mrn", "consistent"
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a vertex to the smallest in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("_m"))
    low = low.select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(low, F.col("u") == F.col("_u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the smallest of them.

    ``edges`` run from the larger vertex ``u`` to the smaller ``v``.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(low.select(F.col("u").alias("_u"), "m"), F.col("u") == F.col("_u"))
        .filter(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100
) -> DataFrame:
    """``vertex, component`` with the smallest vertex naming its component.

    Edges may repeat and may be loops.  Each round is cut to the checkpoint
    folder, so a lost executor costs a re-read and not the whole history.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(
        F.col("u").isNotNull() & F.col("v").isNotNull()
    )
    # One undirected edge each; a loop only keeps its vertex.
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    vertices = (
        pairs.select(F.col("u").alias("vertex"))
        .unionByName(pairs.select(F.col("v").alias("vertex")))
        .distinct()
    )
    # Contracting once before anything is mirrored thins out dense graphs.
    current = cut(_small_star(pairs.filter(F.col("u") != F.col("v"))))
    rounds = 0
    while not _settled(current):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
        current = cut(_small_star(_large_star(current)))
        rounds += 1
    return vertices.join(current.select(F.col("u").alias("vertex"), "v"), "vertex", "left").select(
        "vertex", F.coalesce("v", "vertex").alias("component")
    )


def _settled(edges: DataFrame) -> bool:
    """Is every vertex linked to one smaller vertex at most, and that one to none?

    Then the stars are the components, each around its smallest vertex.
    """
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("n")), F.struct(F.col("v").alias("x"), F.lit(0).alias("n")))
    links = edges.select(F.inline(ends)).groupBy("x").agg(F.sum("n").alias("_up"), F.min("n").alias("_least"))
    return links.filter("_up > 1 OR _up = 1 AND _least = 0").isEmpty()


def _vertex(kind: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c) if isinstance(c, str) else c)


def _anchor(null_ids: str) -> Column:
    """Some vertex of the report's component."""
    lonely = F.lit(NO_IDS) if null_ids == "group" else _vertex("report", REPORT)
    return F.coalesce(_vertex("mpi", "mpi"), _vertex("epic", "epic_mrn"), lonely)


def closure(mapping: DataFrame, seeds: DataFrame) -> DataFrame:
    """Mapping rows of every patient reachable from the seeds' identifiers.

    The mapping stores components, so one step reaches all of them.
    """
    owners = _id_owner(mapping)
    wanted = []
    for name in ("mpi", "epic_mrn"):
        ids = seeds.filter(F.col(name).isNotNull()).select(
            F.lit(name).alias("kind"), F.col(name).alias("id")
        )
        wanted.append(ids.distinct())
    touched = owners.join(wanted[0].unionByName(wanted[1]), ["kind", "id"], "left_semi")
    return mapping.join(touched.select("patient_id").distinct(), "patient_id", "left_semi")


def _single(c: str) -> Column:
    """At most one distinct value: the extremes agree, or there is none."""
    return F.coalesce(F.min(c) == F.max(c), F.lit(True))


def consistency(
    rows: DataFrame, component: str = "component", mpi: str = "mpi", epic: str = "epic_mrn"
) -> DataFrame:
    """Per component: does it hold at most one distinct value of each identifier?"""
    return rows.groupBy(component).agg((_single(mpi) & _single(epic)).alias("consistent"))


def mapping_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, with the previous patient id, of reports whose id or flag changed."""
    before = old.select(
        REPORT,
        F.col("patient_id").alias("previous_patient_id"),
        F.col("consistent").alias("_was"),
    )
    changed = (F.col("patient_id") != F.col("previous_patient_id")) | (
        F.col("consistent") != F.col("_was")
    )
    return new.join(before, REPORT).filter(changed).select(*HISTORY_COLUMNS)


def placed_history(affected: DataFrame) -> DataFrame:
    """:func:`mapping_history` of the rows that :func:`place_batch` found affected."""
    changed = (F.col("patient_id") != F.col("previous_patient_id")) | (F.col("consistent") != F.col("_was"))
    return affected.filter(changed).select(*HISTORY_COLUMNS)


def empty_mapping(spark) -> DataFrame:
    # Known to be empty while planning, so that joins with it are left out.
    kinds = dict.fromkeys(MAPPING_COLUMNS, "string") | {"consistent": "boolean"}
    return spark.range(1).select(*[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).limit(0)


def place_batch(
    mapping: DataFrame, reports: DataFrame, null_ids: str = "group"
) -> tuple[DataFrame, DataFrame]:
    """What a batch alters in the mapping and what it adds to it: ``(affected, added)``.

    ``affected`` holds the stored rows of patients whose id or flag the batch changes, with
    their ``previous_patient_id`` and the flag ``_was``; ``added`` holds the batch's reports that
    were not mapped.  Both sides are reduced to their pairs of identifiers first.  The patients the
    batch merely touches are summed up, a row each, and the reports without identifiers
    not even that, since their patient has none to disagree on.
    """
    fresh = unmapped(newest_per(reports, REPORT, ["mpi", "epic_mrn"]), mapping)
    batch = cut(fresh.select(REPORT, "mpi", "epic_mrn", _anchor(null_ids).alias("anchor")))
    pairs = cut(batch.groupBy("mpi", "epic_mrn", "anchor").agg(F.min(REPORT).alias("_first")))
    known = cut(mapping.groupBy("patient_id", "mpi", "epic_mrn").agg(F.min("consistent").alias("consistent")))

    # Vertices of the batch, and the stored patients that own one of them.
    def id_vertices(*more: Column) -> Column:
        found = F.array(_vertex("mpi", "mpi"), _vertex("epic", "epic_mrn"), *more)
        return F.explode(F.array_distinct(F.array_compact(found))).alias("vertex")

    ids = pairs.select(id_vertices(F.col("anchor"))).distinct()
    grouped = F.coalesce("mpi", "epic_mrn").isNull() & F.lit(null_ids == "group")
    owners = known.select("patient_id", id_vertices(F.when(grouped, F.lit(NO_IDS))))
    touched = cut(owners.join(ids, "vertex", "left_semi").distinct())
    # In the graph the smallest of its touched vertices stands for a patient.
    spoken = touched.groupBy("patient_id").agg(F.min("vertex").alias("_for"))
    own = pairs.select(
        F.col("anchor").alias("a"),
        F.coalesce(_vertex("epic", "epic_mrn"), F.col("anchor")).alias("b"),
    )
    stored = touched.join(spoken, "patient_id").select(F.col("vertex").alias("a"), F.col("_for").alias("b"))
    components = cut(connected_components(own.unionByName(stored)))

    # What is known of each touched patient; of the one without identifiers all is.
    extremes = [agg(c).alias(f"_{agg.__name__}_{c}") for c in ("mpi", "epic_mrn") for agg in (F.min, F.max)]
    named = spoken.filter(F.col("_for") != NO_IDS)
    summed = known.join(named, "patient_id").groupBy("patient_id").agg(
        *extremes, F.min("consistent").alias("_was"), F.min("_for").alias("_for")
    )
    nothing = [F.lit(None).cast("string").alias(f"_{agg}_{c}") for c in ("mpi", "epic_mrn") for agg in ("min", "max")]
    lonely = spoken.filter(F.col("_for") == NO_IDS).select("patient_id", *nothing, F.lit(True).alias("_was"), "_for")
    patients = cut(
        summed.unionByName(lonely).join(components, F.col("_for") == F.col("vertex")).drop("vertex", "_for")
    )
    placed = pairs.join(components, F.col("anchor") == F.col("vertex"))
    incoming = placed.groupBy("component").agg(*extremes, F.min("_first").alias("_first"))
    facts = patients.select("component", "patient_id", F.lit(None).cast("string").alias("_first"), *[c for c in patients.columns if c[:5] in ("_min_", "_max_")])
    facts = facts.unionByName(incoming.withColumn("patient_id", F.lit(None).cast("string")))

    def agree(c: str) -> Column:
        return F.coalesce(F.min(f"_min_{c}") == F.max(f"_max_{c}"), F.lit(True))

    verdict = cut(
        facts.groupBy("component").agg(
            F.coalesce(F.min("patient_id"), F.sha2(F.min("_first"), 256)).alias("_id"),
            (agree("mpi") & agree("epic_mrn")).alias("_ok"),
        )
    )
    altered = cut(
        patients.join(verdict, "component")
        .filter((F.col("patient_id") != F.col("_id")) | ~F.col("_was").eqNullSafe(F.col("_ok")))
        .select("patient_id", "_id", "_ok")
    )
    affected = mapping.withColumnRenamed("patient_id", "previous_patient_id").join(
        altered, F.col("previous_patient_id") == F.col("patient_id")
    ).select(
        F.col("_id").alias("patient_id"), REPORT, "mpi", "epic_mrn", F.col("_ok").alias("consistent"),
        "previous_patient_id", F.col("consistent").alias("_was"),
    )
    settled = components.join(verdict, "component").select("vertex", "_id", "_ok")
    added = batch.join(settled, F.col("anchor") == F.col("vertex")).select(
        F.col("_id").alias("patient_id"), REPORT, "mpi", "epic_mrn", F.col("_ok").alias("consistent")
    )
    return affected, added


def resolve_batch(
    mapping: DataFrame, reports: DataFrame, null_ids: str = "group"
) -> tuple[DataFrame, DataFrame]:
    """Mapping rows a batch adds or alters, before and after: ``(old, new)``.

    ``new`` holds the batch's reports and the reports of stored patients whose id or flag
    the batch changes; ``old`` holds the stored state of the latter.
    """
    affected, added = place_batch(mapping, reports, null_ids)
    old = affected.select(
        F.col("previous_patient_id").alias("patient_id"), REPORT, "mpi", "epic_mrn", F.col("_was").alias("consistent")
    )
    return old, affected.select(*MAPPING_COLUMNS).unionByName(added)


def placed_changes(affected: DataFrame, added: DataFrame) -> DataFrame:
    """The change rows of the mapping that :func:`place_batch` amounts to."""
    moved = affected.filter(~F.struct("patient_id", "consistent").eqNullSafe(F.struct("previous_patient_id", "_was")))
    rows = moved.select(*MAPPING_COLUMNS, F.lit("update_postimage").alias("_change_type"))
    return rows.unionByName(added.withColumn("_change_type", F.lit("insert")))


def update_mapping(
    mapping: DataFrame, reports: DataFrame, null_ids: str = "group"
) -> tuple[DataFrame, DataFrame]:
    """Fold a batch of resolved reports into the mapping: ``(mapping, history)``.

    ``null_ids`` says whether reports without any identifier form one patient
    (``group``) or one each (``separate``).  A new patient is named after its
    smallest report; a merge keeps the smallest of the stored names.
    """
    old, new = resolve_batch(mapping, reports, null_ids)
    untouched = mapping.join(old.select(REPORT), REPORT, "left_anti")
    updated = untouched.select(*MAPPING_COLUMNS).unionByName(new)
    return updated, mapping_history(old, new)


def build_mapping(reports: DataFrame, null_ids: str = "group") -> DataFrame:
    """Mapping of a whole set of reports at once."""
    return update_mapping(empty_mapping(reports.sparkSession), reports, null_ids)[0]


def patient_view(
    df: DataFrame, mapping: DataFrame, report: str = REPORT
) -> DataFrame:
    """Reports of consistent patients with the identifiers resolved per patient."""
    kept = mapping.filter("consistent")
    resolved = kept.groupBy("patient_id").agg(
        F.max("epic_mrn").alias("resolved_epic_mrn"), F.max("mpi").alias("resolved_mpi")
    )
    owner = kept.select(F.col(REPORT).alias("_report"), "patient_id")
    return (
        df.join(owner, F.col(report) == F.col("_report"))
        .drop("_report")
        .join(resolved, "patient_id")
        .select(*df.columns, "patient_id", "resolved_epic_mrn", "resolved_mpi")
    )


def validity(changes: DataFrame, order: str = "_commit_version", at: str | None = None) -> DataFrame:
    """When each report belonged to which patient, from the change rows of the mapping.

    ``valid_from`` is the commit, or the column ``at`` of it, that made a state of the
    report; ``valid_to`` that of the next other one, NULL for a state that stands.  Commits that
    repeat a state lengthen it, deleted reports have a gap.  A report has an image a
    commit at most, so its window is small.
    """
    state = F.struct("patient_id", "mpi", "epic_mrn", "consistent")
    images = changes.filter(F.col("_change_type") != "update_preimage").select(
        REPORT,
        F.col(order).alias("_order"),
        F.col(at or order).alias("valid_from"),
        F.when(F.col("_change_type") != "delete", state).alias("_state"),
    )
    by_commit = Window.partitionBy(REPORT).orderBy("_order")
    moved = (
        images.withColumn("_same", F.col("_state").eqNullSafe(F.lag("_state").over(by_commit)))
        .withColumn("_first", F.row_number().over(by_commit) == 1)
        .filter(F.col("_first") | ~F.col("_same"))
    )
    spans = moved.withColumn("valid_to", F.lead("valid_from").over(by_commit)).filter(F.col("_state").isNotNull())
    return spans.select("_state.*", REPORT, "valid_from", "valid_to").select(*MAPPING_COLUMNS, "valid_from", "valid_to")


def mapping_as_of(spans: DataFrame, at) -> DataFrame:
    """The mapping as it stood at a commit or a time."""
    at = at if isinstance(at, Column) else F.lit(at)
    held = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return spans.filter(held).select(*MAPPING_COLUMNS)


def patient_view_as_of(df: DataFrame, spans: DataFrame, at, report: str = REPORT) -> DataFrame:
    """The patient view of reports as it was at a commit or a time."""
    return patient_view(df, mapping_as_of(spans, at), report)


def patient_at(df: DataFrame, spans: DataFrame, ts: str, report: str = REPORT) -> DataFrame:
    """Rows with the ``patient_id`` and flag ``consistent`` their report had at the row's own time.

    Rows of reports that were not mapped then have NULL there.
    """
    known = spans.select(F.col(REPORT).alias("_report"), "patient_id", "consistent", "valid_from", "valid_to")
    then = (F.col(ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    joined = df.join(known, (F.col(report) == F.col("_report")) & then, "left")
    return joined.select(*df.columns, "patient_id", "consistent")


def report_views(curated: DataFrame, latest: DataFrame, mapping: DataFrame, name: str = "reports") -> dict[str, DataFrame]:
    """The tables and patient views that reports may be read from, by name."""
    tables = {f"{name}_curated": curated, f"{name}_latest": latest}
    return tables | {f"{t}_epic_view": patient_view(df, mapping) for t, df in tables.items()}


def expand_patients(
    df: DataFrame, ids: DataFrame | Sequence[str], columns: Sequence[str] = ("epic_mrn", "mpi"),
    patient: str = "patient_id",
) -> DataFrame:
    """All rows of the patients behind the identifiers, given as values or as a table with a column ``id``."""
    return df.join(any_listed(df, ids, columns).select(patient).distinct(), patient, "left_semi")
