"""Change-driven table maintenance: hashing, upserts, deletes and change rows.

These are the pure forms, DataFrames in and out.  ``streaming.tables`` applies
them to stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.predicates import any_of
from ..functions.rules import has_text
from .windows import newest_per

CONTENT_HASH = "content_hash"
CHANGE_COLUMNS = ("_change_type", "_commit_version", "_commit_timestamp")
UPSERTS = ("insert", "update_postimage")
PREIMAGE = "update_preimage"

# Serialisation the content hash is defined over.
_HASH_JSON = {
    "ignoreNullFields": "true",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "dateFormat": "yyyy-MM-dd",
}


def with_content_hash(df: DataFrame, exclude: Sequence[str] = ("updated",)) -> DataFrame:
    """SHA-256 of the row's JSON, independent of column order.

    NULL fields are left out, so a column that is all NULL hashes like one that
    is absent.  The hash itself is never NULL.
    """
    skipped = {CONTENT_HASH, *exclude}
    body = F.to_json(F.struct(*sorted(set(df.columns) - skipped)), _HASH_JSON)
    return df.withColumn(CONTENT_HASH, F.sha2(body, 256))


def drop_unchanged(
    df: DataFrame,
    existing: DataFrame,
    key: str = "source_file",
    partition: str | None = "year",
) -> DataFrame:
    """Rows whose key, partition and hash are not all present already.

    The stored side is limited to the partitions the batch touches by a semi-join on
    the partition column, which prunes the scan of a partitioned table.  NULL
    partition values are equal; a NULL stored hash never counts as unchanged.
    """
    columns = [key, CONTENT_HASH] + ([partition] if partition else [])
    known = existing.select(*columns)
    if partition:
        dated = known.join(df.select(partition).distinct(), partition, "left_semi")
        known = dated.unionByName(known.filter(F.col(partition).isNull()))
    known = known.select(*[F.col(c).alias(f"_old_{c}") for c in columns])
    same = F.col(key) == F.col(f"_old_{key}")
    if partition:
        same = same & F.col(partition).eqNullSafe(F.col(f"_old_{partition}"))
    same = same & F.col(CONTENT_HASH).eqNullSafe(F.col(f"_old_{CONTENT_HASH}"))
    return df.join(known, same, "left_anti")


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str | Sequence[str],
    update_when: str | None = None,
    evolve: bool = True,
) -> DataFrame:
    """Update all columns of matched rows, insert the others.

    ``update_when`` is a SQL condition over ``t`` (target) and ``s`` (source); a
    matched row that fails it keeps the stored values.  With ``evolve`` columns
    seen on one side only are kept, as NULL on the other.  ``source`` must hold
    at most one row per key; NULL key parts are equal.
    """
    keys = _keys(key)
    columns = list(target.columns)
    if evolve:
        columns += [c for c in source.columns if c not in target.columns]
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = t.join(s, on, "full_outer")
    matched = F.col("t._in_t").isNotNull() & F.col("s._in_s").isNotNull()
    takes = F.col("s._in_s").isNotNull()
    if update_when is not None:
        takes = takes & (~matched | F.coalesce(F.expr(update_when), F.lit(False)))

    def merged(name: str) -> Column:
        old = F.col(f"t.{name}") if name in target.columns else F.lit(None)
        if name not in source.columns:
            # Not supplied by this batch: matched rows keep what they had.
            return old.alias(name)
        return F.when(takes, F.col(f"s.{name}")).otherwise(old).alias(name)

    return joined.select(*[merged(c) for c in columns])


def _with_preimages(changed: DataFrame) -> DataFrame:
    """Every update twice, as the image before it and the one after."""
    both = F.array(F.lit(PREIMAGE), F.lit("update_postimage"))
    kinds = F.when(F.col("_change_type") == "update_postimage", both).otherwise(F.array("_change_type"))
    return changed.withColumn("_change_type", F.explode(kinds))


def change_rows(
    old: DataFrame,
    new: DataFrame,
    key: str | Sequence[str],
    exclude: Sequence[str] = ("updated",),
    preimages: bool = False,
) -> DataFrame:
    """Difference of two versions of a table as change rows.

    Rows are ``new`` columns plus ``_change_type`` (``insert``,
    ``update_postimage`` or ``delete``); rows with equal content yield nothing.
    With ``preimages`` an update also yields the row it replaces, as ``update_preimage``.
    """
    keys = _keys(key)
    columns = list(new.columns) + [c for c in old.columns if c not in new.columns]

    def widened(df: DataFrame, other: DataFrame) -> DataFrame:
        missing = [f for f in other.schema.fields if f.name not in df.columns]
        return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])

    before = with_content_hash(widened(old, new), exclude).alias("o")
    after = with_content_hash(widened(new, old), exclude).alias("n")
    joined = before.join(after, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    kind = (
        F.when(F.col(f"o.{CONTENT_HASH}").isNull(), "insert")
        .when(F.col(f"n.{CONTENT_HASH}").isNull(), "delete")
        .when(F.col(f"o.{CONTENT_HASH}") != F.col(f"n.{CONTENT_HASH}"), "update_postimage")
    )
    changed = joined.withColumn("_change_type", kind).filter(F.col("_change_type").isNotNull())
    if preimages:
        changed = _with_preimages(changed)
    return (
        changed.select(
            *[
                F.when(F.col("_change_type").isin("delete", PREIMAGE), F.col(f"o.{c}"))
                .otherwise(F.col(f"n.{c}"))
                .alias(c)
                for c in columns
            ],
            "_change_type",
        )
    )


def _pairs(keys: Sequence[str], null_keys: bool) -> list[Column]:
    """Conditions that pair rows of ``s`` and ``t`` by key, NULL parts being equal.

    Where ``t`` is known to have no NULL in its key, plain equality pairs the same rows, and
    by that rows which lie by their key already, as newest images do, are not dealt anew.
    """
    sides = [(F.col(f"s.{k}"), F.col(f"t.{k}")) for k in keys]
    return [a.eqNullSafe(b) if null_keys else a == b for a, b in sides]


def _differ(a: Column, b: Column, kind: str) -> Column:
    if "map<" in kind:  # maps are not comparable
        a, b = F.to_json(a), F.to_json(b)
    return ~a.eqNullSafe(b)


def upsert_changes(
    target: DataFrame | None,
    source: DataFrame,
    key: str | Sequence[str],
    update_when: str | None = None,
    exclude: Sequence[str] = ("updated",),
    preimages: bool = False,
    null_keys: bool = True,
) -> DataFrame:
    """The change rows that :func:`upsert` makes, by one join from the source's side.

    Columns that the source lacks keep their values; ``exclude`` columns alone are no change.
    ``preimages`` as for :func:`change_rows`.  Without ``null_keys`` no key of the target has a NULL.
    """
    keys = _keys(key)
    if target is None:
        return source.withColumn("_change_type", F.lit("insert"))
    kinds = {f.name: f.dataType.simpleString() for f in [*source.schema.fields, *target.schema.fields]}
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    joined = source.alias("s").join(t, _pairs(keys, null_keys), "left")

    def old(name: str) -> Column:
        return F.col(f"t.{name}") if name in target.columns else F.lit(None).cast(kinds[name])

    def new(name: str) -> Column:
        return F.col(f"s.{name}") if name in source.columns else old(name)

    compared = [_differ(new(c), old(c), kinds[c]) for c in kinds if c not in {*keys, *exclude, CONTENT_HASH}]
    changed = any_of(compared)
    if update_when is not None:
        changed = changed & F.coalesce(F.expr(update_when), F.lit(False))
    kind = F.when(F.col("t._in_t").isNull(), "insert").when(changed, "update_postimage")
    columns = [*target.columns, *[c for c in source.columns if c not in target.columns]]
    rows = joined.withColumn("_change_type", kind).filter(F.col("_change_type").isNotNull())
    if preimages:
        rows = _with_preimages(rows)
        before = F.col("_change_type") == PREIMAGE
        return rows.select(*[F.when(before, old(c)).otherwise(new(c)).alias(c) for c in columns], "_change_type")
    return rows.select(*[new(c).alias(c) for c in columns], "_change_type")


def replace_changes(
    target: DataFrame,
    source: DataFrame,
    touched: DataFrame,
    key: str | Sequence[str],
    by: str,
    exclude: Sequence[str] = ("updated",),
    preimages: bool = False,
    null_keys: bool = True,
) -> DataFrame:
    """The change rows of replacing all rows whose ``by`` is in ``touched`` with ``source``.

    Equal to :func:`change_rows` of those rows and the source, but the whole table meets the
    source by key first, and only then are the stored groups looked up, so every image
    is dealt once by key and what was found once by group.  ``null_keys`` as for
    :func:`upsert_changes`.
    """
    keys = _keys(key)
    kinds = {f.name: f.dataType.simpleString() for f in [*target.schema.fields, *source.schema.fields]}
    columns = [*source.columns, *[c for c in target.columns if c not in source.columns]]
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    stored, given = F.col("t._in_t").isNotNull(), F.col("s._in_s").isNotNull()

    def side(name: str, df: DataFrame, alias: str) -> Column:
        return F.col(f"{alias}.{name}") if name in df.columns else F.lit(None).cast(kinds[name])

    old = {c: side(c, target, "t") for c in columns}
    new = {c: side(c, source, "s") for c in columns}
    differs = any_of([_differ(new[c], old[c], kinds[c]) for c in columns if c not in {*exclude, CONTENT_HASH}])
    met = s.join(t, _pairs(keys, null_keys), "full_outer").select(
        *[F.when(given, new[c]).otherwise(old[c]).alias(c) for c in columns],
        given.alias("_given"),
        stored.alias("_stored"),
        differs.alias("_differs"),
        F.when(stored, old[by]).otherwise(new[by]).alias("_group"),
        *([F.struct(*[old[c].alias(c) for c in columns]).alias("_before")] if preimages else []),
    )
    groups = touched.select(F.col(by).alias("_touched")).distinct().withColumn("_hit", F.lit(True))
    found = met.join(groups, F.col("_group").eqNullSafe(F.col("_touched")), "left")
    replaced = F.col("_stored") & F.col("_hit").isNotNull()
    kind = (
        F.when(~F.col("_given"), F.when(replaced, "delete"))
        .when(~replaced, "insert")
        .when(F.col("_differs"), "update_postimage")
    )
    changed = found.withColumn("_change_type", kind).filter(F.col("_change_type").isNotNull())
    if preimages:
        changed = _with_preimages(changed)
        before = F.col("_change_type") == PREIMAGE
        return changed.select(
            *[F.when(before, F.col(f"_before.{c}")).otherwise(F.col(c)).alias(c) for c in columns], "_change_type"
        )
    return changed.select(*columns, "_change_type")


def merge_reports(
    target: DataFrame, batch: DataFrame, key: str = "source_file", partition: str | None = "year"
) -> tuple[DataFrame, DataFrame]:
    """Merge extracted rows by content: ``(new table, rows that changed it)``.

    An identical batch changes nothing.  A stored row without a hash is updated
    once, which fills it in.
    """
    hashed = with_content_hash(batch)
    if CONTENT_HASH not in target.columns:
        target = target.withColumn(CONTENT_HASH, F.lit(None).cast("string"))
    changed = drop_unchanged(hashed, target, key, partition)
    keys = [key] + ([partition] if partition else [])
    return upsert(target, changed, keys), changed


def latest_changes(feed: DataFrame, key: str = "primary_report_identifier") -> DataFrame:
    """Newest inserted or updated image per key, without the bookkeeping columns."""
    images = feed.filter(F.col("_change_type").isin(*UPSERTS))
    newest = newest_per(images, key, [F.desc("_commit_version")])
    return newest.drop(*CHANGE_COLUMNS, CONTENT_HASH)


def require_key(
    df: DataFrame, key: str = "accession_number", observed: Observation | None = None
) -> DataFrame:
    """Rows with a key that is neither NULL nor blank.

    ``observed`` gets the number of rows that are ``kept`` and ``dropped`` as the rows
    pass by, without another read.
    """
    usable = has_text(F.col(key))
    if observed is not None:
        df = df.observe(observed, F.count_if(usable).alias("kept"), F.count_if(~usable).alias("dropped"))
    return df.filter(usable)


def dedupe_newest(
    df: DataFrame,
    key: str = "accession_number",
    order: str = "message_dt",
    tiebreak: Sequence[str] = ("primary_report_identifier",),
) -> DataFrame:
    """Newest row per usable key; ties go to the largest tiebreak value."""
    return newest_per(require_key(df, key), key, [F.desc(order), *[F.desc(t) for t in tiebreak]])


def maintain_latest(
    target: DataFrame | None,
    changes: DataFrame,
    key: str = "accession_number",
    order: str = "message_dt",
    tiebreak: Sequence[str] = ("primary_report_identifier",),
) -> DataFrame:
    """Newest row per key after the changes; an equal date keeps the stored row."""
    incoming = dedupe_newest(changes, key, order, tiebreak)
    if target is None:
        return incoming
    return upsert(target, incoming, key, f"s.{order} > t.{order}")


def explode_dx(
    df: DataFrame, dx: str = "diagnoses", report: str = "primary_report_identifier"
) -> DataFrame:
    """One row per diagnosis; a report without diagnoses yields none."""
    fields = df.schema[dx].dataType.elementType.fieldNames()
    rows = df.select("*", F.posexplode(dx).alias("_index", "_dx"))
    return rows.select(
        *[c for c in df.columns if c not in (dx, "diagnoses_consolidated")],
        *[F.col(f"_dx.{f}").alias(f) for f in fields],
        F.concat_ws("_", F.col(report), F.col("_index")).alias("diagnosis_id"),
    )


def delete_matched(target: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    on = _keys(on)
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def replace_dx(
    target: DataFrame | None,
    changes: DataFrame,
    key: str = "accession_number",
    dx: str = "diagnoses",
    order: str = "message_dt",
    report: str = "primary_report_identifier",
) -> DataFrame:
    """Replace the diagnosis rows of every touched key as a set."""
    newest = dedupe_newest(changes, key, order, (report,))
    rows = explode_dx(newest, dx, report)
    if target is None:
        return rows
    return delete_matched(target, newest, key).unionByName(rows, allowMissingColumns=True)


def top_up(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key the target lacks, shaped like the target."""
    fresh = source.join(target.select(key), key, "left_anti")
    return fresh.select(
        *[
            (F.col(f.name) if f.name in source.columns else F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            for f in target.schema.fields
        ]
    )


def write_back(
    target: DataFrame,
    values: DataFrame,
    key: str,
    columns: Sequence[str],
    stamp: str | None = None,
    stamp_value: Column | None = None,
) -> DataFrame:
    """Set some columns of matched rows; columns the target lacks are added.

    ``stamp`` names a column that records when a row was written.
    """
    given = values.select(key, *columns).withColumn("_given", F.lit(True)).alias("v")
    joined = target.alias("t").join(given, F.col(f"t.{key}") == F.col(f"v.{key}"), "left")
    matched = F.col("v._given").isNotNull()
    when = F.current_timestamp() if stamp_value is None else stamp_value
    replaced = {c: F.col(f"v.{c}") for c in columns}
    if stamp is not None:
        replaced[stamp] = when

    def value(name: str) -> Column:
        if name not in replaced:
            return F.col(f"t.{name}").alias(name)
        if name in target.columns:
            return F.when(matched, replaced[name]).otherwise(F.col(f"t.{name}")).alias(name)
        return F.when(matched, replaced[name]).alias(name)

    return joined.select(
        *[value(c) for c in target.columns],
        *[value(c) for c in replaced if c not in target.columns],
    )


def compact(df: DataFrame, key: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition and sort on the key, so files carry narrow key ranges."""
    keys = _keys(key)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


# Columns of the follow-up working copy and its typed outputs.
WORKING_COLUMNS = (
    "primary_report_identifier",
    "accession_number",
    "report_text",
    "modality",
    "service_name",
    "service_identifier",
    "message_dt",
    "patient_age",
    "sex",
    "race",
    "sending_facility",
    "diagnoses",
    "principal_result_interpreter",
)
WORKING_OUTPUTS = {
    "followup_detected": "boolean",
    "followup_confidence": "string",
    "followup_snippet": "string",
    "followup_finding": "string",
    "followup_processed_at": "timestamp",
}


def working_copy(
    df: DataFrame,
    columns: Sequence[str] = WORKING_COLUMNS,
    outputs: dict[str, str] | None = None,
    existing: DataFrame | None = None,
    processed: str = "followup_processed_at",
    recreate: bool = False,
) -> DataFrame:
    """Selected columns plus empty output columns.

    Refuses to replace an ``existing`` copy that already holds processed rows,
    unless ``recreate`` says so.
    """
    if existing is not None and not recreate:
        if not existing.filter(F.col(processed).isNotNull()).isEmpty():
            raise RuntimeError("the working copy already holds processed rows")
    outputs = WORKING_OUTPUTS if outputs is None else outputs
    return df.select(
        *columns, *[F.lit(None).cast(kind).alias(name) for name, kind in outputs.items()]
    )
