"""Applying a slice: every operator takes frames and returns the new destination.

``t`` holds the staged rows, ``d`` the destination. Nothing is changed in place, so an apply is
one plan that ends in one commit. Ids must not be null (checked before a sync), and with that
anti-joins mean what NOT IN means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.compare import fit

STRATEGIES = ("insert", "merge", "deleteMerge", "deleteInsert")


def dedupe_max(t: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row for each id: the greatest value of each column on its own."""
    if not ids:
        return t
    rest = [c for c in t.columns if c not in ids]
    made = [F.max(f"`{c}`").alias(c) for c in rest]
    out = t.groupBy(*ids).agg(*made) if made else t.select(*ids).distinct()
    return out.select(*t.columns)


def dedupe_latest(t: DataFrame, ids: Sequence[str], by: str) -> DataFrame:
    """One whole row for each id: that with the greatest ``by``."""
    row = F.max_by(F.struct(*t.columns), F.col(by)).alias("r")
    return t.groupBy(*ids).agg(row).select("r.*")


def _true(where: Column | None) -> Column:
    return F.lit(True) if where is None else F.coalesce(where, F.lit(False))


def transient_delete(t: DataFrame, d: DataFrame, ids: Sequence[str], where: Column | None = None) -> DataFrame:
    """Staged rows without those whose id the destination (under ``where``) already has."""
    return t.join(d.filter(_true(where)).select(*ids), list(ids), "left_anti").select(*t.columns)


def without(d: DataFrame, keys: DataFrame) -> DataFrame:
    """``d`` without the rows whose values of the columns of ``keys`` are a row of it, nulls alike."""
    on = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in keys.columns]
    return d.alias("d").join(keys.alias("k"), on, "left_anti")


def append(d: DataFrame, t: DataFrame) -> DataFrame:
    """Both; staged values that do not fit the destination's types are an error when rows are read."""
    return d.unionByName(fit(t, d.schema), allowMissingColumns=True).select(*d.columns)


def insert_new(d: DataFrame, t: DataFrame, ids: Sequence[str], where: Column | None = None) -> DataFrame:
    """Adds the deduplicated staged rows whose ids are new; without ids, all of them."""
    if not ids:
        return append(d, t)
    return append(d, transient_delete(dedupe_max(t, ids), d, ids, where))


def upsert(d: DataFrame, t: DataFrame, ids: Sequence[str], where: Column | None = None) -> DataFrame:
    """Destination rows whose id is staged are replaced, other staged rows are added.

    With ``where`` only destination rows under it match; staged rows that match none are added,
    whatever rows outside it have their id. The destination is only anti-joined with the staged
    ids: a small slice is broadcast and the destination is not shuffled. Columns that the slice
    lacks keep the destination's values.
    """
    t = dedupe_max(t, ids)
    lacking = [c for c in d.columns if c.lower() not in {x.lower() for x in t.columns}]
    if lacking and where is None:
        return upsert_columns(d, t, ids)
    outside = d.limit(0) if where is None else d.filter(~_true(where))
    inside = d if where is None else d.filter(_true(where))
    kept = inside.join(t.select(*ids), list(ids), "left_anti").select(*d.columns)
    return append(kept if where is None else kept.unionByName(outside), t)


def upsert_columns(d: DataFrame, t: DataFrame, ids: Sequence[str]) -> DataFrame:
    """As ``upsert`` for a slice with a subset of columns: others keep the destination's values."""
    t = dedupe_max(t, ids)
    have = {c.lower() for c in t.columns}
    j = d.alias("d").join(t.withColumn("_staged", F.lit(True)).alias("t"), list(ids), "full_outer")
    pick = [
        F.col(c)
        if c in ids
        else F.when(F.col("_staged"), F.col(f"t.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
        if c.lower() in have
        else F.col(f"d.{c}")
        for c in d.columns
    ]
    return j.select(*pick)


def delete_missing(d: DataFrame, t: DataFrame, ids: Sequence[str], where: Column | None = None) -> DataFrame:
    """Drops rows under ``where`` whose id is not staged; without ids, all rows under it."""
    inside = _true(where)
    kept = d.filter(~inside)
    if not ids:
        return kept
    return kept.unionByName(d.filter(inside).join(t.select(*ids).distinct(), list(ids), "left_semi").select(*d.columns))


def filtered_delete(d: DataFrame, where: Column | None) -> DataFrame:
    if where is None:
        raise ValueError("a filtered delete needs a filter")
    return d.filter(~F.coalesce(where, F.lit(False)))


def delete_insert(d: DataFrame, t: DataFrame, ids: Sequence[str], where: Column | None = None) -> DataFrame:
    """Replaces what is under ``where`` by the staged rows."""
    if not ids:
        return append(delete_missing(d, t, ids, where), t)
    return insert_new(delete_missing(d, t, ids, where), t, ids)


def delete_merge(d: DataFrame, t: DataFrame, ids: Sequence[str], where: Column | None = None) -> DataFrame:
    """Deletes what the slice no longer has, then upserts it."""
    return upsert(delete_missing(d, t, ids, where), t, ids)


def apply(
    d: DataFrame,
    t: DataFrame,
    method: str,
    ids: Sequence[str] = (),
    where: Column | None = None,
    append_only: bool = False,
    append_update_only: bool = False,
) -> DataFrame:
    """The new destination by strategy name; the overrides never delete, the first never updates."""
    if method not in STRATEGIES:
        raise ValueError(f"unknown merge method: {method!r}")
    if append_update_only:
        return upsert(d, t, ids)
    if append_only:
        base = delete_missing(d, t, ids, where) if method.startswith("delete") else d
        return insert_new(base, t, ids)
    return {
        "insert": lambda: insert_new(d, t, ids),
        "merge": lambda: upsert(d, t, ids),
        "deleteMerge": lambda: delete_merge(d, t, ids, where),
        "deleteInsert": lambda: delete_insert(d, t, ids, where),
    }[method]()


#: Upserts by name: they differ in what a filter means (``merge``: which rows match; ``insertOrReplace``: which are
#: inserted; the others have none).
UPSERTS = ("insertOrReplace", "insertOnDuplicateUpdate", "insertOnConflictUpdate", "merge", "mergeInto")
#: The upsert of each vendor.
MERGE_STYLES = {"mysql": "insertOnDuplicateUpdate", "sqlite3": "insertOrReplace", "oci8": "mergeInto", "ora": "mergeInto"}


def dml(kind: str, d: DataFrame, t: DataFrame | None, ids: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """One statement by name; ``transientDelete`` returns the staged rows that remain."""
    if t is None and kind != "filteredDelete":
        raise ValueError(f"{kind} needs a staged slice")
    if t is not None and kind == "insertOrReplace" and where is not None:
        t = t.filter(_true(where))  # its filter is on the rows inserted
    upserts = dict.fromkeys(UPSERTS, lambda: upsert(d, t, ids)) | {"merge": lambda: upsert(d, t, ids, where)}
    known = upserts | {
        "insert": lambda: insert_new(d, t, ids, where),
        "append": lambda: append(d, dedupe_max(t, ids)),
        "delete": lambda: delete_missing(d, t, ids, where),
        "transientDelete": lambda: transient_delete(t, d, ids, where),
        "filteredDelete": lambda: filtered_delete(d, where),
    }
    if kind not in known:
        raise ValueError(f"unknown statement: {kind!r}")
    return known[kind]()
