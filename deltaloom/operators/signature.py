"""Signatures: cheap aggregates of a table or of each of its partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions.types import DiffColumn, diff_columns


def id_columns(ids: Sequence[str], exact: bool = True) -> list[DiffColumn]:
    """Aliases of the statistics of a single id: unique (if ``exact``), non-null, greatest and least."""
    if len(ids) != 1:
        return []
    i = ids[0]
    return [
        *([DiffColumn("COUNT", i, alias=f"unique_cnt_{i}")] if exact else []),
        DiffColumn("COUNT", i, alias=f"non_null_cnt_{i}"),
        DiffColumn("MAX", i, alias=f"max_{i}"),
        DiffColumn("MIN", i, alias=f"min_{i}"),
    ]


def plan_columns(
    df: DataFrame,
    ids: Sequence[str] = (),
    parts: Sequence[str] = (),
    columns: Sequence[DiffColumn] | None = None,
    count_only: bool = False,
    precision: int = 5,
    date_format: str | None = None,
    exact: bool = True,
) -> list[DiffColumn]:
    """The aggregates of a signature: rows, the single id's statistics, then one for each column.

    ``exact`` counts distinct values and ids, each with a shuffle of its own; otherwise every
    aggregate is merged from partial ones and nothing else is shuffled.

    Partition columns are dimensions and are not aggregated. Custom columns replace the standard
    ones; unless one of them is called ``cnt`` the rows and the id are counted as well.
    """
    base = [DiffColumn("COUNT", "1", alias="cnt"), *id_columns(ids, exact)]
    if count_only:
        return base
    if columns:
        own = [c for c in columns if c.name.lower() not in {p.lower() for p in parts}]
        return own if any(c.label == "cnt" for c in own) else base + own
    return base + diff_columns(df, list(parts), precision, date_format, exact)


def aggregates(df: DataFrame, columns: Sequence[DiffColumn], where: Column | None = None) -> list[Column]:
    """The columns' aggregates by label, over the rows that satisfy ``where``."""
    types = {f.name.lower(): f.dataType for f in df.schema}
    out = []
    for c in columns:
        source = None if c.name == "1" else F.col(f"`{c.name}`")
        if where is not None:
            source = F.when(where, F.lit(1) if source is None else source)
        if c.label.startswith("non_null_cnt_"):
            made = F.count(source)
        elif c.name == "1":
            made = F.count(F.lit(1) if source is None else source)
        elif where is not None and c.default is not None:
            kept = DiffColumn(c.func, c.name, c.alias, None, c.precision, c.date_format)
            filled = F.when(where, F.coalesce(F.col(f"`{c.name}`"), F.lit(c.default)))
            made = kept.column(types.get(c.name.lower()), filled)
        else:
            made = c.column(types.get(c.name.lower()), source)
        out.append(made.alias(c.label))
    return out


def signature(df: DataFrame, columns: Sequence[DiffColumn], parts: Sequence[str] = ()) -> DataFrame:
    """One row for each partition (for all rows if there are no partition columns)."""
    made = aggregates(df, columns)
    return df.groupBy(*[F.col(f"`{p}`") for p in parts]).agg(*made) if parts else df.agg(*made)


def count_signature(df: DataFrame, ids: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """Rows, and the least and greatest id if there is exactly one id column."""
    made = [F.count(F.lit(1)).alias("cnt")]
    if len(ids) == 1:
        made += [F.min(ids[0]).alias("min_id"), F.max(ids[0]).alias("max_id")]
    return df.groupBy(*parts).agg(*made) if parts else df.agg(*made)


def row_hash_signature(df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Rows and an order-free sum of row hashes: sees swapped values, which other sums miss."""
    cols = [
        F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    made = [
        F.count(F.lit(1)).alias("cnt"),
        F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).alias("hash_sum"),
    ]
    return df.groupBy(*parts).agg(*made) if parts else df.agg(*made)


def fold(signatures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Several signatures (cnt, min_id, max_id) as one: least, greatest and sum."""
    made = [
        F.sum("cnt").cast("long").alias("cnt"),
        F.min("min_id").alias("min_id"),
        F.max("max_id").alias("max_id"),
    ]
    return signatures.groupBy(*by).agg(*made) if by else signatures.agg(*made)


def single(df: DataFrame):
    """The only row of a scalar signature; None if there is none, an error if there are more."""
    found = df.take(2)
    if len(found) > 1:
        raise ValueError("a scalar signature has more than one row")
    return found[0] if found else None


def fold_records(records: DataFrame, folds: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """sum, max or min of named columns; a column that the records lack is skipped."""
    known = {"sum": F.sum, "max": F.max, "min": F.min}
    have = {c.lower() for c in records.columns}
    made = [known[f](F.col(f"`{c}`")).alias(f"{f}_{c}") for c, f in folds.items() if c.lower() in have]
    return records.groupBy(*by).agg(*made) if by else records.agg(*made)


def id_consistency(df: DataFrame, id_: str, parts: Sequence[str] = ()) -> DataFrame:
    """``problem`` of an id column: null (none), 'null' or 'duplicate'."""
    cols = plan_columns(df, [id_], count_only=True)
    s = signature(df, cols, parts)
    unique, filled = F.col(f"unique_cnt_{id_}"), F.col(f"non_null_cnt_{id_}")
    return s.withColumn(
        "problem",
        F.when(F.col("cnt") == unique, F.lit(None))
        .when(F.col("cnt") != filled, F.lit("null"))
        .otherwise(F.lit("duplicate")),
    )
