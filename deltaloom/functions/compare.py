"""Alignment of two sides and equality with tolerances."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions.types import NUMERIC, TIME, DiffColumn, rounded


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` cast to the other side's types; names match whatever their case."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType).alias(f.name)
            for f in schema
            if f.name.lower() in have
        ]
    )


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """As ``align``, for rows that are to be stored: a value that does not fit is an error, never null.

    Fractions do not fit integers; nulls fit everything. The error comes when the rows are read.
    """
    have = {c.lower(): f for c, f in zip(df.columns, df.schema, strict=True)}
    return df.select(*[fitted(have[f.name.lower()], f).alias(f.name) for f in schema if f.name.lower() in have])


def fitted(source: T.StructField, to: T.StructField) -> Column:
    """A column cast to the other side's type; raises for a value that the type cannot hold."""
    c, kind = F.col(f"`{source.name}`"), to.dataType
    if source.dataType == kind:
        return c
    cast = c.try_cast(kind)
    lost = cast.isNull() & c.isNotNull()
    if isinstance(kind, T.IntegralType) and isinstance(source.dataType, T.FractionalType):
        lost = lost | (cast.cast(source.dataType) != c)
    problem = F.concat(F.lit(f"column {to.name}: "), F.coalesce(c.try_cast("string"), F.lit("a value")), F.lit(f" does not fit {kind.simpleString()}"))
    return F.when(F.coalesce(lost, F.lit(False)), F.raise_error(problem).cast(kind)).otherwise(cast)


def similar(
    a: Column,
    b: Column,
    precision: int | None = None,
    date_format: str | None = None,
    truncate: bool = False,
) -> Column:
    """Equal, both null, or equal once rounded or formatted. Never null.

    Integers and fractions compare in the wider type; with ``truncate`` as integers (33.4 is 33).
    """
    same = a.eqNullSafe(b)
    if truncate:
        whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
        same = same | (whole(a) == whole(b))
    if precision is not None:
        # one of the branches is constant: doubles round as databases round them, decimals exactly
        fraction = F.typeof(a).isin("float", "double") | F.typeof(b).isin("float", "double")
        same = same | (fraction & (rounded(a, precision) == rounded(b, precision))) | (~fraction & (F.round(a, precision) == F.round(b, precision)))
    if date_format is not None:
        same = same | (F.date_format(a, date_format) == F.date_format(b, date_format))
    return F.coalesce(same, F.lit(False))


def in_sync(columns: list[DiffColumn], left: str = "src_", right: str = "dst_") -> Column:
    """Every aggregate of two joined signatures is similar."""
    parts = [
        similar(F.col(f"`{left}{c.label}`"), F.col(f"`{right}{c.label}`"), c.precision, c.date_format)
        for c in columns
    ]
    parts += [F.coalesce(f"{left}{c.label}", F.lit(0)) == 0 for c in columns if c.func.upper() == "ODDS"]
    return reduce(and_, parts, F.lit(True))


def record_similarity(a: DataFrame, b: DataFrame, ids: list[str], precision: int = 5, date_format: str | None = None) -> DataFrame:
    """The ids of both sides with a boolean for each shared column, and ``equal`` for all."""
    raw = b
    # a value that the other type cannot hold is not that side's null
    have = {c.lower(): c for c in raw.columns}
    b = raw.select(
        *[F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) for f in a.schema if f.name.lower() in have],
        *[
            (F.col(f"`{have[f.name.lower()]}`").isNotNull() & F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType).isNull()).alias(f"_odd_{f.name}")
            for f in a.schema
            if f.name.lower() in have and f.name not in ids
        ],
    )
    shared = [f for f in a.schema if f.name not in ids and f.name in b.columns]
    joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{i}").eqNullSafe(F.col(f"b.{i}")) for i in ids], "inner")

    def one(f: T.StructField) -> Column:
        return ~F.col(f"b._odd_{f.name}") & similar(
            F.col(f"a.{f.name}"),
            F.col(f"b.{f.name}"),
            precision if isinstance(f.dataType, NUMERIC) else None,
            date_format if isinstance(f.dataType, TIME) else None,
        )

    flags = {f.name: one(f) for f in shared}
    return joined.select(
        *[F.col(f"a.{i}").alias(i) for i in ids],
        *[c.alias(n) for n, c in flags.items()],
        reduce(and_, flags.values(), F.lit(True)).alias("equal"),
    )


def layout_for(layout: str, value: str) -> str:
    """The part of a date layout that a partition's text spells: cut to the text's length."""
    return layout[: len(value)]
