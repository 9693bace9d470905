"""How each Spark type takes part in a signature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
FRACTION, WHOLE = (T.FloatType, T.DoubleType), (T.ShortType, T.IntegerType, T.LongType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType)
#: Sums of fractions are exact, so that they do not depend on the order of rows: values below ``LARGE`` are added
#: as decimals, for 10 ** 14 rows without overflow; others, NaN and infinities have a sum of their own (ODD).
EXACT, LARGE = "decimal(28,8)", 1e16
#: Wider decimals could overflow a sum and are compared by hashes.
WIDEST = 28


def odd(value: Column) -> Column:
    """Whether a fraction takes no part in a sum: NaN, an infinity, or at least ``LARGE`` (whose rounding to any
    precision would mean nothing, doubles being two apart there)."""
    return F.isnan(value) | (F.abs(value) >= LARGE)


def rounded(value: Column, precision: int) -> Column:
    """A fraction rounded as SQL databases round doubles: scaled, rounded half away from zero and scaled back; itself
    where that overflows. (``F.round`` rounds the double's decimal text, in which 3.34 + 0.01 is below 3.35.)"""
    value, scale = value.cast("double"), F.lit(10.0 ** abs(precision))
    out = F.round(value * scale, 0) / scale if precision >= 0 else F.round(value / scale, 0) * scale
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), value).otherwise(out)


def whole_sum(value: Column, kind: T.DataType) -> Column:
    """The sum of an integer column as decimal(38,0). Parts of the number are summed as longs, which no number of
    rows below 2 ** 40 overflows, so nothing but codegen on longs runs for each row."""
    x, bits = value.cast("long"), {T.ShortType: 0, T.IntegerType: 16}.get(type(kind), 22)
    if not bits:
        return F.sum(x).cast("decimal(38,0)")
    mask = F.lit((1 << bits) - 1).cast("long")
    steps = 1 if bits == 16 else 2
    out = F.sum(F.shiftright(x, steps * bits)).cast("decimal(20,0)")
    for k in reversed(range(steps)):
        part = F.sum(F.shiftright(x, k * bits).bitwiseAND(mask)).cast("decimal(20,0)")
        out = (out * F.lit(1 << bits).cast("decimal(8,0)")).cast("decimal(38,0)") + part
    return out.cast("decimal(38,0)")


@dataclass(frozen=True)
class DiffColumn:
    """One aggregate of a signature: ``func`` over ``name``, called ``alias``.

    ``default`` stands for NULL; ``precision`` and ``date_format`` are the tolerances with which
    two sides are compared.
    """

    func: str
    name: str
    alias: str = ""
    default: object = None
    precision: int | None = None
    date_format: str | None = None

    @property
    def label(self) -> str:
        prefix = "cnt" if self.func.upper() == "COUNT" else self.func.lower()  # sum, max, hash, odd ...
        return self.alias or f"{prefix}_{self.name}"

    def column(self, dtype: T.DataType | None = None, source: Column | None = None) -> Column:
        """COUNT of 1 counts rows, any other COUNT counts distinct values (exact, at the cost of a shuffle of
        the column). HASH sums hashes of the values: mergeable, so that only sums are shuffled. ODD does so
        for the fractions that a SUM leaves out; ODDS, which every database has, only counts them, and a slice
        with any is never in sync."""
        func, col = self.func.upper(), F.col(f"`{self.name}`") if source is None else source
        if func == "COUNT" and self.name == "1":
            return F.count(F.lit(1))
        if isinstance(dtype, COMPLEX):
            col = F.xxhash64(F.to_json(col) if isinstance(dtype, T.MapType) else col)
        elif self.default is not None:
            col = F.coalesce(col, F.lit(self.default))
        if func == "COUNT":
            return F.count_distinct(col)
        if func == "HASH":
            return F.sum(F.xxhash64(col).cast("decimal(20,0)"))
        if func == "ODDS":
            return F.sum(F.when(odd(col), 1).otherwise(0)).cast("long") if isinstance(dtype, FRACTION) else F.max(F.lit(0).cast("long"))
        if func == "ODD":
            if not isinstance(dtype, FRACTION):
                return F.max(F.lit(0).cast("decimal(30,0)"))
            value = col.cast("double")
            return F.coalesce(F.sum(F.when(odd(value), F.xxhash64(value).cast("decimal(20,0)"))), F.lit(0).cast("decimal(30,0)"))
        if func == "SUM":
            if isinstance(dtype, FRACTION):
                return F.sum(F.coalesce(F.when(odd(col), F.lit(0)).otherwise(col).cast(EXACT), F.lit(0).cast(EXACT)))
            return whole_sum(col, dtype) if isinstance(dtype, WHOLE) else F.sum(col)
        if func in ("MAX", "MIN"):
            return F.max(col) if func == "MAX" else F.min(col)
        return F.call_function(func.lower(), col)


def diff_column(
    field: T.StructField, precision: int = 5, date_format: str | None = None, exact: bool = True
) -> DiffColumn:
    """The signature aggregate for a column's type: sums of numbers, the latest time, and for all else
    distinct values or, unless ``exact``, a sum of hashes (which also sees swapped values)."""
    kind = field.dataType
    if not exact and not isinstance(kind, (*NUMERIC, *TIME)):
        return DiffColumn("HASH", field.name)
    if isinstance(kind, T.BooleanType):
        return DiffColumn("COUNT", field.name, default=False)
    if isinstance(kind, T.ByteType):
        return DiffColumn("COUNT", field.name, default=0)
    if isinstance(kind, T.DecimalType) and kind.precision > WIDEST:
        return DiffColumn("HASH", field.name)
    if isinstance(kind, NUMERIC):
        return DiffColumn("SUM", field.name, default=0, precision=precision)
    if isinstance(kind, TIME):
        return DiffColumn("MAX", field.name, date_format=date_format)
    if isinstance(kind, COMPLEX):
        return DiffColumn("COUNT", field.name)
    if isinstance(kind, T.BinaryType):
        return DiffColumn("COUNT", field.name, default=b" ")
    return DiffColumn("COUNT", field.name, default=" ")


def diff_columns(
    df: DataFrame, skip: list[str] = (), precision: int = 5, date_format: str | None = None, exact: bool = True
) -> list[DiffColumn]:
    out = {s.lower() for s in skip}
    return [
        diff_column(f, precision, date_format, exact) for f in df.schema if f.name.lower() not in out
    ]


def odd_columns(columns: list[DiffColumn], *sides: DataFrame, func: str = "ODD") -> list[DiffColumn]:
    """An ODD (or ODDS) aggregate for each summed column that is a fraction on one of the sides."""
    fractions = {f.name.lower() for df in sides for f in df.schema if isinstance(f.dataType, FRACTION)}
    have = {c.name.lower() for c in columns if c.func.upper() in ("ODD", "ODDS")}
    names = dict.fromkeys(c.name for c in columns if c.func.upper() == "SUM" and c.name.lower() in fractions - have)
    return [DiffColumn(func, n) for n in names]


def row_hash(df: DataFrame, schema: T.StructType, precision: int | None = 5, date_format: str | None = None) -> Column:
    """A hash of a row's values of the columns of ``schema`` that it has, in the types of ``schema``; fractions and
    times are rounded and formatted as they are compared."""
    have = {c.lower(): c for c in df.columns}
    values = []
    for f in sorted(schema, key=lambda f: f.name.lower()):
        if f.name.lower() not in have:
            continue
        value = F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType)
        if isinstance(f.dataType, FRACTION) and precision is not None:
            value = F.when(odd(value), value).otherwise(rounded(value, precision) + 0.0)
        elif isinstance(f.dataType, TIME) and date_format is not None:
            value = F.date_format(value, date_format)
        elif isinstance(f.dataType, T.MapType):
            value = F.to_json(value)
        values.append(value)
    return F.xxhash64(*values) if values else F.lit(0).cast("long")
