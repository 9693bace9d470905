"""What is read from each side: columns, pseudo-columns, sources given as queries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.criteria import translated


def explicit(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """Columns of ``df`` that are named, whatever their case, in the table's order."""
    if not columns:
        return df.columns
    want = {c.lower() for c in columns}
    return [c for c in df.columns if c.lower() in want]


def with_pseudo(df: DataFrame, pseudo: Mapping[str, str] | None) -> DataFrame:
    """``df`` with named expressions; columns in them may be written with the alias ``t.``"""
    if not pseudo:
        return df
    return df.alias("t").select("t.*", *[F.expr(translated(e)).alias(n) for n, e in pseudo.items()])


def sync_projection(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None, pseudo: Mapping[str, str] | None = None
) -> DataFrame:
    """Ids first, then the other columns of the sync; pseudo-columns replace columns they name."""
    names = [c for c in explicit(df, columns) if c.lower() not in {i.lower() for i in ids}]
    exprs = {k.lower(): e for k, e in (pseudo or {}).items()}

    def one(c: str):
        e = exprs.get(c.lower())
        return F.expr(translated(e)).alias(c) if e else F.col(f"t.`{c}`").alias(c)

    return df.alias("t").select(*[one(c) for c in [*ids, *names]])


def omit_empty(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Zeros and empty strings as null, except in the columns of ``keep``."""
    out = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in keep:
            continue
        if kind == "string":
            out[name] = F.when(c == "", None).otherwise(c)
        elif kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            out[name] = F.when(c == 0, None).otherwise(c)
    return df.withColumns(out) if out else df


def adapt_case(df: DataFrame, like: Sequence[str]) -> DataFrame:
    """Names in the other side's case if that is all upper or all lower; no column is dropped."""
    letters = "".join(like)
    change = str.upper if letters.isupper() else str.lower if letters.islower() else None
    return df.toDF(*[change(c) for c in df.columns]) if change else df


def staging_name(table: str, values: Mapping[str, object], suffix: str = "", database: str = "") -> str:
    """The name of a slice's staging table: the table, ``_tmp`` and the partition's values."""

    def text(v) -> str:
        v = v[0] if isinstance(v, list | tuple) and v else v
        if hasattr(v, "strftime"):
            return v.strftime("%Y%m%d%H%M%S")
        return re.sub(r"[-+]", "", str(v))

    own = "_tmp" + "".join("_" + text(v) for v in values.values())
    name = re.sub(r"[ \-:\t]", "_", f"{table}{'_' + suffix.lstrip('_') if suffix else ''}{own}")
    return f"{database}.{name}" if database else name
