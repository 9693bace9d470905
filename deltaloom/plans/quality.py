"""Recipes around a sync: comparing two sides by day, and their schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.compare import similar
from deltaloom.functions.types import EXACT


def compare_by_date(
    src: DataFrame, dst: DataFrame, date: str, sums: Sequence[str], precision: int = 2, zero_is_null: bool = False
) -> DataFrame:
    """Rows and sums by day on both sides, and whether they agree within ``precision`` places."""

    def daily(df: DataFrame, side: str) -> DataFrame:
        made = [
            F.round(F.sum(F.coalesce(F.col(c), F.lit(0)).cast(EXACT)).cast("double"), 2).alias(f"{side}_sum_{c}") for c in sums
        ]
        return df.groupBy(F.to_date(date).alias("d")).agg(F.count(F.lit(1)).alias(f"{side}_cnt"), *made)

    both = daily(src, "src").join(daily(dst, "dst"), "d", "full_outer")
    same = [F.coalesce(F.col("src_cnt") == F.col("dst_cnt"), F.lit(False))]
    for c in sums:
        a, b = F.col(f"src_sum_{c}"), F.col(f"dst_sum_{c}")
        if zero_is_null:
            a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
        same.append(similar(a, b, precision))
    return both.withColumn("equal", reduce(and_, same))


def compare_schemas(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(name, problem, src_type, dst_type) for each column that is missing or of another type."""
    a, b = ({f.name.lower(): f for f in df.schema} for df in (src, dst))
    rows = []
    for name in sorted(a.keys() | b.keys()):
        s, d = (x[name].dataType.simpleString() if name in x else None for x in (a, b))
        problem = (
            "missing in source" if s is None else "missing in destination" if d is None else "types differ" if s != d else None
        )
        if problem:
            rows.append((name, problem, s, d))
    return src.sparkSession.createDataFrame(rows, "name string, problem string, src_type string, dst_type string")


def days(first: date, last: date, step: int = 1) -> Iterator[tuple[date, date]]:
    """(from, to) of consecutive spans of ``step`` days from ``first`` to ``last``, both included."""
    if step < 1:
        raise ValueError("a span has at least one day")
    while first <= last:
        upto = min(last, first + timedelta(days=step - 1))
        yield first, upto
        first = upto + timedelta(days=1)


def over_dates(sync: Callable, make: Callable, first: date, last: date, step: int = 1) -> list:
    """Runs ``sync`` of the request that ``make`` gives for each span of days; stops at the first failure."""
    out = []
    for a, b in days(first, last, step):
        out.append(sync(make(a, b)))
        if out[-1].status == "error":
            break
    return out


def partition_values_agree(src: DataFrame, dst: DataFrame, parts: Sequence[str], index: Sequence[str]) -> DataFrame:
    """Partitions of both sides that are matched by ``index`` though their values of ``parts`` differ."""
    a = src.select(*index, *[F.col(p).alias(f"src_{p}") for p in parts if p not in index]).distinct()
    b = dst.select(*index, *[F.col(p).alias(f"dst_{p}") for p in parts if p not in index]).distinct()
    differ = [~F.col(f"src_{p}").eqNullSafe(F.col(f"dst_{p}")) for p in parts if p not in index]
    return a.join(b, list(index)).filter(reduce(lambda x, y: x | y, differ, F.lit(False)))
