"""Hierarchical signatures: which id ranges of a slice differ, however many there are and wherever they lie.

The ids of a slice, from the least to the greatest of either side, are cut into 2 ** levels ranges of
equal width. Each side is read once and summed by range in map tasks; a range's signature is
mergeable, so that the sums of two neighbours are the signature of their parent. Both sides are joined
by range and only ranges that differ are kept, so one descent takes the place of ``levels`` probes,
and it finds changes at both ends of a table as well as a tail. Where ids are spread unevenly one range may hold most of
a slice: ranges that differ and hold over ``UNEVEN`` times their share of it are cut again, between their own least
and greatest ids, by one more scan of each side for all of them. A round divides the spans by 2 ** levels, so
there are at most 65 / levels of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators import diff
from deltaloom.sources.staging import stage

RANGE = "_range"
#: Times its share of a slice's rows that a range may hold.
UNEVEN = 4


def number(id_: str, low: Column, high: Column, levels: int) -> Column:
    """The range that an id between ``low`` and ``high`` lies in, from 0 to 2 ** levels - 1."""
    span = lambda c: c.cast("decimal(20,0)")  # noqa: E731 - differences of 64-bit ids need 65 bits
    width = F.ceil((span(high) - span(low) + 1) / F.lit(1 << levels))
    return F.floor((span(F.col(f"`{id_}`")) - span(low)) / width).cast("long")


def ranged(df: DataFrame, id_: str, spans: DataFrame, keys: Sequence[str], levels: int, small: bool, how: str = "inner") -> DataFrame:
    """Rows of the slices of ``spans`` (keys, low, high) with their range; rows without an id are in range -1. Ranges of a
    range (``keys`` has it) are numbered by a hash: two of one number are but one slice. Other rows, which
    ``how`` = left keeps, stay in the range that they have, if any."""
    held = spans.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys], F.col("low").alias("_low"), F.col("high").alias("_high"), F.lit(True).alias("_cut"))
    if keys:
        joined = df.join(F.broadcast(held) if small else held, [F.col(f"`{k}`").eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    else:
        joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(held.withColumn("_two", F.lit(1))), F.col("_one") == F.col("_two"), how)
    at = F.coalesce(number(id_, F.col("_low"), F.col("_high"), levels), F.lit(-1))
    nested = RANGE in keys
    at = F.when(F.col("_cut"), F.xxhash64(F.col(RANGE), at) if nested else at).otherwise(F.col(RANGE) if nested else F.lit(None).cast("long"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != RANGE], at.alias(RANGE))


def _uneven(fine: DataFrame, spans: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(parts, range, low, high) of the ranges to merge that hold too many of their slice's rows, and more than one id."""
    held = spans.select(*[F.col(f"`{p}`").alias(f"_r_{p}") for p in parts], "share", F.lit(1).alias("_two"))
    on = [F.col(f"`{p}`").eqNullSafe(F.col(f"_r_{p}")) for p in parts] or [F.col("_one") == F.col("_two")]
    rows = F.coalesce("src_cnt", F.lit(0)) + F.coalesce("dst_cnt", F.lit(0))
    cut = diff.span(fine.filter(_splits()).withColumn("_one", F.lit(1))).join(held, on).filter((rows > UNEVEN * F.col("share")) & (F.col("low") < F.col("high")))
    return stage(cut.select(*[F.col(f"`{p}`") for p in parts], RANGE, "low", "high"), "spans")


def _splits() -> Column:
    return F.col("method").isin(diff.MERGE, diff.DELETE_MERGE) & F.col("src_min").isNotNull() & F.col("dst_min").isNotNull()


def refined(
    plan: DataFrame, src: DataFrame, dst: DataFrame, id_: str, parts: Sequence[str], rule: tuple, levels: int, exact: bool, hashed: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, src, dst) with slices to merge cut into ranges: a row of the plan for each range, ``_range`` null for
    slices that stay whole. One more scan of each side, of the slices to merge only, and one for each
    round of ranges that hold too many rows, of these only."""
    share = F.greatest(F.lit(1.0), (F.coalesce("src_cnt", F.lit(0)) + F.coalesce("dst_cnt", F.lit(0))) / F.lit(1 << levels))
    spans = stage(diff.span(plan.filter(_splits())).select(*[F.col(f"`{p}`") for p in parts], "low", "high", share.alias("share")), "spans")
    n = spans.count()
    keys = [*parts, RANGE]
    whole = plan.filter(~F.coalesce(_splits(), F.lit(False))).withColumn(RANGE, F.lit(None).cast("long"))
    if not n:
        return whole.select(*[F.col(f"`{k}`") for k in keys], *[c for c in plan.columns if c not in parts]), *(
            x.withColumn(RANGE, F.lit(None).cast("long")) for x in (src, dst)
        )
    found, cut, on, rounds = None, spans, list(parts), -(-65 // levels)
    while n:
        small = n <= diff.SMALL_PLAN
        fine = diff.diff(*(ranged(x, id_, cut, on, levels, small) for x in (src, dst)), [id_], keys, *rule, probe=False, exact=exact, hashed=hashed)
        src, dst = (ranged(x, id_, cut, on, levels, small, "left") for x in (src, dst))
        if found is not None:
            gone = cut.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys])
            fine = found.join(gone, [F.col(f"`{k}`").eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left_anti").unionByName(fine)
        found, on, rounds = fine, keys, rounds - 1
        cut = _uneven(found, spans, parts) if rounds else None
        n = cut.count() if rounds else 0
    return stage(whole.select(*found.columns).unionByName(found), "plan"), src, dst
