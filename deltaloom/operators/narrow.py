"""Narrowing: the greatest id below which both sides agree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.compare import in_sync
from deltaloom.functions.types import DiffColumn
from deltaloom.operators.signature import signature
from deltaloom.sources.staging import stage, unstage


@dataclass
class IdRange:
    """Candidates of a bisection: up after a match, down after none, by a halving step."""

    low: int
    high: int
    value: int = field(init=False)
    step: int = field(init=False)

    def __post_init__(self):
        self.value, self.step = self.high, int((self.high - self.low) / 2)

    def next(self, matched: bool) -> int:
        self.value += self.step if matched else -self.step
        self.step = int(self.step / 2)
        return self.value


def max_in_sync(
    src: DataFrame, dst: DataFrame, id_: str, columns: Sequence[DiffColumn], low: int, high: int, depth: int
) -> int | None:
    """The last candidate c, of ``depth`` probes, for which all rows with ``id <= c`` agree."""
    one = src.sparkSession.createDataFrame([(low, high)], "low long, high long")
    return bisect(src, dst, id_, columns, one, [], depth).first()["at"]


def bisect(
    src: DataFrame, dst: DataFrame, id_: str, columns: Sequence[DiffColumn], spans: DataFrame, slices: Sequence[str], depth: int
) -> DataFrame:
    """For each slice of ``spans`` (the slice columns, low and high): at, the last candidate of ``depth``
    probes up to which both sides agree (null: none).

    Every round probes all slices at once: rows meet their slice's candidate and are aggregated
    by slice, so there is one job a round, whatever the number of slices. The candidates are
    those of ``IdRange``.
    """
    keys = list(slices) or ["_all"]
    if not slices:
        src, dst, spans = (x.withColumn("_all", F.lit(1)) for x in (src, dst, spans))
    half = F.expr("cast((high - low) / 2 as bigint)")
    state = spans.select(*keys, (F.col("high") - half).alias("value"), half.alias("step"), F.lit(None).cast("long").alias("at"))
    state = stage(state, "probes")
    own = [F.col(f"`{k}`").eqNullSafe(F.col(f"_s_{k}")) for k in keys]

    def side(df: DataFrame, state: DataFrame, prefix: str) -> DataFrame:
        probe = state.select(*[F.col(f"`{k}`").alias(f"_s_{k}") for k in keys], F.col("value").alias("_value"))
        below = df.join(probe, own).filter(F.col(id_) <= F.col("_value")).select(*df.columns)
        made = signature(below, columns, keys)
        return made.select(
            *[F.col(f"`{k}`").alias(f"_{prefix}{k}") for k in keys],
            *[F.col(f"`{c.label}`").alias(f"{prefix}{c.label}") for c in columns],
        )

    for _ in range(depth):
        out = state
        for df, prefix in ((src, "src_"), (dst, "dst_")):
            on = [F.col(f"`{k}`").eqNullSafe(F.col(f"_{prefix}{k}")) for k in keys]
            out = out.join(side(df, state, prefix), on, "left")
        # no rows on either side agree as well
        same = in_sync([c for c in columns if not c.label.startswith(("cnt", "non_null_cnt", "unique_cnt"))])
        counts = [c for c in columns if c.label.startswith(("cnt", "non_null_cnt", "unique_cnt"))]
        for c in counts:
            same = same & (F.coalesce(f"src_{c.label}", F.lit(0)) == F.coalesce(f"dst_{c.label}", F.lit(0)))
        step = F.expr("cast(step / 2 as bigint)")
        moved = out.withColumn("_same", same).select(
            *keys,
            (F.col("value") + F.when(F.col("_same"), step).otherwise(-step)).alias("value"),
            step.alias("step"),
            F.when(F.col("_same"), F.col("value")).otherwise(F.col("at")).alias("at"),
        )
        old, state = state, stage(moved, "probes")
        unstage(old)
    return state.select(*[f"`{k}`" for k in slices], "at")


def probe_all(src: DataFrame, dst: DataFrame, id_: str, candidates: Sequence[int]) -> DataFrame:
    """(c, src_cnt, dst_cnt): rows with ``id <= c`` on each side, one scan of each."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        made = [F.count(F.when(F.col(id_) <= c, 1)).alias(str(k)) for k, c in enumerate(candidates)]
        pairs = [F.struct(F.lit(c).cast("long").alias("c"), F.col(str(k)).alias(name)) for k, c in enumerate(candidates)]
        return df.agg(*made).select(F.inline(F.array(*pairs)))

    return counts(src, "src_cnt").join(counts(dst, "dst_cnt"), "c")


def new_ids(src: DataFrame, dst: DataFrame, id_: str, parts: Sequence[str] = ()) -> DataFrame:
    """Source rows beyond the destination's greatest id, by partition if there are any."""
    if not parts:  # one number, which reaches the source's scan, or its database, as a filter
        top = dst.agg(F.max(id_)).first()[0]
        return src if top is None else src.filter(F.col(id_) > F.lit(top))
    top = dst.groupBy(*[F.col(f"`{p}`").alias(f"_t_{p}") for p in parts]).agg(F.max(id_).alias("_top"))
    joined = src.join(top, [F.col(f"`{p}`").eqNullSafe(F.col(f"_t_{p}")) for p in parts], "left")
    return joined.filter(F.col("_top").isNull() | (F.col(id_) > F.col("_top"))).select(*src.columns)


def dense_remaining(src_cnt: int, dst_cnt: int, dst_max: int, at: int) -> tuple[int, int]:
    """Rows of each side beyond id ``at``, if ids are dense: both counts less what lies below.

    The engine counts exactly instead; this is for comparing plans without a further scan.
    """
    below = dst_cnt - (dst_max - at)
    return src_cnt - below, dst_cnt - below
