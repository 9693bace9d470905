"""Comparing both sides by partition and deciding how each partition is repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions.compare import in_sync
from deltaloom.functions.types import DiffColumn, odd_columns, row_hash
from deltaloom.operators.signature import aggregates, plan_columns, signature
from deltaloom.sources.staging import stage

IN_SYNC, INSERT, MERGE = "inSync", "insert", "merge"
DELETE_MERGE, DELETE_INSERT, REMOVED = "deleteMerge", "deleteInsert", "removed"
DELETES = (DELETE_MERGE, DELETE_INSERT)
#: Fewer partitions than this are broadcast to the source scan.
SMALL_PLAN = 50_000


def _side(sig: DataFrame, columns: Sequence[DiffColumn], parts: Sequence[str], prefix: str) -> DataFrame:
    return sig.select(
        *[F.col(f"`{p}`") for p in parts],
        *[F.col(f"`{c.label}`").alias(f"{prefix}{c.label}") for c in columns],
    )


def _match(a: DataFrame, b: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Both sides by partition, null values included; two single rows without partitions."""
    keys = list(parts) or ["_all"]
    if not parts:
        a, b = a.withColumn("_all", F.lit(1)), b.withColumn("_all", F.lit(1))
    a = a.withColumns({f"_a_{k}": F.col(f"`{k}`") for k in keys}).drop(*keys).withColumn("_src", F.lit(True))
    b = b.withColumns({f"_b_{k}": F.col(f"`{k}`") for k in keys}).drop(*keys).withColumn("_dst", F.lit(True))
    on = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    out = a.join(b, on, "full_outer")
    out = out.withColumns({k: F.coalesce(f"_a_{k}", f"_b_{k}") for k in parts})
    return out.drop(*[f"_a_{k}" for k in keys], *[f"_b_{k}" for k in keys])


def decide(columns: Sequence[DiffColumn], ids: Sequence[str], upto: Column | None) -> Column:
    """The method of a matched row of signatures, by these rules in order.

    No source: removed. Equal: inSync. No destination rows: insert. Not one id: deleteInsert. More,
    later or earlier destination rows: deleteMerge. Source rows up to the destination's greatest
    id equal (``upto``): insert of the rest. Otherwise: merge.
    """
    src, dst = F.coalesce("src_cnt", F.lit(0)), F.coalesce("dst_cnt", F.lit(0))
    out = (
        F.when(F.col("_src").isNull() | ((src == 0) & (dst > 0)), REMOVED)
        .when(F.col("_dst").isNotNull() & in_sync(list(columns)), IN_SYNC)
        .when(dst == 0, INSERT)
    )
    if len(ids) != 1:
        return out.otherwise(DELETE_INSERT)
    i = ids[0]
    more = (F.col(f"dst_max_{i}") > F.col(f"src_max_{i}")) | (dst > src) | (F.col(f"dst_min_{i}") < F.col(f"src_min_{i}"))
    out = out.when(F.coalesce(more, F.lit(False)), DELETE_MERGE)
    if upto is not None:
        out = out.when(upto, INSERT)
    return out.otherwise(MERGE)


def _below(
    src: DataFrame, tail: DataFrame, id_: str, parts: Sequence[str], cols: Sequence[DiffColumn], small: bool
) -> DataFrame:
    """Signatures of the source rows up to the destination's greatest id, for partitions of ``tail``."""
    keys = list(parts) or ["_all"]
    if not parts:
        src, tail = src.withColumn("_all", F.lit(1)), tail.withColumn("_all", F.lit(1))
    tops = tail.select(*[F.col(f"`{k}`").alias(f"_t_{k}") for k in keys], F.col(f"dst_max_{id_}").alias("_top"))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    below = src.join(F.broadcast(tops) if small else tops, on).filter(F.col(id_) <= F.col("_top"))
    made = aggregates(below, cols)
    return _prefixed(below.groupBy(*[F.col(f"`{p}`") for p in parts]).agg(*made) if parts else below.agg(*made), cols, parts)


def _prefixed(low: DataFrame, cols: Sequence[DiffColumn], parts: Sequence[str]) -> DataFrame:
    return low.select(
        *[F.col(f"`{p}`").alias(f"_l_{p}") for p in parts],
        *[F.col(f"`{c.label}`").alias(f"low_{c.label}") for c in cols],
    )


def with_row_hash(src: DataFrame, dst: DataFrame, precision: int = 5, date_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_row_hash``, over the columns that both have, in the destination's types."""
    lower = {c.lower() for c in src.columns}
    shared = T.StructType([f for f in dst.schema if f.name.lower() in lower and not f.name.startswith("_")])
    return tuple(x.withColumn("_row_hash", row_hash(x, shared, precision, date_format)) for x in (src, dst))


def compared_columns(
    src: DataFrame, dst: DataFrame, ids: Sequence[str], parts: Sequence[str], columns=None, count_only=False, precision=5, date_format=None, exact=False,
    odd: str = "ODD",
) -> list[DiffColumn]:
    """The aggregates of both signatures: those of ``plan_columns``, rows, and what sums of fractions leave out."""
    cols = plan_columns(dst, ids, parts, columns, count_only, precision, date_format, exact)
    if not any(c.label == "cnt" for c in cols):
        cols = [DiffColumn("COUNT", "1", alias="cnt"), *cols]
    return cols + odd_columns(cols, src, dst, func=odd)


def pushed_columns(src: DataFrame, dst: DataFrame, ids: Sequence[str], parts: Sequence[str], *rule) -> list[DiffColumn]:
    """As ``compared_columns``, of aggregates that any database has; distinct ids are left to the check of what moves."""
    cols = compared_columns(src, dst, ids, parts, *rule, True, "ODDS")
    return [c for c in cols if not c.label.startswith("unique_cnt_")]


def diff(
    src: DataFrame,
    dst: DataFrame,
    ids: Sequence[str] = (),
    parts: Sequence[str] = (),
    columns: Sequence[DiffColumn] | None = None,
    count_only: bool = False,
    precision: int = 5,
    date_format: str | None = None,
    probe: bool = True,
    exact: bool = False,
    hashed: bool = False,
    pushed=None,
) -> DataFrame:
    """The plan: one row for each partition of either side.

    Columns: the partition columns, method, src_cnt, dst_cnt, src_min, src_max, dst_min, dst_max
    (of a single id), in_sync_id (rows up to it need not move). One scan of each side; partitions
    that may lack just a tail are scanned once more on the source side. Only aggregates are
    shuffled, unless ``exact`` asks for distinct counts. ``hashed`` adds a sum of hashes of whole rows,
    which sees values that rows have swapped, a zero for a null, and a time that is not the latest.
    ``pushed`` has the source's signatures computed where the source is, with distinct counts in place of hashes.
    """
    if hashed:
        src, dst = with_row_hash(src, dst, precision, date_format)
    here = pushed is None
    rule = (columns, count_only, precision, date_format)
    cols = compared_columns(src, dst, ids, parts, *rule, exact) if here else pushed_columns(src, dst, ids, parts, *rule)
    a = _side(signature(src, cols, parts) if here else pushed.signature(cols, parts), cols, parts, "src_")
    b = _side(signature(dst, cols, parts), cols, parts, "dst_")
    joined = stage(_match(a, b, parts), "signatures")  # one row for each partition
    single = len(ids) == 1
    upto = None
    if single and probe:
        i = ids[0]
        # only partitions that no earlier rule decides, and whose source goes on, need the third look
        tail = joined.filter(
            decide(cols, ids, F.lit(None).cast("boolean")).isin(MERGE) & (F.col(f"src_max_{i}") > F.col(f"dst_max_{i}"))
        )
        n = tail.count()
        if n:
            if here:
                low = _below(src, tail, i, parts, cols, n <= SMALL_PLAN)
            else:
                tops = tail.select(*[F.col(f"`{p}`") for p in parts], F.col(f"dst_max_{i}").alias("_top"))
                low = stage(_prefixed(pushed.below(tops, i, cols, parts), cols, parts), "below")
            if parts:
                joined = joined.join(low, [F.col(f"`{p}`").eqNullSafe(F.col(f"_l_{p}")) for p in parts], "left")
            else:
                joined = joined.withColumn("_one", F.lit(1)).join(low.withColumn("_one", F.lit(1)), "_one", "left")
            upto = F.coalesce(F.col("low_cnt") > 0, F.lit(False)) & in_sync(list(cols), "low_", "dst_")
    out = joined.withColumn("method", decide(cols, ids, upto))
    stat = lambda side, name: (
        F.col(f"{side}_{name}_{ids[0]}") if single and f"{side}_{name}_{ids[0]}" in joined.columns else F.lit(None).cast("long")
    )
    at = F.when(F.col("method") == IN_SYNC, stat("src", "max"))
    if upto is not None:
        at = at.when((F.col("method") == INSERT) & (F.coalesce("dst_cnt", F.lit(0)) > 0), stat("dst", "max"))
    return out.select(
        *[F.col(f"`{p}`") for p in parts],
        "method",
        F.col("src_cnt").cast("long").alias("src_cnt"),
        F.col("dst_cnt").cast("long").alias("dst_cnt"),
        *[stat(s, m).alias(f"{s}_{m}") for s in ("src", "dst") for m in ("min", "max")],
        at.alias("in_sync_id"),
    )


def span(plan: DataFrame) -> DataFrame:
    """The plan with low and high: the least and greatest id of either side (null if neither has rows)."""
    return plan.withColumns({"low": F.least("src_min", "dst_min"), "high": F.greatest("src_max", "dst_max")})


def brief_equality() -> Column:
    """Whether the counts, least and greatest ids of both sides of a plan's slice are equal."""
    pairs = [F.col(f"src_{k}").eqNullSafe(F.col(f"dst_{k}")) for k in ("cnt", "min", "max")]
    return pairs[0] & pairs[1] & pairs[2]


def fast_diff(src: DataFrame, dst: DataFrame, ids: Sequence[str], parts: Sequence[str], *rule, exact: bool = False, hashed: bool = False) -> DataFrame:
    """As ``diff`` for append-only data: slices with equal counts, least and greatest ids are in sync without
    a look at their columns; only the others get full signatures."""
    i = ids[0]
    brief = diff(src, dst, ids, parts, count_only=True, probe=False, exact=exact)
    brief = stage(brief.withColumn("_same", brief_equality()), "brief")
    same = brief.filter("_same").drop("_same")
    keys = same.select(*[F.col(f"`{p}`").alias(f"_k_{p}") for p in parts])
    on = [F.col(f"`{p}`").eqNullSafe(F.col(f"_k_{p}")) for p in parts]
    a, b = (x.join(keys, on, "left_anti") for x in (src, dst))
    done = same.withColumns({"method": F.lit(IN_SYNC), "in_sync_id": F.col("src_max")})
    if i not in src.columns:
        raise ValueError(f"no id column {i}")
    return done.unionByName(diff(a, b, ids, parts, *rule, exact=exact, hashed=hashed))


def removed_partitions(src: DataFrame, dst: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Distinct partition values of the destination that the source lacks."""
    a = dst.select(*parts).distinct()
    b = src.select(*[F.col(f"`{p}`").alias(f"_s_{p}") for p in parts]).distinct()
    return a.join(b, [F.col(f"`{p}`").eqNullSafe(F.col(f"_s_{p}")) for p in parts], "left_anti")


def _canonical(value: Column) -> Column:
    """The number or time that a text spells, else the text itself."""
    text = F.trim(value)
    return F.coalesce(text.try_cast("double").cast("string"), text.try_cast("timestamp").cast("string"), text)


def misspelt(plan: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(src_<part>, dst_<part>, …) of partitions that only the source has and only the destination has, though their
    texts spell the same numbers or times: compared as text, each would be inserted on one side and removed on the other.
    """
    texts = {f.name for f in plan.schema if f.name in parts and isinstance(f.dataType, T.StringType)}
    a = plan.filter(F.col("method") == INSERT).select(*[F.col(f"`{p}`").alias(f"src_{p}") for p in parts])
    b = plan.filter(F.col("method") == REMOVED).select(*[F.col(f"`{p}`").alias(f"dst_{p}") for p in parts])
    if not texts:
        return a.join(b, F.lit(False))
    form = lambda side, p: _canonical(F.col(f"`{side}_{p}`")) if p in texts else F.col(f"`{side}_{p}`")
    return a.join(b, [form("src", p).eqNullSafe(form("dst", p)) for p in parts])


def label(method: Column, direct: Column | None = None) -> Column:
    """``direct`` for slices written straight to the destination, else the method."""
    return method if direct is None else F.when(direct, "direct").otherwise(method)


def roll_up(plan: DataFrame) -> DataFrame:
    """Totals of a plan: source and destination rows, slices that move, percent of rows in them."""
    moves = ~F.col("method").isin(IN_SYNC, REMOVED)
    return plan.agg(
        F.coalesce(F.sum("src_cnt"), F.lit(0)).cast("long").alias("source"),
        F.coalesce(F.sum("dst_cnt"), F.lit(0)).cast("long").alias("dest"),
        F.coalesce(F.sum(F.when(moves, F.col("src_cnt"))), F.lit(0)).cast("long").alias("transferred"),
    ).withColumn(
        "pct", F.when(F.col("source") > 0, F.expr("100 * transferred div source")).otherwise(F.lit(0)).cast("long")
    )


def method_histogram(plan: DataFrame) -> DataFrame:
    return plan.groupBy("method").agg(F.count(F.lit(1)).alias("slices"))
