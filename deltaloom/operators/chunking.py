"""Chunks: contiguous id ranges of about equal numbers of source rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.sources.staging import stage, unstage

#: Boundaries that a plan holds as a constant, and bytes of a table for each range in which ids are ranked.
MOST = 100_000
RANGE_BYTES = 256 << 20
#: Bounds that one sketch gives.
FAN = 1_000
#: Ids that a coarse range's sketch gives for each of its chunks.
GRID = 400


def window(df: DataFrame, id_: str, size: int, offset: int | None = None) -> DataFrame:
    """cnt, min_id and max_id of the first ``size`` ids from ``offset`` on (a top-k)."""
    rows = df.select(id_) if offset is None else df.select(id_).filter(F.col(id_) >= offset)
    return rows.orderBy(id_).limit(size).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(id_).alias("min_id"), F.max(id_).alias("max_id")
    )


def window_sql(spark: SparkSession, template: str, low: int, size: int, where: str = "", hint: str = "") -> DataFrame:
    """A window by the user's own query, with $max, $limit, $where, $whereClause and $hint filled in.

    ``low`` and ``size`` are numbers; ``where`` is the request's text, as trusted as the template.
    """
    values = {
        "$whereClause": f" WHERE {where}" if where else "",
        "$where": f" AND {where}" if where else "",
        "$limit": str(int(size)),
        "$hint": hint,
        "$max": str(int(low)),
    }
    for name, value in values.items():
        template = template.replace(name, value)
    return spark.sql(template)


@dataclass(frozen=True)
class Chunk:
    low: int
    high: int
    src_cnt: int
    dst_cnt: int


def walk(src: DataFrame, dst: DataFrame, id_: str, size: int, start: int | None = None) -> Iterator[Chunk]:
    """The exact planner: one source window after another, paired with the destination's rows.

    A window with fewer than ``size`` rows is the last; it reaches to the greatest id of either
    side. One small job for each chunk: for parity and small tables; ``boundaries`` is one pass.
    """
    spans = [df.agg(F.min(id_), F.max(id_)).first() for df in (src, dst)]
    lows, highs = [s[0] for s in spans if s[0] is not None], [s[1] for s in spans if s[1] is not None]
    if not lows:
        return
    at, top = min(lows) if start is None else start, max(highs)
    while at <= top:
        s = window(src, id_, size, at).first()
        last = s["cnt"] < size
        high = max(at + size, top) if last else s["max_id"]
        n = dst.filter(F.col(id_).between(at, high)).count()
        yield Chunk(at, high, s["cnt"], n)
        at = high + 1
        if last:
            return


def sketched(df: DataFrame, id_: str, size: int) -> DataFrame:
    """(chunk, lo, cnt): where ranges of about ``size`` source ids each begin, by a mergeable quantile sketch.

    Each map task holds a sketch of its ids, and sketches are all that is shuffled. A bound is off by at most
    a two-hundredth of a chunk, so sizes are within 1 %; tables of fewer ids than the sketch holds are cut exactly.
    Beyond ``FAN`` chunks a second pass counts and sketches each of ``FAN`` coarse ranges by itself; where chunks begin
    in a range follows from the rows before it, so what the first pass was off by is not passed on. ``cnt`` is the size meant.
    """
    spark = df.sparkSession
    ids = df.select(F.col(id_).cast("long").alias("id")).filter(F.col("id").isNotNull())
    n = ids.count()
    chunks = -(-n // size)
    if not n:
        return stage(spark.createDataFrame([], "chunk long, lo long, cnt long"), "chunks")

    def cut(rows: int, step: int, many: int) -> Column:
        shares = [(k * step + 0.5) / rows for k in range(1, many)]
        found = F.percentile_approx("id", shares, max(10_000, 200 * many)) if shares else F.array().cast("array<bigint>")
        return F.concat(F.array(F.min("id")), found).alias("los")

    coarse = -(-chunks // FAN)  # chunks to a coarse range
    los = ids.agg(cut(n, coarse * size, -(-chunks // coarse))).first()["los"]
    if coarse > 1:
        bounds = stage(spark.createDataFrame([(k, v) for k, v in enumerate(dict.fromkeys(los))], "chunk long, lo long"), "coarse")
        dealt = assign(ids, bounds, "id", "range")
        fine = GRID * coarse  # ids of a range, evenly apart: the nearest one to a bound and the sketch are off by 3 / (2 * GRID) of a chunk
        shares = F.split(F.lit(",".join(str((j + 0.5) / fine) for j in range(fine))), ",").cast("array<double>")
        held = stage(dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.percentile_approx("id", shares, fine).alias("grid")), "grids")
        past = held.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("past"))  # ``FAN`` rows
        starts = held.join(F.broadcast(past), "range").withColumns({"a": F.expr(f"(past + {size - 1}) div {size}"), "z": F.expr(f"(past + n - 1) div {size}")})
        at = f"if(k * {size} = past, lo, element_at(grid, int((2 * (k * {size} - past) + 1) * {fine} div (2 * n)) + 1))"
        found = starts.filter("a <= z").select(F.explode(F.expr(f"transform(sequence(a, z), k -> {at})")).alias("lo")).distinct()
        # no more rows than there are chunks
        numbered = found.repartitionByRange(max(1, chunks // MOST), "lo").sortWithinPartitions("lo").withColumn("at", F.monotonically_increasing_id())
        numbered = stage(numbered, "bounds")
        before = numbered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
        before = before.select("part", "first", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
        joined = numbered.join(F.broadcast(before), F.shiftright("at", 33) == F.col("part"))  # a row for ``MOST`` chunks
        return stage(joined.select((F.col("at") - F.col("first") + F.col("before")).alias("chunk"), "lo", F.lit(size).cast("long").alias("cnt")), "chunks")
    rows = [(k, v, size) for k, v in enumerate(dict.fromkeys(los))]
    return stage(spark.createDataFrame(rows, "chunk long, lo long, cnt long").coalesce(1), "chunks")


def by_query(spark: SparkSession, template: str, id_: str, size: int, low: int | None, where: str = "") -> DataFrame:
    """(chunk, lo, cnt) by the user's own window query, one after another, as the request asks: it returns the count,
    the least and the greatest id of the first ``size`` ids from $max on. One job for each chunk."""
    found, at = [], low
    while at is not None:
        r = window_sql(spark, template, at, size, where).first()
        n, first, last = (r[k] for k in range(3))
        if not n:
            break
        found.append((len(found), int(first), int(n)))
        at = int(last) + 1 if n >= size else None
    return stage(spark.createDataFrame(found, "chunk long, lo long, cnt long"), "chunks")


def boundaries(df: DataFrame, id_: str, size: int) -> DataFrame:
    """(chunk, lo, cnt): where ranges of exactly ``size`` source ids each begin; every id is shuffled.

    Ids are dealt by range; a row's rank is its rank in its range plus the rows of the ranges
    before, so no task sorts the whole table. The number of ranges follows the table's size. The
    first range is open below, the last above.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _bytes(df) // RANGE_BYTES)
    dealt = stage(
        df.select(F.col(id_).alias("id")).filter(F.col("id").isNotNull()).repartitionByRange(parts, "id").select(
            "id", F.spark_partition_id().alias("part")
        ),
        "chunk-ids",
    )
    # one row for each range
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    ranked = dealt.join(F.broadcast(before), "part").select("id", F.floor(rank / size).cast("long").alias("chunk"))
    found = ranked.groupBy("chunk").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("cnt"))
    found = stage(found, "chunks")  # read several times, and small
    unstage(dealt)
    return found


def _bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes under ``df``; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def with_ranges(bounds: DataFrame) -> DataFrame:
    """Adds hi: the next chunk's lo (null for the last). One row for each chunk."""
    following = bounds.select((F.col("chunk") - 1).alias("chunk"), F.col("lo").alias("hi"))
    return bounds.join(following, "chunk", "left").select("chunk", "lo", "hi", "cnt")


def _search(bounds: str, id_: str) -> str:
    """SQL for the index of the last of the sorted ``bounds`` that is not above ``id_`` (-1: none)."""
    mid = "shiftright(acc.lo + acc.hi, 1)"
    over = f"element_at({bounds}, {mid} + 1) > {id_}"
    half = f"if(acc.lo >= acc.hi, acc, named_struct('lo', if({over}, acc.lo, {mid} + 1), 'hi', if({over}, {mid}, acc.hi)))"
    steps = f"sequence(1, int(ceil(log2(size({bounds}) + 1))))"
    return f"aggregate({steps}, named_struct('lo', 0, 'hi', size({bounds})), (acc, _) -> {half}, acc -> acc.lo - 1)"


def _coarse(bounds: DataFrame) -> tuple[int, list[int]]:
    """How many chunks a part has, and where the parts begin: ``MOST`` at most. Kept with the frame, for the other side."""
    found = getattr(bounds, "_parts", None)
    if found is None or found[0] != MOST:
        step = max(1, -(-bounds.count() // MOST))
        rows = bounds.filter(F.col("chunk") % step == 0).orderBy("chunk").select("lo").collect()
        found = bounds._parts = (MOST, step, [r["lo"] for r in rows])
    return found[1:]


def _literal(bounds: list[int]) -> Column:
    """A sorted array of ids as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")


def assign(df: DataFrame, bounds: DataFrame, id_: str, name: str = "chunk") -> DataFrame:
    """``df`` with the chunk of each row; ids below the first chunk belong to it.

    Every row searches the sorted boundaries, a constant of the plan: no shuffle, and nothing
    depends on how ids are spread. Beyond ``MOST`` chunks the constant holds every ``MOST``-th part
    of them, and the chunks of each part, an array in one row, meet their rows by an equi-join.
    Chunks are numbered from 0 without gaps.
    """
    step, coarse = _coarse(bounds)
    if not coarse:
        return df.withColumn(name, F.lit(0).cast("long"))
    key = f"cast(`{id_}` as bigint)"
    if step == 1:
        held = df.withColumn("_bounds", _literal(coarse))
        found = held.withColumn(name, F.greatest(F.expr(_search("_bounds", key)), F.lit(0)).cast("long"))
        return found.select(*df.columns, name)
    groups = bounds.groupBy(F.floor(F.col("chunk") / step).cast("long").alias("_group")).agg(
        F.sort_array(F.collect_list("lo")).alias("_los")  # ``step`` boundaries
    )
    held = df.withColumn("_bounds", _literal(coarse))
    held = held.withColumn("_part", F.greatest(F.expr(_search("_bounds", key)), F.lit(0)).cast("long"))
    inner = F.greatest(F.expr(_search("_los", key)), F.lit(0))
    joined = held.join(groups, F.col("_part") == F.col("_group"))
    return joined.select(*df.columns, (F.col("_group") * step + inner).cast("long").alias(name))


def id_filter(id_: str, low: int | None, high: int | None) -> Column:
    """Rows of a chunk by its inclusive bounds; a missing bound is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(id_) >= low)
    if high is not None:
        out = out & (F.col(id_) <= high)
    return out
