"""Connected components by alternating star contractions.

Each round joins the edge table with the least neighbour of every node and is written to the
shared folder, so that no lineage grows and nothing but two numbers (how many edges, a sum of
their hashes) reaches the driver. Counts shrink geometrically; a chain of n nodes takes about
log n rounds. Least neighbours are written before they are joined, so the join has nothing but
two shuffles (or a broadcast of a small side) below it: a node with a third of all edges is a
skewed partition that adaptive execution splits. What a round replaces is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm._common import discard, materialise

ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = materialise(
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct(),
        "large-star",
    )
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to its least neighbour."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialise(
        moved.filter(F.col("u") > F.col("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct(),
        "small-star",
    )
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not itself a root.

    ``root`` is the least node of the component. Loops (u = v) and nulls are ignored;
    repeated and reversed edges count once; an empty table gives no rows.
    """
    now = materialise(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        large = _large_star(now)
        small = _small_star(large)
        discard(now), discard(large)
        now = small
        if (new := _mark(now)) == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
