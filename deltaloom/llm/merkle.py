"""Merkle dataset manifest with coordinate lookup proofs.

Every document is a leaf, every source a tree over its leaves, and the subroots, by source, are the
leaves of one more tree whose top is the root. A parent is the hash of up to ``FANOUT`` consecutive
nodes. All nodes are materialised as one table by coordinate: (tree, level, place, digest). Where a
node's siblings are follows from its index and its group's size alone, so proofs need no pointers:
the leaves of a run explode the coordinates that they need, those are joined with the node table,
put in order and folded. The 16 leaves of a run share all coordinates but their own place, so these
are exploded once for the run; the coordinates of a subroot in the tree of subroots once for its source.

Scale. Places are ranks, found without sorting a source in one task: leaves are dealt by range of
(source, doc_id, leaf) and a leaf's place is its place in its range plus the rows of its source in
earlier ranges. Only digests are shuffled, never text. Levels near the top, whose nodes every run asks
for, are broadcast once they have at most ``FEW`` nodes together (counted); of the levels below, a node
is asked for by a share of at most 1 in ``FEW``. There are log16(rows) levels, each written before
the next is made.

``H`` is the lower-case hex SHA-256 of its inputs joined, digests as hex text.

Edge cases: a null field is ``-`` in the leaf, and an empty text ``0:``; very long texts are hashed
whole; a source is a tree of its own for null and for the empty name; within a source null doc_ids
come first, and rows that tie on doc_id are ordered by their leaf (repeated rows are leaves of
their own, interchangeable); a null doc_id is never tampered with; a lone leaf is its subroot and a
lone subroot the root, so that their proofs are empty; an empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import broadcast_if_small, discard, materialise, narrow, ranked, table

FANOUT = 16
#: Upper levels of at most so many nodes together are broadcast: 1.3 MB of digests.
FEW = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots; trees of sources count from 0.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in front, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of a document; ``text`` may stand for its text."""
    return h(*[field(F.col(f"`{c}`") if c != "text" or text is None else text) for c in FIELDS])


def tampered_with() -> Column:
    """Documents whose copy is altered: 5 divides the crc32 of their decimal id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, seen, place, n): ``seen`` is the leaf as a verifier gets it, ``place`` its
    rank in its source, which has ``n`` leaves."""
    other = F.when(tampered_with() & F.col("text").isNotNull(), leaf(F.translate("text", UPPER, LOWER)))
    made = narrow(docs, *FIELDS).select("source", "doc_id", leaf().alias("leaf"), other.alias("seen"))
    packed = made.select(
        "source", "doc_id", F.unhex("leaf").alias("leaf"),
        F.when(F.col("seen") != F.col("leaf"), F.unhex("seen")).alias("seen"),
    )
    return ranked(materialise(packed, "leaves"), ["source"], ["doc_id", "leaf"], "place", "n")


def hexed(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: (tree, level, place, digest, n) of trees that have more than one node."""
    group = F.sort_array(F.collect_list(F.struct("place", "digest")))  # FANOUT nodes at most
    return (
        nodes.filter(F.col("n") > 1)
        .groupBy("tree", (F.col("level") + 1).alias("level"), F.floor(F.col("place") / FANOUT).cast("long").alias("place"),
                 F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
        .agg(F.array_join(F.transform(group, lambda x: hexed(x["digest"])), "").alias("joined"))
        .select("tree", "level", "place", F.unhex(h(F.col("joined"))).alias("digest"), "n")
    )


def tree(base: DataFrame) -> list[DataFrame]:
    """``base`` (tree, level 0, place, digest, n) and every level above it, each written."""
    levels = [base]
    while levels[-1].filter(F.col("n") > 1).take(1):
        levels.append(materialise(parents(levels[-1]), "nodes"))
    return levels


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's last node."""
    return union([x.filter(F.col("n") == 1).select("tree", "digest") for x in levels])


def coordinates(place: Column, n: Column, first: int) -> Column:
    """An array of (level, at, own): the runs that hold the ancestors of a node, from level ``first`` on to the
    last below the top, member by member. ``own`` marks the ancestor itself."""
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(16)),  # 16 ** 16 nodes and more
        F.struct(F.lit(0).alias("k"), n.alias("left")),
        lambda acc, _: F.struct(
            (acc["k"] + F.when(acc["left"] > 1, 1).otherwise(0)).alias("k"),
            F.ceil(acc["left"] / FANOUT).cast("long").alias("left"),
        ),
        lambda acc: acc["k"],
    )

    def run(level: Column) -> Column:
        own = F.call_function("shiftrightunsigned", place, level * 4)
        width = F.call_function("shiftrightunsigned", n - 1, level * 4) + 1
        low = own - own % FANOUT
        return F.transform(
            F.sequence(low, F.least(low + (FANOUT - 1), width - 1)),
            lambda at: F.struct(level.alias("level"), at.alias("at"), (at == own).alias("own")),
        )

    steps = F.when(levels > first, F.sequence(F.lit(first), levels - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(steps, run))


def looked_up(asking: DataFrame, keys: list[str], nodes: list[DataFrame], first: int) -> DataFrame:
    """(keys, path): for every row of ``asking`` (keys, tree, place, n) the siblings on its way up, an array by level
    of (left, right), the joined hex digests before and after its ancestor."""
    wanted = asking.select(*keys, "tree", F.explode(coordinates(F.col("place"), F.col("n"), first)).alias("c")).select(*keys, "tree", "c.*")
    counts = [x.count() for x in nodes]
    cut = next(k for k in range(len(nodes) + 1) if sum(counts[k:]) <= FEW)
    found = []
    for some, few in ((nodes[first:cut], False), (nodes[max(first, cut):], True)):
        if not some:
            continue
        held = union(some).select(F.col("tree").alias("_t"), F.col("level").alias("_l"), F.col("place").alias("_p"), "digest")
        rows = wanted.filter(F.col("level") >= cut if few else F.col("level") < cut)
        on = (F.col("tree") == F.col("_t")) & (F.col("level") == F.col("_l")) & (F.col("at") == F.col("_p"))
        found.append(rows.join(F.broadcast(held) if few else held, on).select(*keys, "level", "at", "own", "digest"))
    if not found:
        return asking.select(*keys, F.array().cast("array<struct<left:string,right:string>>").alias("path")).limit(0)
    siblings = F.sort_array(F.collect_list(F.struct("level", "at", "own", "digest")))  # FANOUT a level
    return union(found).groupBy(*keys).agg(siblings.alias("s")).select(*keys, by_level(F.col("s")).alias("path"))


def by_level(s: Column) -> Column:
    """Sorted (level, at, own, digest) as an array, by level, of what is left and right of the own one."""

    def side(level: Column, left: bool) -> Column:
        own = F.element_at(F.filter(s, lambda x: (x["level"] == level) & x["own"]), 1)["at"]
        some = F.filter(s, lambda x: (x["level"] == level) & ((x["at"] < own) if left else (x["at"] > own)))
        return F.array_join(F.transform(some, lambda x: hexed(x["digest"])), "")

    levels = F.array_distinct(F.transform(s, lambda x: x["level"]))
    return F.transform(levels, lambda v: F.struct(side(v, True).alias("left"), side(v, False).alias("right")))


def joined(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]).cast("binary"), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = leaves(docs)
    sources = materialise(found.filter(F.col("place") == 0).select("source", "n"), "sources")  # one row for each source
    numbered = materialise(
        ranked(sources.withColumn("_one", F.lit(1)), ["_one"], ["source"], "tree", "trees").select("source", "tree", "n", "trees"), "trees"
    )
    s = numbered.select(F.col("source").alias("_source"), "tree")
    base = materialise(
        found.join(broadcast_if_small(s), F.col("source").eqNullSafe(F.col("_source"))).select(
            "tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest"), "n", "doc_id", "seen"
        ),
        "base",
    )
    lower = tree(base.select("tree", "level", "place", "digest", "n"))
    subroots = materialise(tops(lower), "subroots")
    upper = tree(
        materialise(
            subroots.join(numbered.select("tree", "trees"), "tree").select(
                F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), "digest", F.col("trees").alias("n")
            ),
            "subroot-nodes",
        )
    )
    root = next((r[0] for r in tops(upper).select(hexed("digest")).take(1)), None)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    # the way of each source's subroot through the tree of subroots
    asked = upper[0].select(F.col("place").alias("of"), "tree", "place", "n")
    source_paths = subroots.withColumnsRenamed({"tree": "of", "digest": "subroot"}).join(looked_up(asked, ["of"], upper, 0), "of", "left")
    source_paths = materialise(
        source_paths.select("of", hexed("subroot").alias("subroot"), F.coalesce("path", empty).alias("path_above")), "source-paths"
    )
    # runs of leaves, each with its members; their way from level 1 on is common to them
    run = F.floor(F.col("place") / FANOUT).cast("long")
    members = F.sort_array(F.collect_list(F.struct("place", "digest", "seen", "doc_id")))  # FANOUT at most
    runs = base.groupBy("tree", run.alias("run"), "n").agg(members.alias("members"))
    asked = base.filter(F.col("place") % FANOUT == 0).select(F.col("tree").alias("of"), run.alias("of_run"), "tree", "place", "n")
    ways = looked_up(asked, ["of", "of_run"], lower, 1)
    held = runs.join(ways, (F.col("tree") == F.col("of")) & (F.col("run") == F.col("of_run")), "left").drop("of", "of_run")
    held = held.join(broadcast_if_small(source_paths), F.col("tree") == F.col("of"))
    digests = F.transform("members", lambda x: hexed(x["digest"]))
    held = held.select("subroot", "n", digests.alias("d"), F.concat(F.coalesce("path", empty), "path_above").alias("above"), F.posexplode("members").alias("i", "m"))
    own = F.struct(
        F.array_join(F.slice("d", 1, F.col("i")), "").alias("left"),
        F.array_join(F.slice("d", F.col("i") + 2, FANOUT), "").alias("right"),
    )
    path = F.when(F.col("n") > 1, F.concat(F.array(own), "above")).otherwise(F.col("above"))
    out = held.select(F.col("m.doc_id").alias("doc_id"), hexed("m.digest").alias("leaf"), hexed("m.seen").alias("seen"), "subroot", path.alias("path"))
    return out.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(joined(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        fold(F.coalesce("seen", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
