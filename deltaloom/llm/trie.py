"""Prefix trie of conversations: pointer dictionaries within buckets, a spine above them.

Each turn is a 128-bit digest of role and text, a conversation an array of digests, and equal
conversations one row with a count. Rows are dealt by a hash of their first turn into buckets; a
bucket's subtries are built in ``applyInPandas`` from dictionaries that point to children, and summed
in postorder without recursion. A first turn with more than ``TURNS`` turns below it is too much for
a bucket: its rows are dealt again by the next turn at which they differ, as often as needed. The
turns that those rows have in common are nodes of the spine, which is summed by joins, deepest round
first, once the subtries below it are known. The root is always part of the spine.

Scale. Only digests and lengths are shuffled, about 24 bytes a turn, never text. A bucket holds about
``TURNS`` turns; a first turn that a third of all conversations share costs a round for each branching
that is still too large, and the turns that a group has in common are passed in one step. The rows
of a group of copies are counted before they are dealt. The digest of the conversations that end
in a node is a SHA-256 over a list of any length: ids are packed by range into blocks of at most
``BLOCK`` characters, and the blocks of a node are hashed as a stream, one in memory at a time.

Memory: a bucket's nodes; 24 bytes a turn of the longest conversation, which is never split.

Edge cases: null turns come first; turns with equal numbers are ordered by digest, and a repeated
row is one more turn; null role or text is empty; rows without conv_id are no conversation and are
left out; ids below zero take the remainder of the same sign; a conversation that is rebuilt without
turns is a member of the root alone; an empty table gives no rows. Only the four columns are read,
so others may have any names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import broadcast_if_small, input_bytes, materialise, narrow, table

#: Turns of a bucket, and of the largest subtrie that is not dealt again.
TURNS = 10_000
BLOCK = 1 << 16
ROOT = b""
EMPTY = hashlib.sha256(b"").digest()
NODES = (
    "pkey binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends binary"
)


def digest16(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def own_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, an array of (digest, length)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = digest16(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = narrow(turns, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    one = F.struct("turn", key.alias("digest"), F.length(text).alias("length"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["length"].alias("length"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, uid, seq, lens): h turns of the conversation that opens the hundred, then the own ones after h."""
    own = materialise(own_turns(turns), "turns")
    heads = own.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    made = F.concat(F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0)), tail)
    out = both.select("conv_id", F.transform(made, lambda x: x["digest"]).alias("seq"), F.transform(made, lambda x: x["length"]).alias("lens"))
    uid = digest16(F.array_join(F.transform("seq", lambda x: F.hex(x)), ""))
    return out.select("conv_id", uid.alias("uid"), "seq", "lens")


def _packed(batches):
    """Sorted (uid, conv_id) rows in, blocks (uid, first, ids) out."""
    now, first, held, size = None, None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for uid, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if uid != now or size > BLOCK:
                if held:
                    out.append((now, first, ",".join(held)))
                now, first, held, size = uid, c, [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
        if len(out) > 1_000:
            yield _block(out)
            out = []
    if held:
        out.append((now, first, ",".join(held)))
    if out:
        yield _block(out)


def _block(rows: list[tuple]) -> pa.RecordBatch:
    u, f, t = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(f, pa.int64()), pa.array(t)], ["uid", "first", "ids"])


def _hashed(batches):
    """Blocks sorted by (uid, first) in, (uid, ends) out."""
    now, run = None, None
    for batch in batches:
        uids, ends = [], []
        for uid, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if uid != now:
                if run is not None:
                    uids.append(now)
                    ends.append(run.digest())
                now, run = uid, hashlib.sha256()
            else:
                run.update(b",")
            run.update(ids.encode())
        if uids:
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), pa.array(ends, pa.binary())], ["uid", "ends"])
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([run.digest()], pa.binary())], ["uid", "ends"])


def ends(convs: DataFrame) -> DataFrame:
    """(uid, ends): the digest of the ids, ascending, of each distinct conversation."""
    spark = convs.sparkSession
    ids = convs.select("uid", "conv_id")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(ids) >> 26)
    blocks = ids.repartitionByRange(tasks, "uid", "conv_id").sortWithinPartitions("uid", "conv_id").mapInArrow(
        _packed, "uid binary, first long, ids string"
    )
    dealt = blocks.repartition(tasks, "uid").sortWithinPartitions("uid", "first")
    return dealt.mapInArrow(_hashed, "uid binary, ends binary")


def subtries(rows):
    """The nodes of a bucket's subtries; the parents of the topmost, ``pkey``, are in the spine."""
    import pandas as pd

    tops, kids, up, key, depth, length, least, n, end = {}, [], [], [], [], [], [], [], []
    cols = (rows[c] for c in ("pkey", "depth", "seq", "lens", "n", "least", "ends"))
    for pkey, start, seq, lens, many, first, ending in zip(*cols, strict=True):
        at = -1
        for d in range(start, len(seq)):
            held, name = (tops, (pkey, seq[d])) if at < 0 else (kids[at], seq[d])
            to = held.get(name)
            if to is None:
                to = held[name] = len(kids)
                kids.append({})
                up.append(at)
                key.append(pkey if at < 0 else None)
                depth.append(d + 1)
                length.append(int(lens[d]))
                least.append(first)
                n.append(0)
                end.append(EMPTY)
            n[to] += many
            least[to] = min(least[to], first)
            at = to
        end[at] = ending
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for k in range(len(kids) - 1, -1, -1):  # children have greater numbers than their parents
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * length[k]
        if up[k] >= 0:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    parent = [None if p < 0 else least[p] for p in up]
    return pd.DataFrame(
        {
            "pkey": key, "depth": depth, "conv_id": least, "parent_conv_id": pd.array(parent, "Int64"), "n_convs": n,
            "n_children": [len(x) for x in kids], "n_leaves": leaves, "saved_tokens": saved, "ends": end,
        }
    )


def common_length(low: Column, high: Column) -> Column:
    """How many entries the least and the greatest of some arrays, and so all of them, begin with in common."""
    steps = F.sequence(F.lit(1), F.greatest(F.least(F.size(low), F.size(high)), F.lit(1)))
    apart = F.filter(steps, lambda k: ~F.coalesce(F.get(low, k - 1) == F.get(high, k - 1), F.lit(False)))
    return F.coalesce(F.get(apart, 0) - 1, F.least(F.size(low), F.size(high))).cast("int")


def split(rest: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(small, big, spine): rows of subtries for a bucket; rows that are dealt again; the nodes above those."""
    going = rest.filter(F.size("seq") > F.col("depth")).withColumn("next", F.get("seq", F.col("depth")))
    sizes = going.groupBy("pkey", "next").agg(F.sum(F.size("seq") - F.col("depth")).alias("turns"), F.count(F.lit(1)).alias("seqs"))
    large = materialise(sizes.filter((F.col("turns") > limit) & (F.col("seqs") > 1)).select("pkey", "next"), "large")
    if not large.take(1):
        return going, None, None
    keyed = large.select(
        F.col("pkey").alias("_pkey"), F.col("next").alias("_next"), digest16(F.concat("pkey", "next")).alias("key")
    )
    on = (F.col("pkey") == F.col("_pkey")) & (F.col("next") == F.col("_next"))
    joined = going.join(broadcast_if_small(keyed), on, "left").drop("_pkey", "_next")
    of_large = joined.filter(F.col("key").isNotNull())
    extremes = of_large.groupBy("key", "pkey", "depth").agg(
        F.min(F.struct("seq", "lens")).alias("low"), F.max("seq").alias("high"), F.sum("n").alias("n"), F.min("least").alias("least")
    )
    spine = extremes.select(
        "key", "pkey", F.col("depth").alias("above"), common_length(F.col("low.seq"), F.col("high")).alias("at"), "low.lens", "n", "least"
    )
    spine = materialise(
        spine.select("key", "pkey", "above", "at", F.slice("lens", F.col("above") + 1, F.col("at") - F.col("above")).alias("lens"), "n", "least"),
        "spine",
    )
    at = spine.select(F.col("key").alias("_key"), F.col("at").alias("_at"))
    again = of_large.join(broadcast_if_small(at), F.col("key") == F.col("_key")).select(
        F.col("key").alias("pkey"), F.col("_at").alias("depth"), "seq", "lens", "n", "least", "ends"
    )
    return joined.filter(F.col("key").isNull()).drop("key"), materialise(again, "again"), spine


def summed(spine: DataFrame, below: DataFrame, over: DataFrame) -> DataFrame:
    """Nodes of one round of the spine: chains of turns in common. ``below`` (pkey, conv_id ... of the topmost nodes
    under it), ``over`` (pkey, ends) of the conversations that end in it."""
    sums = below.groupBy("pkey").agg(
        F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    s = spine.join(sums.withColumnRenamed("pkey", "_k"), F.col("key") == F.col("_k"), "left").drop("_k")
    s = s.join(over.select(F.col("pkey").alias("_k"), "ends"), F.col("key") == F.col("_k"), "left").drop("_k")
    chain = s.select("*", F.posexplode(F.when(F.size("lens") > 0, F.col("lens")).otherwise(F.array(F.lit(0)))).alias("i", "_len"))
    last = F.col("i") == F.greatest(F.size("lens"), F.lit(1)) - 1
    further = F.aggregate(F.slice("lens", F.col("i") + 1, F.size("lens")), F.lit(0).cast("long"), lambda a, x: a + x)
    return chain.select(
        F.when(F.col("i") == 0, F.col("pkey")).alias("pkey"),
        F.when(F.size("lens") > 0, F.col("above") + 1 + F.col("i")).otherwise(F.col("above")).cast("long").alias("depth"),
        F.col("least").alias("conv_id"),
        F.when(F.col("i") > 0, F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * further).cast("long").alias("saved_tokens"),
        F.when(last, F.col("ends")).alias("ends"),
    )


def trie(turns: DataFrame, limit: int = TURNS) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations."""
    convs = materialise(rebuilt(turns), "conversations")
    unique = convs.groupBy("uid").agg(
        F.min("seq").alias("seq"), F.min("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")
    )
    rest = unique.join(ends(convs), "uid").select(
        F.lit(ROOT).alias("pkey"), F.lit(0).alias("depth"), "seq", "lens", "n", "least", "ends"
    )
    rest = materialise(rest, "unique")
    whole = rest.agg(F.sum("n").alias("n"), F.min("least").alias("least")).filter("n > 0")
    root = whole.select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("pkey"), F.lit(0).alias("above"), F.lit(0).alias("at"),
        F.array().cast("array<int>").alias("lens"), "n", "least",
    )
    spine, level, pools = [(materialise(root, "spine"), rest)], rest, []
    while level is not None:
        small, level, above = split(level, limit)
        pools.append(small)
        if level is not None:
            spine.append((above, level))
    pool = pools[0]
    for p in pools[1:]:
        pool = pool.unionByName(p)
    total = pool.agg(F.sum(F.size("seq") - F.col("depth")).alias("turns")).first()["turns"] or 0
    bucket = F.pmod(F.xxhash64("pkey", "next"), F.lit(1 + total // TURNS)).alias("bucket")
    nodes = materialise(
        pool.select(bucket, "pkey", "depth", "seq", "lens", "n", "least", "ends").groupBy("bucket").applyInPandas(subtries, NODES), "nodes"
    )
    made, below = [nodes], nodes.filter(F.col("pkey").isNotNull())
    for part, level in reversed(spine):
        over = level.filter(F.size("seq") == F.col("depth"))
        part_nodes = materialise(summed(part, below, over), "spine-nodes")
        made.append(part_nodes)
        below = below.unionByName(part_nodes.filter(F.col("pkey").isNotNull()))
    parents = spine[0][0].select("key", F.col("least").alias("_least"))
    for part, _ in spine[1:]:
        parents = parents.unionByName(part.select("key", F.col("least").alias("_least")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    out = out.join(broadcast_if_small(parents), F.col("pkey") == F.col("key"), "left")
    return out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.lower(F.hex(F.coalesce("ends", F.lit(EMPTY)))).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
