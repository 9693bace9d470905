"""The trie against brute force: every prefix of every rebuilt conversation, with and without dealing again."""

import hashlib
import random
import zlib

import pytest

from deltaloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def conversations(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(own.get(base, [])[:h] + ts[h:])
    return out


def brute(rows):
    convs = conversations(rows)
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ending = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def shared(seed=1):
    """A first turn that most share, long common beginnings, copies, and conversations inside others."""
    rng, rows = random.Random(seed), []
    chain = [("user", f"step {k} " * 3) for k in range(9)]
    for c in range(260):
        kind = rng.randrange(4)
        if kind == 0:
            turns = chain[: rng.randrange(1, 10)]
        elif kind == 1:
            turns = chain[:6] + [("user", f"branch {rng.randrange(3)}"), ("bot", f"leaf {rng.randrange(4)}")]
        elif kind == 2:
            turns = [chain[0]] + [("user", f"t{rng.randrange(3)}") for _ in range(rng.randrange(5))]
        else:
            turns = [("user", f"alone {c}"), ("bot", "Ünïcode 😀")]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def odd():
    rows = [
        (1, None, "a", "null turn first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "", "x"), (1, 2, "b", "tie"), (1, 2, "a", "tie"),
        (None, 0, "user", "nobody"), (-205, 0, "u", "negative"), (-200, 0, "u", "base of it"), (-200, 1, "u", "second"),
        (100, 0, "u", "base"), (100, 1, "v", "base two"), (150, 3, "w", "z" * 100_000), (150, 9, "w", "end"),
    ]
    # conversations without turns: fewer own turns than h, and no base
    return rows + [(c, 0, "user", "short") for c in range(301, 330)]


@pytest.mark.parametrize("limit", [3, 40, trie.TURNS])
def test_equals_every_prefix(spark, limit):
    rows = shared()
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), limit)) == brute(rows)


@pytest.mark.parametrize("limit", [1, trie.TURNS])
def test_odd_rows(spark, limit):
    rows = odd()
    assert any(not s for s in conversations(rows).values())
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA), limit)) == brute(rows)


def test_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 20)
    rows = [(c, k, "u", f"same {k}") for c in range(1000, 1060) for k in range(8)]
    found = got(trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert found == brute(rows) and max(r[3] for r in found) == 60


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert got(trie.trie(spark.createDataFrame([], SCHEMA))) == []
    rows = shared(2)[:200]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("uid", "seq", "lens", "pkey", "next", "n", "least", "ends", "key", "depth"):
        df = df.withColumn(name, F.lit(1))
    assert got(trie.trie(df, 20)) == brute(rows)


def test_a_long_conversation(spark):
    rows = [(700 + c, k, "u", f"{k}") for c in range(3) for k in range(5_000 + c)]
    found = {(r["conv_id"], r["depth"]): r["n_convs"] for r in trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    seqs = conversations(rows)
    assert max(d for _, d in found) == max(map(len, seqs.values())) and found[(700, 0)] == 3


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(trie.op13_conversation_trie(spark, sf)) == brute(rows)
