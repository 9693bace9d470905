"""Near-duplicates against brute force: planted chains, large groups of copies, odd rows."""

import random

import numpy as np
import pytest

from deltaloom.llm import minhash

SCHEMA = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(find(x), []).append(x)
    out = []
    for members in groups.values():
        least = min((rows[x][0] for x in members if rows[x][0] is not None), default=None)
        out += [(rows[x][0], len(sets[x]), least, rows[x][0] == least) for x in members]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def text(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, w, times):
    w = list(w)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def planted():
    """Copies with more and more edits, so that pairs lie on both sides of the threshold; a chain; a common passage."""
    rng, rows = random.Random(5), []
    for _ in range(12):
        base = text(rng, rng.randrange(30, 200))
        rows += [" ".join(edited(rng, base, k)) for k in range(8)]
    step = text(rng, 120)
    for _ in range(15):
        step = edited(rng, step, 2)
        rows.append(" ".join(step))
    passage = text(rng, 60)
    rows += [" ".join(passage + text(rng, 40)) for _ in range(40)]
    return list(enumerate(rows))


def odd():
    base = " ".join(f"w{k}" for k in range(40))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One\tTwo  three"), (8, base),
        (9, base.upper()), (9, base), (None, base + " x"), (None, "lonely text of nobody here"), (None, None), (10, "a b c d e f g h"),
        (11, "a b c d e f g i"), (12, "É é"), (13, "é É"), (14, "z " * 50_000), (15, "z z z z"),
    ]


@pytest.mark.parametrize("rows", [planted, odd], ids=["planted", "odd"])
def test_equals_all_pairs(spark, rows):
    assert got(minhash.near_duplicates(spark.createDataFrame(rows(), SCHEMA).repartition(3))) == brute(rows())


def test_four_shingles_link_with_five(spark):
    """4 of 5 is 0.8, the least sizes that link without being equal; 3 of 4 is less."""
    rows = []
    for k in range(40):
        w = [f"s{k}x{j}" for j in range(9)]
        rows += [" ".join(w[:n]) for n in (7, 8)] if k % 2 else [" ".join(w[:6]), " ".join(w[:7]), " ".join(w[1:9])]
    rows = list(enumerate(rows))
    expected = brute(rows)
    assert sum(r[0] != r[2] for r in expected) == 20
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected


def test_large_group_of_copies_around_the_threshold(spark):
    """Pairs of copies lie around 0.8, so a star around one of them does not hold the group together."""
    rng = random.Random(11)
    base = text(rng, 100)
    rows = [(k, " ".join(edited(rng, base, rng.randrange(2, 5)))) for k in range(250)]
    expected = brute(rows)
    assert 1 < len({r[2] for r in expected}) < 200
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected


def test_long_texts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    base = text(rng, 100_000, 50_000)
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 2_000))), (3, " ".join(text(rng, 100_000, 50_000)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("class", "n", "sig", "key", "held", "label", "root", "tkey", "rep", "component"):
        docs = docs.withColumn(name, F.lit(1))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    sets = [shingles(t) for _, t in rows]
    assert found == {1: (len(sets[0]), 1), 2: (len(sets[1]), 1), 3: (len(sets[2]), 3)}


def test_empty_table(spark):
    assert got(minhash.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_collisions_follow_similarity():
    """The share of equal coordinates is close to the Jaccard similarity of the sets."""
    rng = np.random.default_rng(2)
    for j in (0.5, 0.8, 0.95):
        shares = []
        for _ in range(200):
            both = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
            alone = round(300 * (1 - j) / (1 + j))  # of each side, over 300 - alone in common
            a, b = np.sort(both), np.sort(np.concatenate([both[alone:], rng.integers(0, 1 << 63, alone, dtype=np.int64).astype(np.uint64)]))
            sig = minhash.signatures(np.concatenate([a, b]), np.array([300, 600]))
            shares.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(shares) - j) < 0.02
        if j == 0.8:
            assert min(shares) > minhash.MATCHES / minhash.K


def test_long_signatures_of_links_share_enough():
    rng = np.random.default_rng(4)
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 90, dtype=np.int64).astype(np.uint64)
        extra = rng.integers(0, 1 << 63, 20, dtype=np.int64).astype(np.uint64)  # 80 of 100: at the threshold
        a, b = np.sort(np.concatenate([both[:80], extra[:10]])), np.sort(np.concatenate([both[:80], extra[10:]]))
        sig = minhash.signatures(np.concatenate([a, b]), np.array([90, 180]), minhash.LONG)
        same = sig[0].astype(np.uint8) == sig[1].astype(np.uint8)
        assert same.sum() >= minhash.LEAST and same[: minhash.PART].sum() >= minhash.PART_LEAST
        assert (sig[0, : minhash.POSTS] == sig[1, : minhash.POSTS]).any()


def test_prefix_and_bytes_lose_no_pair_of_enough_collisions(spark):
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 40, (60, minhash.K)).astype(np.uint32)  # many collisions
    for k in range(1, 60):
        at = rng.random(minhash.K) < rng.random()
        sig[k, at] = sig[k - 1, at]
    names = [bytes([k]) * 16 for k in range(60)]
    rows = [(names[k], 50, sig[k].astype("<u4").tobytes()) for k in range(60)]
    classes = spark.createDataFrame(rows, "class binary, n long, sig binary")
    posted = {}
    for r in minhash.postings(classes, minhash.histogram(classes)).collect():
        posted.setdefault(bytes(r["held"])[:16], set()).add(r["key"])
    for x in range(60):
        assert len(posted[names[x]]) == minhash.PREFIX
        for y in range(x):
            if (sig[x] == sig[y]).sum() >= minhash.MATCHES:
                assert posted[names[x]] & posted[names[y]]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(minhash.op12_minhash_near_dedup(spark, sf)) == brute(rows)
