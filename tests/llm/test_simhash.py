import random

import numpy as np
import pytest
import xxhash

from deltaloom.llm import golay, simhash
from deltaloom.llm.components import components


def brute_fp(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for ch in "\t\n\x0b\x0c\r":
        words = words.replace(ch, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = (
        [" ".join(words)]
        if len(words) < 4
        else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    )
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


def test_golay_is_perfect_and_keys_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    table = golay.nearest()
    assert len(np.unique(table)) == 4096
    sets = {}
    for kind, most in ((golay.keys, 2), (golay.near_keys, 1)):
        def of(w, kind=kind):
            r, k = kind(np.array([w]))
            return set(k.tolist())

        for w in words[:120]:
            for _ in range(6):
                flips = rng.choice(23, rng.integers(0, most + 1), replace=False)
                v = int(w) ^ int(sum(1 << int(f) for f in flips))
                assert of(w) & of(v)
        sets[most] = np.mean([len(of(w)) for w in words])
    assert 5 < sets[2] < 5.7 and sets[1] < 3.6


def test_fuzzy_keys_lose_no_link():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        rows, keys = simhash.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_run_edges_connects_like_brute_force():
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = set()
    for _ in range(400):
        x = base
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << bit
        fps.add(x)
    arr = np.array(sorted(fps), np.uint64).view(np.int64)
    edges = [(u, v) for us, vs in simhash.run_edges(arr) for u, v in zip(us, vs, strict=True)]
    assert len(edges) < len(arr)
    groups = {int(x): {int(x)} for x in arr}
    for i, x in enumerate(arr):
        for y in arr[:i]:
            if ((int(x) ^ int(y)) & (2**64 - 1)).bit_count() <= 4 and groups[int(x)] is not groups[int(y)]:
                groups[int(x)] |= groups[int(y)]
                for z in groups[int(y)] | set():
                    groups[z] = groups[int(x)]
    got = {int(x): {int(x)} for x in arr}
    for u, v in edges:
        u, v = int(u), int(v)
        if got[u] is not got[v]:
            got[u] |= got[v]
            for z in set(got[v]):
                got[z] = got[u]
    assert {frozenset(s) for s in groups.values()} == {frozenset(s) for s in got.values()}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(7, x) for x in range(10, 60)] + [(3, 3), (None, 4)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 181)}, **{x: 7 for x in range(10, 60)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(400)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "x" * 5000), (5, "again"), (None, "one two")]
    for d in range(10, 60):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 300))]
        out.append((d, " ".join(words)))
        for c in range(rng.randint(0, 3)):
            w = list(words)
            w[rng.randrange(len(w))] = "new%d" % c
            out.append((1000 * (c + 1) + d, "\n".join(w)))
    return out


def test_query_matches_brute_force(spark, rows, tmp_path):
    docs = spark.createDataFrame(
        [(d, t, "a", "b") for d, t in rows], "doc_id long, text string, fp string, component_id string"
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = simhash.op9_simhash_near_dedup(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(map(tuple, out), key=key) == sorted(brute_components(rows), key=key)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert simhash.op9_simhash_near_dedup(spark, str(tmp_path)).count() == 0
