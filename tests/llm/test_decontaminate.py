import random
import re

import numpy as np
import pytest

from deltaloom.llm import decontaminate as D


def shingles(text, width=None):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    width = width or min(5, len(words))
    return ({" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()), width


def brute(docs, items):
    out = []
    for i, t in items:
        s, width = shingles(t)
        for d, text in docs:
            if s:
                n = len(s & shingles(text, width)[0])
                if 5 * n >= 4 * len(s):
                    out.append((d, i, len(s), n, n / len(s)))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(500)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(5, 60)))) for i in range(40)]
    items += [(40, None), (41, " "), (42, "Two Words"), (43, "single"), (None, "no id but five words here"), (1, items[1][1])]
    items += [(44, " ".join(["r"] * 30))]
    docs = [(0, None), (1, ""), (2, "two\nwords"), (3, "x SINGLE y"), (4, " ".join(["r"] * 5))]
    for d in range(10, 120):
        words = some(rng.randint(0, 800))
        for _ in range(rng.randint(0, 2)):
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in part]
        docs.append((d, rng.choice([" ", "\n"]).join(words)))
    return docs + [docs[20], (None, items[2][1])], items


@pytest.mark.parametrize("block", [1 << 24, 500])
def test_matches_brute_force(spark, data, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    docs, items = data
    got = D.contained_items(
        spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = brute(docs, items)
    assert len(want) > 20
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_clean_rows_keep_all_columns(spark, data):
    docs, items = data
    df = spark.createDataFrame([(t, d, [1], "z") for d, t in docs], "text string, doc_id long, extra array<int>, n string")
    out = D.without_contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    bad = {(d, i) for d, i, *_ in brute(docs, items)}
    dirty = {d for d, _ in bad}
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in docs if d not in dirty)
    assert out[0].extra == [1]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert D.contained_items(some, items).count() == 0
    assert D.without_contaminated(some, items).count() == 1


def test_each_size_class_has_an_index():
    items = [(1, " ".join(f"a{i}" for i in range(12))), (2, " ".join(f"b{i}" for i in range(200))), (3, "tiny item")]
    own = D.Benchmark(items)
    assert len(own.index) == 3
    looked = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            looked.append(self.least)
            return np.asarray(self)[key]

    def watched(entry):
        width, least, hashes, item, maybe = entry
        w = maybe.view(Watched)
        w.least = least
        return width, least, hashes, item, w

    own.index = [watched(e) for e in own.index]
    small = " ".join(f"a{i}" for i in range(12)).encode()
    assert [(t, own.ids[i]) for t, i, *_ in own.matches([small, b"x y"])] == [(0, 1)]
    assert max(looked) < 100  # the class of 200 words is never searched for texts of 12


@pytest.mark.parametrize("setting, value", [("PART", 300), ("FILTER", 1 << 10)])
def test_small_parts_and_full_filters_lose_nothing(spark, data, monkeypatch, setting, value):
    """A block searched by many tasks, and a filter that lets nearly every text through."""
    monkeypatch.setattr(D, setting, value)
    monkeypatch.setattr(D, "BLOCK", 2000)
    docs, items = data
    df = spark.createDataFrame([(d, t, [1]) for d, t in docs], "doc_id long, text string, id array<int>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = D.contained_items(df, bench).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    dirty = {d for d, *_ in want}
    kept = D.without_contaminated(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in dirty)


def test_filter_sends_texts_to_the_blocks_of_their_items_only(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(200)]
    bench, n = D.blocks(spark.createDataFrame(items, "item_id long, text string").repartition(3))
    assert n == 1
    block = {r.item_id: r.item_id % 7 for r in bench.collect()}
    bench = bench.drop("block").selectExpr("item_id", "text", "cast(item_id % 7 as int) as block")
    own = D.bloom(bench, 7).value
    texts = [f"before {t} after".encode() for _, t in items] + [b"x y z " * 400, b"", b"two words"]
    assert own.routes(texts) == [(i, block[i]) for i, _ in items]
