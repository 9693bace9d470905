import hashlib
import random
import re

import numpy as np
import pytest

from deltaloom.llm import _common, substrings
from deltaloom.llm import substrings as S


def brute(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), ws in zip(rows, texts, strict=True):
        for i in range(len(ws) - 19):
            w, key = tuple(ws[i : i + 20]), (float("-inf") if d is None else d, i)
            first[w] = min(first.get(w, key), key)
    out = []
    for (d, _), ws in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(ws) - 19):
            if first[tuple(ws[i : i + 20])] != (float("-inf") if d is None else d, i):
                gone.update(range(i, i + 20))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(60)] + ["é" * 9, "long" * 20, "a", "\x01b"]
    passage = [rng.choice(vocab) for _ in range(57)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, " ".join(["x"] * 75)), (4, "x " * 30), (None, " ".join(passage)), (5, "z")]
    for d in range(10, 90):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        if d % 7 == 0:
            words += words[-45:]
        sep = rng.choice([" ", "\n", "  "])
        out.append((d, sep.join(words)))
    out += [(d + 1000, t) for d, t in out if d and d % 5 == 0]
    out += [(20, dict(out)[20]), (30, "other " + " ".join(passage))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 1 / 10_000_000])
def test_query_matches_brute_force(spark, rows, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, spans int, tkey string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = substrings.op5_substring_dedup(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(brute(rows), key=key)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert substrings.op5_substring_dedup(spark, str(tmp_path)).count() == 0


def test_equal_hashes_of_different_bytes_are_parted():
    words = _common.Words([b"aa bb aa cc"])
    item, group = substrings.groups_of_equals(words, np.array([1, 1, 1, 1], np.uint64), words.start, words.end)
    by = dict(zip(item.tolist(), group.tolist(), strict=True))
    assert by[0] == by[2] and len({by[0], by[1], by[3]}) == 3


def test_windows_and_minima():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    assert [int(v) for v in _common.sliding_min(x, 18)] == [int(x[i : i + 18].min()) for i in range(83)]
    g = _common.grams(np.tile(x[:30], 2), 20)
    assert (g[:11] == g[30:]).all() and len(g) == 41 and len(set(g.tolist())) == 30
    words = _common.Words([b"a b c", b"d", b"e f g h"])
    assert _common.inside(words.first, 3, 8).tolist() == [True, False, False, False, True, True]


def test_what_recurs_leaves_a_task_about_twice():
    """A passage in every text of many slices: sent by the first two, judged on the spot afterwards."""
    import pyarrow as pa

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"{passage} " + " ".join(f"u{d}x{i}" for i in range(40))) for d in range(400)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([d for d, _ in part]), pa.array([t for _, t in part])], ["doc_id", "text"])
        for part in (rows[k : k + 50] for k in range(0, 400, 50))
    ]

    def slices(given):  # each batch a slice of its own
        for b in given:
            yield b, [t.encode() for t in b.column(1).to_pylist()]

    own, S.text_slices = S.text_slices, slices
    try:
        blocks = [b for out in S._split(np.zeros(0, np.uint64), 4, np.arange(4))(batches) for b in out.column(2).to_pylist()]
    finally:
        S.text_slices = own
    copies = sum(S._open(b)[1].count(b"p30 p31") for b in blocks)
    first = [b for b in S._split(np.zeros(0, np.uint64), 4, np.arange(4))(batches[:1])]
    once = sum(S._open(b)[1].count(b"p30 p31") for out in first for b in out.column(2).to_pylist())
    assert once and copies <= 2 * once
    found = S.repeated_windows(blocks)  # buckets need not be apart for the verdict
    docs = set(found.column(0).to_pylist())
    assert docs == set(range(1, 400))


def test_earlier_starts_in_later_slices_are_kept(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(500 - d, f"{passage} tail{d}") for d in range(300)]  # ids fall while slices go on
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(docs).collect()}
    assert [d for d, n in got.items() if n == 0] == [min(got)] and {n for d, n in got.items() if d != min(got)} == {30}


def test_labels_reach_every_partition(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 64):
        df = spark.createDataFrame([(int(x),) for x in S.labels(spark, n)], "label long")
        assert df.repartition(n, "label").select(F.spark_partition_id().alias("p")).distinct().count() == n


@pytest.mark.parametrize("texts", [2_000, 8_000])
def test_a_hot_passage_fills_no_bucket(texts):
    """Whatever the number of texts that share it, its bucket gets a few records of a task; verdicts follow the texts."""
    import pyarrow as pa

    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [passage if i % 3 == 0 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for i in range(texts)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(k, k + 500)), pa.array(docs[k : k + 500])], ["doc_id", "text"]) for k in range(0, texts, 500)
    ]
    buckets = 64
    held = np.zeros((2, buckets), np.int64)
    for out in substrings._split(np.zeros(0, np.uint64), buckets, np.arange(buckets))(iter(batches)):
        for bucket, block in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            arrays, _ = substrings._open(block)
            held[:, bucket] += len(arrays[0]), len(arrays[3])
    done = held[1].sum()
    assert done > 0.9 * texts / 3  # the passage's later copies
    assert held[1].max() <= 6 * done / buckets
    assert held[0].max() <= 6 * max(1, np.median(held[0])) + 200
