"""Texts of 100,000 words, read whole."""

import random

import numpy as np
import xxhash

from deltaloom.llm import decontaminate, simhash, substrings

N = 100_000


def words(seed, n=N):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def test_a_passage_in_the_middle_of_long_texts_is_removed(spark):
    a, b = words(1), words(2)
    b[60_000:65_000] = a[30_000:35_000]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert found[1]["n_removed"] == 0 and found[1]["n_words"] == N
    assert found[2]["n_removed"] == 5_000 and found[2]["kept"] == " ".join(b[:60_000] + b[65_000:])


def test_fingerprints_of_long_texts(spark):
    a = words(3)
    b = a[:50_000] + ["changed"] + a[50_001:]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(words(4)))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    for k, w in ((1, a), (2, b)):
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(N - 3)], np.uint64)
        want = sum(1 << bit for bit in range(64) if 2 * int(((hashes >> np.uint64(bit)) & np.uint64(1)).sum()) > len(hashes))
        assert found[k]["fp"] % (1 << 64) == want
    assert found[1]["component_id"] == found[2]["component_id"] == 1 and found[3]["component_id"] == 3


def test_a_benchmark_item_deep_in_a_long_text(spark):
    item, text = words(5, 60), words(6)
    text[90_000:90_060] = item
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(words(7)))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.without_contaminated(docs, benchmark).collect()} == {2}
