import random
import zlib

import numpy as np
import pytest

from deltaloom.llm import quality as Q
from deltaloom.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus():
    """Junk texts are of low quality; texts with a made-up stem are toxic."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for d in range(900):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        junk, toxic = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), "vequ" + rng.choice(vocab))
        if junk:
            words = [w + rng.choice(["###", "%%", "!!"]) for w in words]
        docs.append((d, " ".join(words), "l%d" % (d % 2), "s"))
        if d % 10:
            labels.append((d, int(not junk), int(toxic)))
    docs += [(5000, None, None, None), (5001, "", "l0", "s"), (5002, "!", "l0", "s"), (None, "vequno", None, None), docs[3]]
    labels += [(3, 1, 0), (5000, None, None), (None, 1, 1), (99999, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def sf(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs, labels = corpus
    spark.createDataFrame([(*r, 1.0, 2) for r in docs], "doc_id long, text string, lang string, source string, score double, y int").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.mark.parametrize("query, column, limit", [(Q.op1_quality_classifier, 1, 0.5), (T.op4_toxicity, 2, 0.7)])
def test_held_out_accuracy(spark, sf, corpus, query, column, limit):
    docs, labels = corpus
    out = query(spark, sf).collect()
    assert len(out) == len(docs)
    truth = {r[0]: r[column] for r in labels if r[0] is not None and r[1] is not None and r[0] < 900}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)


def test_learning_ignores_held_out_labels(spark, sf):
    from pyspark.sql import functions as F

    from deltaloom.llm._common import held_out, table

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, flipped)
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    trees = Q.grow(x, y, 30)
    got = trees.scores(x)
    for i in range(0, 500, 37):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            for _ in range(Q.DEPTH):
                node = 2 * node + 1 + int(x[i, f[node]] > t[node])
            total += leaf[node - (2**Q.DEPTH - 1)]
        assert abs(1 / (1 + np.exp(-total)) - got[i]) < 1e-12
    assert ((got >= 0.5) == y).mean() > 0.95


def test_pooling_equals_text_by_text():
    net = T.Network()
    raw = [b"one two THREE four", b"", b"solo", b"a b", b"12 !", "é è words".encode() * 3]
    rows, first = T._slice(raw)
    got = net.pooled(rows, first)
    for i, text in enumerate(raw):
        r, _ = T._slice([text])
        want = np.zeros(got.shape[1])
        e = net.embed(r) if len(r) else np.zeros((0, T.DIM))
        block = 0
        for k, width in enumerate(T.WIDTHS):
            for a in range(len(r) - width + 1):
                v = sum(e[a + j] @ net.conv[:, (block + j) * T.FILTERS : (block + j + 1) * T.FILTERS] for j in range(width))
                own = slice(k * T.FILTERS, (k + 1) * T.FILTERS)
                want[own] = np.maximum(want[own], v + net.bias[own])
            block += width
        assert np.allclose(got[i], want, atol=1e-5)


def test_one_class_and_none(spark):
    docs = spark.createDataFrame([(i, "some text %d" % i, "en") for i in range(20)], "doc_id long, text string, lang string")
    ones = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    for module in (Q, T):
        assert len({r.score for r in module.score(docs, module.fit(docs, ones)).collect()}) == 1
        assert {r.score for r in module.score(docs, module.fit(docs, ones.limit(0))).collect()} == {0.5}
        assert module.score(docs.limit(0), module.fit(docs.limit(0), ones)).count() == 0


def test_whole_words_tell_texts_apart():
    a, b = (T._slice([b"abcdefgh" + middle + b"stuvwxyz"])[0] for middle in (b"iiii", b"jjjj"))
    assert a[0, 0] != b[0, 0] and (a[0, 1:] == b[0, 1:]).all()  # only the whole word differs
    assert T._slice([b"x" * 300])[0].shape == (1, T.TABLES)


def test_sample_is_bounded_by_words_and_keeps_long_texts(spark):
    assert T.within([(3, 30, 0, 10), (1, 10, 0, 50), (2, 20, 0, 40)], 95) == [(10, 0), (20, 0)]
    assert T.within([(1, 10, 0, 500)], 95) == [(10, 0)]
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdaeiou") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for d in range(240):
        words = [word() for _ in range(5000 if d % 4 == 0 else 40)]
        if toxic := d % 3 == 0:
            words[rng.randrange(len(words))] = "zzvequ"
        rows.append((d, " ".join(words), "en"))
        labels.append((d, 1, int(toxic)))
    rows += [rows[0]] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = T.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in T.score(docs, net).collect()}
    long = [d for d in range(0, 240, 4) if out[d].held_out]
    assert np.mean([out[d].predicted == int(d % 3 == 0) for d in long]) > 0.85


@pytest.mark.parametrize("module", [Q, T])
def test_scores_equal_one_text_at_a_time(spark, module, corpus):
    """The query's rows against the model applied to each text alone (a brute-force walk for the trees)."""
    docs, labels = corpus
    df = spark.createDataFrame([r[:3] for r in docs], "doc_id long, text string, lang string")
    model = module.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.doc_id): r.score for r in module.score(df, model).collect()}
    for d, text, *_ in docs[::97] + docs[-5:]:
        raw = (text or "").encode()
        want = model.scores(np.array([Q.statistics(raw)])) if module is Q else model.scores(*T._slice([raw]))
        assert abs(got[d] - float(want[0])) < 1e-5


def test_statistics_of_a_long_and_of_odd_texts():
    import time

    began = time.time()
    long = Q.statistics(b"some words in a line\n" * 100_000)
    assert time.time() - began < 30 and all(np.isfinite(long)) and len(long) == len(Q.NAMES)
    for raw in (b"", b" ", b"\n\n", b"x", b"###", "é".encode() * 1000, b"a" * 100_000):
        assert all(np.isfinite(Q.statistics(raw)))
    by = dict(zip(Q.NAMES, Q.statistics(b"aa bb aa bb\naa bb aa bb"), strict=True))
    assert by["distinct_words"] == pytest.approx(2 / 8, abs=0.2) and by["repeated_lines"] > 0 and by["upper"] == 0


def test_repeated_ids_do_not_change_which_rows_are_learned(spark, monkeypatch):
    """However rows are dealt over tasks, the trees are the same, and so they are where rows are repeated."""
    import numpy as np

    from deltaloom.llm import quality

    monkeypatch.setattr(quality, "SAMPLE", 60)
    rows = [(i % 90, f"text {i % 150} " + "word " * (i % 13)) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = quality.fit(docs.coalesce(1), labels)
    for other in (docs.repartition(7), docs.union(docs).repartition(5, "text")):
        assert all(np.array_equal(a, b) for a, b in zip(vars(one).values(), vars(quality.fit(other, labels)).values(), strict=True))
