import random
import zlib

import numpy as np
import pytest

from deltaloom.llm import language as G


def test_gradients(monkeypatch):
    monkeypatch.setattr(G, "_F", np.float64)
    model = G.Model(["a", "b", "c"], hidden=5)
    for group, name in model.parameters():
        group[name] = group[name].astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (7, 9)).astype(np.uint8), rng.integers(0, 3, 7)
    _, grads = model.loss_and_gradients(x, y)
    for group, name in model.parameters():
        at = (int(x[0, 0]), 3) if name == "e" else tuple(0 for _ in group[name].shape)
        old, eps, ends = group[name][at], 1e-5, []
        for sign in (1, -1):
            group[name][at] = old + sign * eps
            ends.append(model.loss_and_gradients(x, y)[0])
        group[name][at] = old
        assert abs((ends[0] - ends[1]) / 2 / eps - grads[id(group), name][at]) < 1e-7


def test_pooling_equals_position_by_position():
    model = G.Model(["a", "b"], seed=3)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc xyz") for _ in range(n)) for n in (1, 5, 64, 65, 200)]
    got = model.probabilities(texts)
    for t, p in zip(texts, got, strict=True):
        want = []
        for at in range(0, len(t), G.WINDOW):
            w = np.frombuffer(t[at : at + G.WINDOW], np.uint8)
            hf, hb, f = np.zeros((1, G.HIDDEN), np.float32), np.zeros((1, G.HIDDEN), np.float32), []
            for b in w:
                hf = model.forward.step(np.array([b]), hf)[0]
                f.append(hf)
            for k in range(len(w) - 1, -1, -1):
                hb = model.backward.step(w[k : k + 1], hb)[0]
                z = np.exp(f[k] @ model.out["wf"] + hb @ model.out["wb"] + model.out["b"])[0]
                want.append(z / z.sum())
        assert np.allclose(np.mean(want, 0), p, atol=1e-5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    stems = {"xa": ["the", "ing", "ou", "wh", "sh"], "yb": ["für", "sch", "ung", "ß", "ei"]}
    out = []
    for d in range(260):
        lang = ("xa", "yb")[d % 2]
        text = " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60)))
        out.append((d, text.upper() if d % 9 == 0 else text, None if d % 11 == 0 else lang))
    return out + [(1000, None, "xa"), (1001, "", "xa"), (1002, "123 !?", "yb"), (1003, "²", None), (None, "schung für", None), out[5]]


def test_query(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = G.op8_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (1000, 1001, 1002, 1003))
    assert by[None].lang_pred == "yb" and by[None].held_out is False
    good = [by[d].lang_pred == ("xa", "yb")[d % 2] for d in range(260) if by[d].held_out]
    assert np.mean(good) > 0.98 and all(0 <= r.score <= 1 for r in out)
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in range(260))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(2, "words here", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in G.predict(docs, G.fit(docs)).collect()] == ["und"]
    none = docs.limit(0)
    assert G.predict(none, G.fit(none)).count() == 0


def test_every_language_is_learned(spark):
    n = G.LANGUAGES + 6
    texts = [f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 40 for k in range(n)]
    rows = [(i * n + k, f"{texts[k]} {i}", f"l{k:03}") for i in range(3) for k in range(n)]
    docs = spark.createDataFrame([*rows, *[rows[0]] * 50], "doc_id long, text string, lang string")
    x, y = G.training_windows(docs)
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert set(y) == learned and len(learned) > G.LANGUAGES and len(x) == len(y) <= n * 3 * G.SEGMENTS


def test_more_languages_have_fewer_documents(spark, monkeypatch):
    monkeypatch.setattr(G, "LANGUAGES", 2)
    monkeypatch.setattr(G, "DOCS", 6)
    rows = [(i, f"{'abc'[i % 3] * 3} " * 40, "abc"[i % 3]) for i in range(90)]
    _, y = G.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang: y.count(lang) for lang in "abc"} == dict.fromkeys("abc", 4 * G.SEGMENTS)


def test_blocks_shrink_with_languages(monkeypatch):
    model = G.Model(["a", "b", "c"], seed=3)
    texts = [b"abc xyz " * n for n in range(1, 40)]
    whole = model.probabilities(texts)
    monkeypatch.setattr(G, "LANGUAGES", 1)
    monkeypatch.setattr(G, "BLOCK", 20)
    assert np.allclose(model.probabilities(texts), whole, atol=1e-5)
    lang, score = G.identify(model, [None, *[t.decode() for t in texts]])
    monkeypatch.setattr(G, "CELLS", 15)
    again, cut = G.identify(model, [None, *[t.decode() for t in texts]])
    assert again == lang and lang[0] == "und" and np.allclose(cut, score, atol=1e-5)


def test_extreme_logits_and_long_texts():
    model = G.Model(["a", "b", "c"])
    for name in ("wf", "wb"):
        model.out[name] *= 0
    model.out["b"][:] = (-500, -505, -600)  # all far below zero: no 0/0
    p = model.probabilities([b"some text", b"x" * 100_000])
    assert np.isfinite(p).all() and (p.argmax(1) == 0).all() and abs(p.sum(1) - 1).max() < 1e-4


def test_query_equals_one_text_at_a_time(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"{'the cat and the dog' if i % 2 else 'der hund und die katze'} {i}", "en" if i % 2 else "de") for i in range(200)]
    rows += [(1000, None, "en"), (1001, "123", "de"), (None, "the cat", None), rows[0], rows[0], (1002, "the cat and the dog " * 5000, "en")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, _lang int, _key string")
    model = G.fit(df)
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 4)) for r in G.predict(df, model).collect()), key=str)
    want = []
    for d, text, _ in rows:
        lang, score = G.identify(model, [text])
        want.append((d, lang[0], round(score[0], 4)))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=str)]
    assert G.predict(df.limit(0), G.fit(df.filter(F.lit(False)))).count() == 0


def test_hot_language_is_not_ranked_whole(spark):
    """Of a language with most rows only about the rows needed are ranked; the same documents are chosen."""
    rows = [(i, f"words in a text number {i}", "en") for i in range(4000)] + [(10_000 + i, f"texte nummer {i}", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, y = G.training_windows(df)
    assert y.count("de") > 0 and y.count("en") <= G.DOCS * G.SEGMENTS and len({r.tobytes() for r in x}) > 200
