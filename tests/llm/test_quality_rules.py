import random
import re
from collections import Counter

import numpy as np
import pytest

from deltaloom.llm import quality_rules as Q

EDGE = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 400, "# $$ | <b> & * %",
    "same line here\nsame line here\n \n\nother\nsame line here", "é x a b \x85", "A\rB\x0bC\x0cD",
    "a b c d e f g h i j k l " + "q r s t u v " * 3 + "m n o p",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(covered)
    return (
        n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep,
        n < 10 or 100 * rep > 20 * n,
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocab = ["w" * rng.randint(1, 9) + str(i) for i in range(3000)]
    out = [(i, t, "en", "s") for i, t in enumerate(EDGE)]
    for d in range(100, 700):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 400))]
        text = " ".join(words)
        if d % 40 == 0:
            text = " ".join(w + rng.choice(["###", "%%%"]) for w in words)
        elif d % 40 == 1:
            text = "\n".join(w.upper() + "!!" for w in words)
        lang = rng.choice(["en", "en", "de", None])
        out.append((d, text, lang, "hot" if d % 3 else f"s{d}"))
    out += [out[50], (None, "text of a row without id " * 3, "en", None)]
    return out


@pytest.fixture(scope="module")
def result(spark, rows):
    docs = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, _lang int, kept string"
    )
    return Q.assess(docs).collect()


def test_base_statistics(rows, result):
    got = Counter(tuple(r)[:7] for r in result)
    assert got == Counter((d, *brute(t)) for d, t, _, _ in rows)


def test_verdicts(rows, result):
    by = {r.doc_id: r for r in result}
    assert not any(r.kept for r in result if r.base_failed)
    junk = [d for d in range(100, 700) if d % 40 in (0, 1)]
    assert not any(by[d].kept for d in junk)
    assert all(by[d].kept for d in range(100, 700) if d not in junk)


def test_few_rows_and_none(spark):
    schema = "doc_id long, text string, lang string, source string"
    few = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", "s"), (2, "#", None, None)], schema)
    assert {r.doc_id: r.kept for r in Q.assess(few).collect()} == {1: True, 2: False}
    assert Q.assess(spark.createDataFrame([], schema)).count() == 0


def test_quantiles():
    assert abs(Q.chi_square_quantile(5, 0.95) - 11.0705) < 1e-3
    assert abs(Q.chi_square_quantile(2, 1 - 1e-9) - 41.4465) < 1e-3


def test_factor_is_cholesky(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(Q.DIMS, Q.DIMS))
    cov = a @ a.T
    row = {f"c_{i}{j}": float(cov[i, j]) for i, j in Q.PAIRS}
    got = Q.with_factor(spark.createDataFrame([row]), 2.0).first()
    want = np.linalg.cholesky(2 * cov + np.diag(np.array(Q.FLOOR) ** 2))
    assert all(abs(got[f"l_{i}{j}"] - want[i, j]) < 1e-8 for i, j in Q.PAIRS)


def mcd_by_numpy(x, half, floor, starts=200, seed=0):
    """Least log determinant of the regularised covariance over many random starts, to convergence."""
    rng = np.random.default_rng(seed)
    scale = half / Q.gamma_p(Q.DIMS / 2 + 1, Q.chi_square_quantile(Q.DIMS, half) / 2)
    best, h = np.inf, int(np.ceil(half * len(x)))
    for _ in range(starts):
        own = x[rng.choice(len(x), Q.DIMS + 1, replace=False)]
        last = np.inf
        while True:
            cov = scale * np.cov(own.T, bias=True) + np.diag(floor**2)
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-9 and len(own) == h:
                break
            last = det if len(own) == h else np.inf
            d = x - own.mean(0)
            own = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")[:h]]
        best = min(best, det)
    return best


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_determinant_is_near_the_least(spark, share):
    """Against numpy's exhaustive search, with and without a tight cluster of outliers off the axes."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(Q.DIMS, Q.DIMS)) * 0.4
    x = rng.normal(size=(400, Q.DIMS)) @ a
    bad = int(share * len(x))
    x[:bad] = rng.normal(size=(bad, Q.DIMS)) * 0.02 + np.array([1.5, -1.5, 1.5, -1.5, 1.5])
    rows = [(i, "en", "s", *map(float, r)) for i, r in enumerate(x)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} double" for c in Q.XS))
    got = Q.estimates(stats).collect()
    assert len(got) == 3  # one group at each level, the same rows in each
    want = mcd_by_numpy(x, Q.HALF, np.array(Q.FLOOR))
    assert all(r["det"] <= want + 0.1 for r in got), ([r["det"] for r in got], want)
    if bad:  # the mean is that of the others
        for r in got:
            assert all(abs(r[f"m_{i}"] - x[bad:, i].mean()) < 0.2 for i in range(Q.DIMS))


def test_a_long_text(spark):
    import time

    text = " ".join(f"w{i % 5000}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text, "en", "s"), (1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    began = time.time()
    out = Q.assess(docs).collect()
    assert [tuple(r)[:7] for r in out] == [(1, *brute(text))] * 2 and time.time() - began < 60
