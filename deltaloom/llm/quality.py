"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are of the whole text: lengths, shares of kinds of characters, repetition of words,
word pairs and lines. Trees are grown level by level from histograms of at most ``BINS`` bins, on
a sample of at most ``SAMPLE`` labelled documents on the driver, and flattened into arrays
(feature, threshold, leaf) in heap order, so that all rows walk all trees together in numpy.

Edge cases: null text is empty and is scored like any other; unlabelled documents are scored;
an id with conflicting labels counts by their mean; without labels, or with one class only, every
score is the smoothed share of label 1; repeated rows give repeated results; null ids stay null
(not held out); equal scores need no order; a very long text is read whole, one at a time; an
empty table gives no rows. Only doc_id and text, and of labels doc_id and quality, are read, so
other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import (
    TO_SPACE,
    held_out,
    narrow,
    table,
    text_slices,
)
from deltaloom.llm.samples import labelled

SAMPLE = 20_000
BINS = 64
TREES = 90
DEPTH = 4
RATE = 0.12
L2 = 2.0
LEAST_WEIGHT = 4.0

_MARKS = b"#*$%&|<>!?.,;:'\"()[]{}=_-/@+"
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[list(b" \t\n\x0b\x0c\r")] = 4
_CLASS[list(_MARKS)] = 5
_CLASS[128:] = 6
NAMES = [
    "log_words", "word_length", "long_words", "upper", "digit", "space", "mark", "beyond", "symbols", "bars",
    "shouts", "stops", "distinct_words", "top_word", "doubled_words", "distinct_pairs", "distinct_triples",
    "repeated_lines", "line_length", "entropy", "title_words", "odd_ends",
]


def statistics(raw: bytes) -> list[float]:
    """The vector of ``NAMES`` for one text."""
    words = raw.translate(TO_SPACE).split()
    n, size = len(words), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7) / size
    p = counts[counts > 0] / size
    d = max(1, n)
    top = Counter(words).most_common(1)[0][1] if n else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    pairs = len(set(zip(words, words[1:], strict=False)))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / d,
        sum(len(w) > 15 for w in words) / d,
        float(kinds[2]), float(kinds[3]), float(kinds[4]), float(kinds[5]), float(kinds[6]),
        of(b"#*$%&<>") / d,
        raw.count(b"|") / d,
        raw.count(b"!") / d,
        of(b".?") / d,
        len(set(words)) / d,
        top / d,
        sum(map(eq, words, words[1:])) / d,
        pairs / max(1, n - 1),
        triples / max(1, n - 2),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(size / max(1, len(lines)))),
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        sum(w[:1].isupper() for w in words) / d,
        sum(w[-1:] in (b"#", b"%", b"&", b"$", b"*", b"|", b"!") for w in words) / d,
    ]


class Trees:
    """Boosted trees in heap order: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        rows, trees = len(x), len(self.feature)
        total = np.full(rows, self.base)
        if trees and rows:
            tree = np.arange(trees)[None, :]
            at = np.zeros((rows, trees), np.int64)
            row = np.arange(rows)[:, None]
            for _ in range(DEPTH):
                value = x[row, self.feature[tree, at]]
                at = 2 * at + 1 + (value > self.threshold[tree, at])
            total += self.leaf[tree, at - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Second-order boosting of the logistic loss."""
    inner = 2**DEPTH - 1
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    none = np.zeros((0, inner), np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, none, none.astype(float), np.zeros((0, 2**DEPTH)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    features = x.shape[1]
    raw = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)  # within its level
        for level in range(DEPTH):
            width = 2**level
            best = np.zeros(width)
            cut = np.full(width, BINS)
            pick = np.zeros(width, np.int64)
            for k in range(features):
                key = node * BINS + binned[:, k]
                hg = np.bincount(key, g, width * BINS).reshape(width, BINS)
                hh = np.bincount(key, h, width * BINS).reshape(width, BINS)
                lg, lh = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
                tg, th = hg.sum(1, keepdims=True), hh.sum(1, keepdims=True)
                gain = lg**2 / (lh + L2) + (tg - lg) ** 2 / (th - lh + L2) - tg**2 / (th + L2)
                gain[(lh < LEAST_WEIGHT) | (th - lh < LEAST_WEIGHT)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-12
                best[better], cut[better], pick[better] = top[better], at[better], k
            first = width - 1
            for i in np.flatnonzero(best > 0):
                f[first + i] = pick[i]
                t[first + i] = edges[pick[i]][cut[i]] if cut[i] < len(edges[pick[i]]) else np.inf
            node = 2 * node + (x[np.arange(len(y)), f[first + node]] > t[first + node])
        sums = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        own = -RATE * sums[0] / (sums[1] + L2)
        raw += own[node]
        feature.append(f)
        threshold.append(t)
        leaf.append(own)
    return Trees(base, np.stack(feature), np.stack(threshold), np.stack(leaf))


def _vectors(batches):
    for batch, raw in text_slices(batches):
        rows = [statistics(t) for t in raw]
        flat = pa.array(np.array(rows).reshape(-1), pa.float64())
        lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["doc_id", "tkey", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from at most ``SAMPLE`` labelled documents that are not held out; repeated rows count once."""
    sample = labelled(narrow(docs, "doc_id", "text"), labels, "quality", SAMPLE)
    rows = (
        sample.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "y", "text")
        .mapInArrow(_vectors, "doc_id long, tkey long, y int, x array<double>")
        .dropDuplicates(["doc_id", "tkey"])  # rows of one id and text have the same statistics and label
        .orderBy(F.xxhash64("doc_id"), "doc_id", "tkey")
        .limit(SAMPLE)
        .collect()
    )
    x = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES))
    y = np.array([r["y"] for r in rows], float)
    order = np.lexsort((*x.T, y))  # the order of rows does not depend on the partitions
    return grow(x[order], y[order])


def _scored(shared):
    def run(batches):
        for batch, raw in text_slices(batches):
            score = shared.value.scores(np.array([statistics(t) for t in raw]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    return (
        narrow(docs, "doc_id", "text")
        .withColumn("held_out", held_out(F.col("doc_id")))
        .mapInArrow(
            _scored(spark.sparkContext.broadcast(trees)),
            "doc_id long, held_out boolean, score double, predicted int",
        )
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
