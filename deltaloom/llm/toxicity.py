"""Toxicity: a convolutional classifier over hashed word embeddings.

A word's embedding is the sum of rows of six hashed tables: the whole word, its first four, six and
eight bytes, its last four, and its first six with its length (up to ten). Filters of widths 1, 2 and 3 slide over the words of the whole
text; each filter's greatest response (at least zero) goes to a logistic output. It is trained in
numpy with Adam on at most ``SAMPLE`` labelled documents, by a hash of the id, that together have
at most ``SAMPLE_WORDS`` words (the first document always); each is read whole, however long.
Gradients flow through the positions of the maxima. The first coordinate of every table row starts from how
much more often the row occurs in toxic training texts. A fifth of the sample is set aside to fit
the probability scale, and for each language the threshold that errs least on it.

``score`` never sees a language. ``threshold`` and ``flagged`` (score at or above its language's
threshold) are the language-calibrated verdict.

Edge cases: null text is empty and scored like any other; letters A-Z are lower-cased and bytes
that are no letters part words; an id with conflicting labels counts by their mean; without
labels, or with one class only, every score is the smoothed share of toxic labels; languages
unseen in calibration, and null, use ``THRESHOLD``; a very long text is scored whole, and so is a
very long word; repeated rows give repeated results; null ids stay null; an empty table gives no
rows. Only doc_id, text and lang, and of labels doc_id and toxic, are read, so other columns may
have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import Words, held_out, mix, narrow, table, text_slices
from deltaloom.llm.samples import labelled

SAMPLE = 9_000
SAMPLE_WORDS = 6_000_000
THRESHOLD = 0.7
BUCKETS = 1 << 16
TABLES = 6
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 6
BATCH = 64
RATE = 0.01
#: A language needs so many calibration texts of either class for a threshold of its own.
CALIBRATION = 15

_U = np.uint64
_F = np.float32
_LETTERS = bytearray(b" " * 128 + bytes(range(128, 256)))
_LETTERS[65:91] = _LETTERS[97:123] = range(97, 123)
_LETTERS = bytes(_LETTERS)


def tokens(raw: bytes) -> bytes:
    """The runs of letters (bytes beyond ASCII included), lower-cased, joined by one space."""
    return b" ".join(raw.translate(_LETTERS).split())


def rows_of(words: Words) -> np.ndarray:
    """For each word, its row in each table: (words, TABLES)."""
    size = words.end - words.start
    head8 = words.heads(8)
    four, six = head8 & _U(0xFFFFFFFF), head8 & _U(0xFFFFFFFFFFFF)
    last = np.where(size >= 4, words.block[np.maximum(words.end - 4, 0)] & _U(0xFFFFFFFF), four)
    seen = (
        words.hashes(),
        mix(four + _U(1)),
        mix(six + _U(2)),
        mix(last + _U(3)),
        mix(head8 + _U(4)),
        mix(six * _U(11) + np.minimum(size, 10).astype(_U) + _U(5)),
    )
    return np.stack([(s % _U(BUCKETS)).astype(np.uint16) for s in seen], 1)


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.05, (TABLES, BUCKETS, DIM)).astype(_F)
        # one column block for each (width, offset)
        blocks = sum(WIDTHS)
        self.conv = rng.normal(0, 0.3, (DIM, blocks * FILTERS)).astype(_F)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, _F)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(_F)
        self.base = np.zeros(1, _F)
        self.scale = (1.0, 0.0)
        self.constant: float | None = None
        self.threshold: dict[str, float] = {}
        self.conv[0, :FILTERS] = np.abs(self.conv[0, :FILTERS]) + 0.5
        self.out[:FILTERS] = np.abs(self.out[:FILTERS]) + 0.3

    def embed(self, rows: np.ndarray) -> np.ndarray:
        e = self.tables[0][rows[:, 0]]
        for k in range(1, TABLES):
            e += self.tables[k][rows[:, k]]
        return e

    def pooled(self, rows: np.ndarray, first: np.ndarray, where: bool = False):
        """Greatest response of each filter in each text (and the word where it is)."""
        texts = len(first) - 1
        e = self.embed(rows)
        all_ = e @ self.conv
        out = np.zeros((texts, len(WIDTHS) * FILTERS), _F)
        at = np.full(out.shape, -1, np.int64)
        size = np.diff(first)
        block = 0
        for k, width in enumerate(WIDTHS):
            cols = [all_[:, (block + j) * FILTERS : (block + j + 1) * FILTERS] for j in range(width)]
            block += width
            has = size >= width
            if not has.any():
                continue
            n = len(rows) - width + 1
            r = cols[0][:n].copy()
            for j in range(1, width):
                r += cols[j][j : n + j]
            for j in range(1, width):  # windows that would run into the next text
                edge = first[1:-1] - j
                r[edge[(edge >= 0) & (edge < n)]] = -np.inf
            begin = first[:-1][has]
            top = np.maximum.reduceat(r, begin, axis=0)
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            out[has, own] = np.maximum(top + self.bias[own], 0)
            if where:
                place = np.full((texts, FILTERS), -1, np.int64)
                for row, (a, b) in zip(np.flatnonzero(has), zip(begin, first[1:][has], strict=True), strict=True):
                    place[row] = a + r[a : min(b, n)].argmax(0)
                place[out[:, own] <= 0] = -1
                at[:, own] = place
        return (out, at, e) if where else out

    def raw(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first) @ self.out + self.base[0]

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(rows, first) + b, -30, 30).astype(float)))

    def step(self, rows, first, y, state, rate):
        """One Adam step on a batch of texts; only touched table rows change."""
        pooled, at, e = self.pooled(rows, first, where=True)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base[0], -30, 30)))
        err = ((p - y) / len(y)).astype(_F)
        grads = {"out": pooled.T @ err + 1e-4 * self.out, "base": err.sum(keepdims=True)}
        dp = err[:, None] * self.out[None, :]
        dp[at < 0] = 0
        grads["bias"] = dp.sum(0)
        dconv = np.zeros_like(self.conv)
        de = np.zeros_like(e)
        block = 0
        for k, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                col = k * FILTERS + f
                ok = at[:, col] >= 0
                if not ok.any():
                    continue
                pos, g = at[ok, col], dp[ok, col]
                for j in range(width):
                    c = (block + j) * FILTERS + f
                    dconv[:, c] += e[pos + j].T @ g
                    np.add.at(de, pos + j, g[:, None] * self.conv[:, c][None, :])
            block += width
        grads["conv"] = dconv
        state["t"] += 1
        c1, c2 = 1 - 0.9 ** state["t"], 1 - 0.99 ** state["t"]
        for name, g in grads.items():
            m, v = state[name]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            getattr(self, name)[...] -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        used = np.flatnonzero(np.abs(de).sum(1))
        for k in range(TABLES):
            row = rows[used, k]
            who, back = np.unique(row, return_inverse=True)
            g = np.zeros((len(who), DIM), _F)
            np.add.at(g, back, de[used])
            v = state["tables"][k]
            v[who] += g * g
            self.tables[k][who] -= 3 * rate * g / (np.sqrt(v[who]) + 1e-5)

    def start_from_counts(self, rows: np.ndarray, text: np.ndarray, y: np.ndarray) -> None:
        """First coordinates: shrunken log-odds of the rows' document frequencies."""
        pos, neg = y.sum() + 1, len(y) - y.sum() + 1
        for k in range(TABLES):
            pair = np.unique(text.astype(np.int64) * BUCKETS + rows[:, k])
            t, b = pair // BUCKETS, pair % BUCKETS
            a = np.bincount(b[y[t] == 1], minlength=BUCKETS)
            n = np.bincount(b[y[t] == 0], minlength=BUCKETS)
            odds = np.log((a + 0.5) / pos) - np.log((n + 0.5) / neg)
            weight = (a + n) / (a + n + 6.0)
            self.tables[k][:, 0] = np.clip(0.3 * odds * weight, -0.6, 1.0)


def train(rows: list[np.ndarray], y: np.ndarray, lang: list[str | None], seed: int = 1) -> Network:
    """A network fitted on four fifths of the texts and calibrated on the rest."""
    net = Network()
    if len(y) == 0 or y.min() == y.max():
        net.constant = float((y.sum() + 1) / (len(y) + 2))
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]

    def batch(ids):
        first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in ids])])
        return np.concatenate([rows[i] for i in ids]), first

    flat, first = batch(used)
    net.start_from_counts(flat, np.repeat(np.arange(len(used)), np.diff(first)), y[used])
    del flat, first
    state = {"t": 0, "tables": [np.zeros((BUCKETS, DIM), _F) for _ in range(TABLES)]}
    for name in ("out", "base", "bias", "conv"):
        state[name] = (np.zeros_like(getattr(net, name)), np.zeros_like(getattr(net, name)))
    total, done = EPOCHS * -(-len(used) // BATCH), 0
    for _ in range(EPOCHS):
        for at in range(0, len(used), BATCH):
            ids = used[at : at + BATCH]
            net.step(*batch(ids), y[ids].astype(_F), state, RATE * (1 - done / (total + 1)))
            done += 1
        rng.shuffle(used)
    calibrate(net, *batch(held), y[held], [lang[i] for i in held])
    return net


def calibrate(net: Network, rows, first, y, lang) -> None:
    """A logistic scale for the raw outputs, shifted so that its best cut is THRESHOLD; then each
    language's least-error threshold."""
    if len(y) and y.min() != y.max():
        raw = net.raw(rows, first).astype(float)
        mid, spread = np.median(raw), raw.std() + 1e-6
        z = (raw - mid) / spread
        a, b = 1.0, 0.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 1.0 * (((p - y) * z).mean() + 1e-3 * a)
            b -= 1.0 * (p - y).mean()
        a /= spread
        # the cut that errs least (a false alarm counts twice), in the middle of its gap, is THRESHOLD
        order = np.argsort(raw, kind="stable")
        alarms = np.concatenate([[0], np.cumsum((1 - y[order])[::-1])])[::-1]
        misses = np.concatenate([[0], np.cumsum(y[order])])
        cost = 2 * alarms + misses
        best = np.flatnonzero(cost == cost.min())
        best = int(best[len(best) // 2])
        low, high = raw[order[max(best - 1, 0)]], raw[order[min(best, len(raw) - 1)]]
        net.scale = (a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * (low + high) / 2))
    score = net.scores(rows, first)
    lang = np.array([x or "" for x in lang])
    for name in set(lang.tolist()) - {""}:
        own = lang == name
        if min(y[own].sum(), (1 - y[own]).sum()) < CALIBRATION:
            continue
        cuts = np.unique(np.concatenate([[THRESHOLD], np.quantile(score[own], np.linspace(0, 1, 101))]))
        cuts = cuts[(cuts > 0.05) & (cuts < 0.95)]
        errors = [((score[own] >= c) != y[own]).sum() + 1e-3 * abs(c - THRESHOLD) for c in cuts]
        net.threshold[name] = float(cuts[int(np.argmin(errors))]) if len(cuts) else THRESHOLD


def _slice(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of all words, first word of each text)."""
    texts = [tokens(t) for t in raw]
    keep = [i for i, t in enumerate(texts) if t]
    size = np.zeros(len(texts), np.int64)
    if not keep:
        return np.zeros((0, TABLES), np.uint16), np.zeros(len(texts) + 1, np.int64)
    words = Words([texts[i] for i in keep])
    size[keep] = np.diff(words.first)
    return rows_of(words), np.concatenate([[0], np.cumsum(size)])


def _hashed(batches):
    for batch, raw in text_slices(batches):
        rows, first = _slice(raw)
        ids = [rows[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["lang", "y", "rows"]
        )


def _counted(batches):
    for batch, raw in text_slices(batches):
        n = [tokens(t).count(b" ") + 1 for t in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "tkey", "n"])


def within(sizes: list[tuple[int, int, int, int]], bound: int) -> list[tuple[int, int]]:
    """(id, text key) of (order, id, text key, words) in order, as far as their words together stay
    within ``bound``."""
    total, out = 0, []
    for _, id_, key, n in sorted(sizes):
        total += n
        if total > bound and out:
            break
        out.append((id_, key))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    sample = labelled(narrow(docs, "doc_id", "text", "lang"), labels, "toxic", SAMPLE)
    sample = sample.withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    counted = sample.select("doc_id", "tkey", "text").mapInArrow(_counted, "doc_id long, tkey long, n long")
    sizes = (
        counted.groupBy("doc_id", "tkey")  # repeated rows count once
        .agg(F.max("n").alias("n"))
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "tkey", "n")
        .orderBy("h", "doc_id", "tkey")
        .limit(SAMPLE)
        .collect()
    )
    chosen = within([tuple(r) for r in sizes], SAMPLE_WORDS)
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, tkey long")
    sample = sample.join(F.broadcast(few), ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"])
    found = sample.select("lang", "y", "text").mapInArrow(_hashed, "lang string, y int, rows binary").toArrow()
    data = sorted(zip(*(found.column(c).to_pylist() for c in ("y", "rows", "lang")), strict=True), key=lambda r: (r[0], r[1]))
    del found
    rows = [np.frombuffer(r, np.uint16).reshape(-1, TABLES) for _, r, _ in data]
    return train(rows, np.array([y for y, *_ in data], np.int64), [x for *_, x in data])


def _scored(shared):
    def run(batches):
        net = shared.value
        for batch, raw in text_slices(batches):
            score = net.scores(*_slice(raw))
            limit = np.array([net.threshold.get(x, THRESHOLD) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(3),
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                    pa.array(limit),
                    pa.array(score >= limit),
                ],
                ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    return run


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and flagged of every document."""
    spark = docs.sparkSession
    return (
        narrow(docs, "doc_id", "text", "lang")
        .withColumn("held_out", held_out(F.col("doc_id")))
        .mapInArrow(
            _scored(spark.sparkContext.broadcast(net)),
            "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean",
        )
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
