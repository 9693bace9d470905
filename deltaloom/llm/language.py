"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte position of a text gets a distribution over the learned languages from the states of
a forward and a backward GRU; a text's probabilities are the mean over its positions. Texts are
lower-cased and cut into windows of ``WINDOW`` bytes, each read from a zero state at either end, so
that a whole slice of the corpus is one batch and no text is too long; every byte is read.

The network is trained on the driver, in numpy, by backpropagation through time with Adam, on
a sample of ``DOCS`` documents of each language (by a hash of the id) and ``SEGMENTS`` windows of
each. Every language is learned: beyond ``LANGUAGES`` of them each has fewer documents, at least
one, so that the sample stays as large. Languages and texts of held-out rows never enter it.

Edge cases: a null text and a text without a letter are ``und`` with score 0; rows without a
language are not learned from; without any learned language everything is ``und``; of equally
likely languages the first by name is taken; a very long text is read whole, window by window;
repeated rows give repeated results; null ids stay null; an empty table gives no rows. Only
doc_id, text and lang are read (lang only to learn), so other columns may have any names;
``accepted`` carries them along.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm._common import broadcast_if_small, held_out, is_letter_text, materialise, narrow, table, text_slices

#: Documents of each language, windows of each document, languages that get so many documents: the
#: sample's bound. With more languages each gets fewer documents.
DOCS = 240
SEGMENTS = 8
LANGUAGES = 64
#: Documents are chosen among so many times more than are needed.
SPARE = 1.5
#: Bytes of a window that is learned from, and of one that is read.
LEARNED = 64
WINDOW = 512
HIDDEN = 10
EPOCHS = 7
BATCH = 256
RATE = 0.02
UNKNOWN = "und"
#: Bytes scored at once, with LANGUAGES languages or fewer.
BLOCK = 1 << 19
#: Probabilities (texts x languages) held at once.
CELLS = 1 << 24

_LETTER = re.compile(r"[^\W\d_]")
_F = np.float32


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def folded(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as rows of ``WINDOW``, used length of each row, text of each row)."""
    n = np.array([len(t) for t in texts])
    rows = -(-n // WINDOW)
    padded = b"".join(t.ljust(r * WINDOW, b"\0") for t, r in zip(texts, rows.tolist(), strict=True))
    text = np.repeat(np.arange(len(texts)), rows)
    length = np.full(len(text), WINDOW)
    last = np.cumsum(rows)[rows > 0] - 1
    length[last] = (n - (rows - 1) * WINDOW)[rows > 0]
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), length, text


class Direction:
    """One GRU: gates z and r, candidate n; inputs are byte embeddings of the gate sums."""

    def __init__(self, rng, hidden: int):
        s = 1 / np.sqrt(hidden)
        self.p = {
            "e": rng.normal(0, 0.3, (256, 3 * hidden)).astype(_F),
            "u": rng.uniform(-s, s, (hidden, 2 * hidden)).astype(_F),
            "v": rng.uniform(-s, s, (hidden, hidden)).astype(_F),
        }

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step: sigmoids are written as 0.5 + 0.5 tanh, with the halves folded into weights."""
        k = h.shape[1]
        a = self.p["e"][x]
        zr = h @ self.p["u"]
        zr += a[:, : 2 * k]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:, :k], zr[:, k:]
        n = (r * h) @ self.p["v"]
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n


class Model:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        k = len(labels)
        self.out = {
            "wf": rng.normal(0, 0.3, (hidden, k)).astype(_F),
            "wb": rng.normal(0, 0.3, (hidden, k)).astype(_F),
            "b": np.zeros(k, _F),
        }

    def parameters(self):
        for group in (self.forward.p, self.backward.p, self.out):
            for name in group:
                yield group, name

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over all positions of full windows; backpropagation through time."""
        rows, steps = x.shape
        kept = {}
        for name, d, order in (
            ("f", self.forward, range(steps)),
            ("b", self.backward, range(steps - 1, -1, -1)),
        ):
            h = np.zeros((rows, self.hidden), _F)
            states = {}
            for t in order:
                new, z, r, n = d.step(x[:, t], h)
                states[t] = (h, z, r, n, new)
                h = new
            kept[name] = states
        grads = {(id(g), n): np.zeros_like(g[n]) for g, n in self.parameters()}
        scale = 1 / (rows * steps)
        loss, dh = 0.0, {"f": {}, "b": {}}
        for t in range(steps):
            hf, hb = kept["f"][t][4], kept["b"][t][4]
            logits = hf @ self.out["wf"] + hb @ self.out["wb"] + self.out["b"]
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            loss -= float(np.log(p[np.arange(rows), y] + 1e-9).sum()) * scale
            p[np.arange(rows), y] -= 1
            p *= scale
            grads[id(self.out), "wf"] += hf.T @ p
            grads[id(self.out), "wb"] += hb.T @ p
            grads[id(self.out), "b"] += p.sum(0)
            dh["f"][t], dh["b"][t] = p @ self.out["wf"].T, p @ self.out["wb"].T
        k = self.hidden
        for name, d, order in (
            ("f", self.forward, range(steps - 1, -1, -1)),
            ("b", self.backward, range(steps)),
        ):
            carry = np.zeros((rows, k), _F)
            ge = grads[id(d.p), "e"]
            for t in order:
                h, z, r, n, _ = kept[name][t]
                g = dh[name][t] + carry
                dz, dn = g * (h - n), g * (1 - z)
                carry = g * z
                dn *= 1 - n * n
                back = dn @ d.p["v"].T
                grads[id(d.p), "v"] += (r * h).T @ dn
                dr = back * h
                carry += back * r
                dzr = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], 1) * 2
                grads[id(d.p), "u"] += h.T @ dzr
                carry += dzr @ d.p["u"].T
                full = np.concatenate([dzr, dn], 1)
                np.add.at(ge, x[:, t], full)
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> float:
        rng = np.random.default_rng(seed)
        m = {(id(g), n): np.zeros_like(g[n]) for g, n in self.parameters()}
        v = {key: np.zeros_like(a) for key, a in m.items()}
        step, loss = 0, 0.0
        total = epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                loss, grads = self.loss_and_gradients(x[part], y[part])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for group, name in self.parameters():
                    key = id(group), name
                    g = np.clip(grads[key], -1, 1)
                    m[key] = 0.9 * m[key] + 0.1 * g
                    v[key] = 0.99 * v[key] + 0.01 * g * g
                    group[name] -= rate * (m[key] / (1 - 0.9**step)) / (
                        np.sqrt(v[key] / (1 - 0.99**step)) + 1e-6
                    )
        return loss

    def position_sums(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each window, the sum over its positions of the label probabilities."""
        order = np.argsort(-length, kind="stable")
        x, size = x[order].T.copy(), length[order]
        active = [int(np.searchsorted(-size, -t, side="left")) for t in range(WINDOW)]
        rows, k = x.shape[1], len(self.labels)
        h = np.zeros((rows, self.hidden), _F)
        ahead = np.empty((WINDOW, rows, k), _F)
        for t in range(WINDOW):
            a = active[t]
            if not a:
                break
            h = self.forward.step(x[t, :a], h[:a])[0]
            np.matmul(h, self.out["wf"], out=ahead[t, :a])
            ahead[t, :a] += self.out["b"]
        h = np.zeros((rows, self.hidden), _F)
        total = np.zeros((rows, k), _F)
        for t in range(WINDOW - 1, -1, -1):
            a = active[t]
            if not a:
                continue
            h[:a] = self.backward.step(x[t, :a], h[:a])[0]
            logits = h[:a] @ self.out["wb"]
            logits += ahead[t, :a]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            total[:a] += logits
        out = np.empty_like(total)
        out[order] = total
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """The pooled label probabilities of each folded text (zeros where it is empty)."""
        x, length, text = windows(texts)
        total = np.zeros((len(texts), len(self.labels)))
        block = max(1, BLOCK // WINDOW * LANGUAGES // max(LANGUAGES, len(self.labels)))
        for at in range(0, len(x), block):
            part = self.position_sums(x[at : at + block], length[at : at + block])
            np.add.at(total, text[at : at + block], part)
        n = np.array([max(1, len(t)) for t in texts])
        return total / n[:, None]


def training_windows(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """At most LANGUAGES x DOCS x SEGMENTS full windows (or SEGMENTS for each language, if that is
    more) and their languages."""
    learn = docs.filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & is_letter_text(F.col("text"))
    )
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("_all"))  # one row for each language
    counts = materialise(counts, "languages")
    languages = counts.count()
    size = max(1, min(DOCS, LANGUAGES * DOCS // max(1, languages)))
    # hashes below a threshold first, so that what is ranked is about what is needed, then a top-n
    share = F.least(F.lit(1.0), (SPARE * size + 30) / F.col("_all"))
    low = learn.select("doc_id", "lang", F.xxhash64("text").alias("_key"), F.xxhash64("doc_id").alias("_h"))
    low = low.join(broadcast_if_small(counts.withColumn("_share", share)), "lang").filter(
        F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * float(1 << 30)
    )
    # repeated rows count once: their product would crowd out other languages
    low = low.groupBy("doc_id", F.col("lang").alias("_lang"), "_key", "_h").agg(F.count(F.lit(1)).alias("_c"))
    by_lang = Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", "doc_id", "_key")
    chosen = low.withColumn("_n", F.row_number().over(by_lang)).filter(F.col("_n") <= size).drop("_h", "_c")
    wide = LEARNED * 3
    spread = F.length("text") / float(SEGMENTS)
    pieces = (
        docs.join(F.broadcast(chosen), "doc_id")  # at most LANGUAGES x DOCS rows, or one for each language
        .filter((F.xxhash64("text") == F.col("_key")) & (F.col("lang") == F.col("_lang")))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
        .select("_lang", "_n", "_k", F.substring("text", (F.col("_k") * spread).cast("int") + 1, F.lit(wide)).alias("_t"))
        .distinct()
        .orderBy("_lang", "_n", "_k", "_t")
    )
    x, y = [], []
    for lang, _, _, text in pieces.collect():
        raw = folded(text)
        if len(raw) >= LEARNED:
            x.append(np.frombuffer(raw[:LEARNED], np.uint8))
            y.append(lang)
        elif has_letter(text):
            x.append(np.frombuffer((raw + b" ").ljust(LEARNED, b" ")[:LEARNED], np.uint8))
            y.append(lang)
    return np.array(x, np.uint8).reshape(-1, LEARNED), y


def fit(docs: DataFrame) -> Model | None:
    x, y = training_windows(narrow(docs, "doc_id", "text", "lang"))
    if not len(x):
        return None
    labels = sorted(set(y))
    model = Model(labels)
    at = {lang: k for k, lang in enumerate(labels)}
    model.train(x, np.array([at[lang] for lang in y]))
    return model


def identify(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    known = [i for i, t in enumerate(texts) if t and model and has_letter(t)]
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    step = max(1, CELLS // len(model.labels)) if known else 1
    for at in range(0, len(known), step):
        part = known[at : at + step]
        p = model.probabilities([folded(texts[i]) for i in part])
        for i, k, best in zip(part, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            lang[i], score[i] = model.labels[k], min(1.0, best)
    return lang, score


def _decode(raw: list[bytes]) -> list[str]:
    return [r.decode("utf-8", "replace") for r in raw]


def _predict(shared):
    def run(batches):
        for batch, raw in text_slices(batches, size=2 << 20):
            lang, score = identify(shared.value, _decode(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = docs.sparkSession
    return (
        narrow(docs, "doc_id", "text")
        .withColumn("held_out", held_out(F.col("doc_id")))
        .mapInArrow(
            _predict(spark.sparkContext.broadcast(model)),
            "doc_id long, held_out boolean, lang_pred string, score double",
        )
    )


def _accept(shared, least: float):
    def run(batches):
        for batch, raw in text_slices(batches, size=2 << 20):
            texts = _decode(raw)
            if shared.value is None:
                keep = [has_letter(t) for t in texts]
            else:
                _, score = identify(shared.value, texts)
                keep = [has_letter(t) and s >= least for t, s in zip(texts, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows, all columns kept, that have a letter and a score of at least ``least``; without a
    model all that have a letter."""
    spark = docs.sparkSession
    return docs.mapInArrow(_accept(spark.sparkContext.broadcast(model), least), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
