"""Near-duplicates by an inverted join over MinHash signature coordinates.

A document's set holds its distinct four-word shingles; documents link when 100 * |A & B| >= 80 * |A | B|.
Documents with equal sets form a class, and all that follows is between classes. A signature has
``K`` coordinates, each the least hash of the set under one hash function; a class is posted under its
(coordinate, value) pairs, and a pair of classes must collide in at least ``MATCHES`` of them.

* *Prefix.* Two signatures that collide ``MATCHES`` times share one of the first ``K - MATCHES + 1`` of
  their pairs in any order that all documents use. The order is rarest first, by a histogram of all
  pairs in ``BUCKETS`` buckets, so pairs of common passages are rarely posted at all.
* *Skip.* The other, longer lists are never merged: postings carry one byte of each coordinate, and
  those that meet in a list count their collisions directly. Bytes collide whenever coordinates do,
  so nothing that reaches ``MATCHES`` is missed. Sizes too far apart for a link are skipped as well.
* *Confirm.* Candidates are compared on their full sets.

A list is searched breadth-first, so it gives one candidate for each class that is near another, not
all pairs. As nearness is not a link, classes that are near some other but still apart are compared
again by longer signatures: ``LONG`` coordinates of a byte each, of which a pair must share ``LEAST``. They
meet under their first ``POSTS`` coordinates. First each gives its nearest one apart, then, what links being
joined, every pair that is apart and passes, in the list where they first agree, so once; nothing is left to
later rounds, and of unlinked pairs only those close below the threshold pass. What already is one component is
passed over.

A pair just at the threshold collides in 48 * 0.8 of 48 coordinates on average; the chance of fewer
than 24 is below 1e-6, that of fewer than ``LEAST`` of ``LONG`` or of no agreement among ``POSTS`` as well, and
smaller above the threshold. Shingles are 64-bit hashes, classes 128-bit ones.

Memory: 72 bytes for each class in the longest list, some 850 for each that is near another. The histogram is
65,536 numbers whatever the input; a value that more than one class in some 1,400 has is thereby known as
common, and rarer ones are not told apart. Nothing else reaches the driver but counts.

Edge cases: null text, and text without words, have an empty set, n_shingles 0, and are their own
component; fewer than four words are one shingle; very long texts are read whole; repeated rows and
equal texts are one class, and all its rows are returned; a null doc_id joins its component, whose id
is the least non-null doc_id, and is kept only where the component has none; an empty table gives no
rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import (
    LOWER_TO_SPACE,
    Words,
    grams,
    inside,
    materialise,
    mix,
    narrow,
    single_spaced,
    table,
    text_slices,
)
from deltaloom.llm.components import components

SHINGLE = 4
K, MATCHES = 48, 24
PREFIX = K - MATCHES + 1
BUCKETS = 1 << 16
#: Lists of at most so many classes give all their near pairs at once.
SMALL_RUN = 8
#: Coordinates of a long signature, how many of them (a byte each) a link shares, and under how many it is posted.
LONG, LEAST, POSTS = 768, 558, 10
#: A part of the long signature that is compared first, and how much of it a link shares.
PART, PART_LEAST = 96, 50

_U = np.uint64
#: Odd multipliers, one for each coordinate.
FACTORS = mix(np.arange(1, LONG + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
#: Bytes of a posting: a class of 16, its size in 4, a byte of each coordinate.
WIDTH = 16 + 4 + K


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct shingle hashes of each text, one text after another."""
    spaced = [single_spaced(t, LOWER_TO_SPACE) for t in texts]
    words = np.array([t.count(b" ") + 1 if t else 0 for t in spaced], np.int64)
    long = np.flatnonzero(words >= SHINGLE)
    owner, found = [], []
    if len(long):
        w = Words([spaced[k] for k in long])
        ok = inside(w.first, SHINGLE, len(w))
        found.append(grams(w.hashes(), SHINGLE)[ok])
        owner.append(np.repeat(long, words[long] - SHINGLE + 1))
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    found.append(np.array([xxhash.xxh64_intdigest(spaced[k], SHINGLE) for k in short], _U))
    owner.append(short)
    h, at = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[first], at[first]
    return h, np.searchsorted(at, np.arange(len(texts)), "right")


def signatures(h: np.ndarray, ends: np.ndarray, size: int = K) -> np.ndarray:
    """A row of ``size`` unsigned 32-bit values for each set; sets must not be empty."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty((len(ends), size), np.uint32)
    for k in range(size):
        out[:, k] = mix(np.minimum.reduceat(h * FACTORS[k], starts)).astype(np.uint32)
    return out


def _described(batches):
    for batch, texts in text_slices(batches, size=2 << 20):
        h, ends = shingle_sets(texts)
        n = np.diff(np.concatenate([[0], ends]))
        some = np.flatnonzero(n)
        sig: list[bytes | None] = [None] * len(texts)
        if len(some):
            for k, row in zip(some.tolist(), signatures(h, ends[some]), strict=True):
                sig[k] = row.tobytes()
        own = [xxhash.xxh3_128_digest(h[e - c : e].tobytes()) if c else None for e, c in zip(ends, n, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(n), pa.array(sig, pa.binary())],
            ["doc_id", "tkey", "class", "n", "sig"],
        )


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, class, n, sig) of every row; class and sig are null for empty sets."""
    keyed = narrow(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    return keyed.mapInArrow(_described, "doc_id long, tkey long, class binary, n long, sig binary")


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equally long values as rows of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[at : at + len(column) * width].reshape(-1, width)


def pair_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each (coordinate, value) pair."""
    return mix(sig.astype(_U) | (np.arange(sig.shape[1], dtype=_U) << _U(32)))


def _histogram(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        if batch.num_rows:
            keys = pair_keys(fixed(batch.column(0), 4 * K).view("<u4"))
            total += np.bincount((keys & _U(BUCKETS - 1)).astype(np.int64).ravel(), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def histogram(classes: DataFrame) -> np.ndarray:
    """How many (coordinate, value) pairs of all classes fall into each bucket."""
    rows = classes.select("sig").mapInArrow(_histogram, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def postings(classes: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, held) for each pair in the prefix of each class (class, n, sig)."""
    shared = classes.sparkSession.sparkContext.broadcast(common)  # BUCKETS numbers

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                some = batch.slice(at, 4_096)
                sig = fixed(some.column(2), 4 * K).view("<u4")
                keys = pair_keys(sig)
                often = shared.value[(keys & _U(BUCKETS - 1)).astype(np.int64)]
                order = np.argsort(keys, 1)
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(often, order, 1), 1, kind="stable"), 1)
                keys = np.take_along_axis(keys, order[:, :PREFIX], 1)
                size = some.column(1).to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8).reshape(-1, 4)
                held = np.concatenate([fixed(some.column(0), 16), size, sig.astype(np.uint8)], 1)
                rows = [h.tobytes() for h in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array([r for r in rows for _ in range(PREFIX)], pa.binary())],
                    ["key", "held"],
                )

    # sets of three shingles or fewer link with equal ones only; four link with five that hold them (80 of 100)
    return classes.filter("n > 3").select("class", "n", "sig").mapInArrow(post, "key long, held binary")


class Run:
    """The classes of some lists: ``name`` (16 bytes each), ``size`` and ``sig``."""

    def __init__(self, held: np.ndarray):
        self.name = np.ascontiguousarray(held[:, :16]).view("S16").ravel()
        self.raw = held[:, :16]
        self.size = np.ascontiguousarray(held[:, 16:20]).view("<u4").ravel().astype(np.int64)
        self.sig = np.ascontiguousarray(held[:, 20:])

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` may link with ``x``: sizes that allow it and enough collisions."""
        a, b = self.size[x], self.size[others]
        ok = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
        at = np.flatnonzero(ok)
        ok[at] = (self.sig[others[at]] == self.sig[x]).sum(1) >= MATCHES
        return ok


def searched(run: Run, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first: near pairs (x, y) that connect all that is near, one for each class reached."""
    left, out = at, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = run.near(x, left)
            out.append((np.full(near.sum(), x), left[near]))
            queue.extend(left[near].tolist())
            left = left[~near]
    return out


def small_pairs(run: Run, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All near pairs within the runs numbered by ``group`` (each of at most ``SMALL_RUN``)."""
    out = []
    for step in range(1, SMALL_RUN):
        at = np.flatnonzero(group[:-step] == group[step:])
        if not len(at):
            break
        a, b = run.size[at], run.size[at + step]
        at = at[5 * np.minimum(a, b) >= 4 * np.maximum(a, b)]
        at = at[(run.sig[at] == run.sig[at + step]).sum(1) >= MATCHES]
        out.append((at, at + step))
    return out


class LongRun:
    """Near classes of some lists, with the label of their component and long signatures."""

    def __init__(self, held: np.ndarray):
        self.raw = held[:, :16]
        self.name = np.ascontiguousarray(self.raw).view("S16").ravel()
        self.label = np.unique(np.ascontiguousarray(held[:, 16:32]).view("V16").ravel(), return_inverse=True)[1]
        self.size = np.ascontiguousarray(held[:, 32:36]).view("<u4").ravel().astype(np.int64)
        self.at = held[:, 36]
        self.first = np.ascontiguousarray(held[:, 37 : 37 + 4 * POSTS]).view("<u4")
        self.sig = held[:, 37 + 4 * POSTS :]

    def apart(self, at: np.ndarray, nearest: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the list ``at`` of different labels that may link, where this is the first list that both are in; or of
        each class outside the commonest label just the ``nearest`` one of another."""
        labels, which, many = np.unique(self.label[at], return_inverse=True, return_counts=True)
        if len(labels) < 2:
            return []
        out, most, here = [], many.argmax(), self.at[at[0]]
        for k in np.flatnonzero(which != most):
            ok = which != which[k]
            if not nearest:
                ok &= (which == most) | (np.arange(len(at)) > k)
            x, y = at[k], at[ok]
            a, b = self.size[x], self.size[y]
            y = y[5 * np.minimum(a, b) >= 4 * np.maximum(a, b)]
            if not nearest:
                y = y[(self.first[y, :here] != self.first[x, :here]).all(1)]
            y = y[(self.sig[y, :PART] == self.sig[x, :PART]).sum(1) >= PART_LEAST]
            shared = (self.sig[y] == self.sig[x]).sum(1)
            y = y[shared >= LEAST] if not nearest else y[[shared.argmax()]] if len(y) and shared.max() >= LEAST else y[:0]
            out.append((np.full(len(y), x), y))
        return out


def _first(held: np.ndarray, starts: np.ndarray, size: np.ndarray):
    run = Run(held)
    small = np.where(np.repeat(size <= SMALL_RUN, size), np.repeat(np.arange(len(size)), size), -1 - np.arange(len(held)))
    out = small_pairs(run, small)
    for k in np.flatnonzero(size > SMALL_RUN):
        out += searched(run, np.arange(starts[k], starts[k] + size[k]))
    return run, out


def _apart(nearest: bool):
    def search(held: np.ndarray, starts: np.ndarray, size: np.ndarray):
        run, out = LongRun(held), []
        for k in np.flatnonzero(size > 1):
            out += run.apart(np.arange(starts[k], starts[k] + size[k]), nearest)
        return run, out

    return search


def runs(batches, search, width: int):
    """Sorted (key, held) rows in; candidates (a, b) out. A list of one key may span batches."""

    def made(key, held):
        cuts = np.flatnonzero(np.diff(key)) + 1
        size = np.diff(np.concatenate([[0], cuts, [len(key)]]))
        if (size < 2).all():
            return None
        run, out = search(held, np.concatenate([[0], cuts]), size)
        x, y = (np.concatenate([o[k] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for k in (0, 1))
        if not len(x):
            return None
        swap = run.name[x] > run.name[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pairs = [r.tobytes() for r in np.unique(np.concatenate([run.raw[x], run.raw[y]], 1).view("V32").ravel())]
        return pa.RecordBatch.from_arrays([pa.array([p[k : k + 16] for p in pairs], pa.binary()) for k in (0, 16)], ["a", "b"])

    kept: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        kept.append((key, fixed(batch.column(1), width)))
        if key[0] == key[-1] or sum(len(k[0]) for k in kept) * width < 4 << 20:
            continue
        key, held = (np.concatenate(x) for x in zip(*kept, strict=True))
        cut = np.searchsorted(key, key[-1])
        if cut and (found := made(key[:cut], held[:cut])):
            yield found
        kept = [(key[cut:], held[cut:])]
    if kept and (found := made(*(np.concatenate(x) for x in zip(*kept, strict=True)))):
        yield found


def _candidates(posted: DataFrame, rows: int, search, width: int) -> DataFrame:
    spark = posted.sparkSession
    # about 64 MB of postings to a task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * (width + 40) >> 26)
    dealt = posted.repartition(tasks, "key").sortWithinPartitions("key", "held")
    return dealt.mapInArrow(lambda batches: runs(batches, search, width), "a binary, b binary").distinct()


def _long_posts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            lists = some.column(2)
            h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sig = signatures(h, np.cumsum(n), LONG)
            head = np.concatenate([fixed(some.column(0), 16), fixed(some.column(1), 16), n.astype("<u4").view(np.uint8).reshape(-1, 4)], 1)
            first = np.ascontiguousarray(sig[:, :POSTS]).astype("<u4").view(np.uint8).reshape(len(n), -1)
            rest = np.concatenate([first, sig.astype(np.uint8)], 1)
            keys = pair_keys(sig[:, :POSTS])
            held = [a.tobytes() + bytes([k]) + b.tobytes() for a, b in zip(head, rest, strict=True) for k in range(POSTS)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(held, pa.binary())], ["key", "held"])


LONG_WIDTH = 16 + 16 + 4 + 1 + 4 * POSTS + LONG


def _sets(batches):
    for batch, texts in text_slices(batches):
        h, ends = shingle_sets(texts)
        signed = pa.array(h.view(np.int64))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, signed)], ["class", "shingles"])


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, shingles) of each of ``classes`` (class, rep), from the text of its representative."""
    wanted = classes.select("class", F.col("rep.doc_id").alias("_doc"), F.col("rep.tkey").alias("_tkey"))
    text = narrow(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    if wanted.count() <= 500_000:  # 40 bytes each
        wanted = F.broadcast(wanted)
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_tkey"))
    return text.join(wanted, on).select("class", "text").mapInArrow(_sets, "class binary, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) of the ``pairs`` (a, b) whose full sets link."""
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return pairs.join(b, "b").join(a, "a").filter(100 * both >= 80 * either).select(F.col("a").alias("u"), F.col("b").alias("v"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, root) of every class that is linked with another; ``classes`` is (class, n, sig, rep)."""
    common = histogram(classes)
    tried = _candidates(postings(classes, common), classes.count() * PREFIX, _first, WIDTH)
    tried = materialise(tried, "candidates")
    near = materialise(tried.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "near")
    sets = materialise(full_sets(docs, classes.join(near, "class")).dropDuplicates(["class"]), "shingle-sets")
    edges = materialise(confirmed(tried, sets), "edges")
    for search in (_apart(nearest=True), _apart(nearest=False)):
        roots = _roots(edges)
        labelled = sets.join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("label"), "shingles")
        posted = labelled.mapInArrow(_long_posts, "key long, held binary")
        apart = materialise(_candidates(posted, near.count() * POSTS, search, LONG_WIDTH), "candidates")
        fresh = materialise(confirmed(apart, sets), "edges")
        if fresh.take(1):
            edges, roots = edges.unionByName(fresh), None
    return _roots(edges) if roots is None else roots


def _roots(edges: DataFrame) -> DataFrame:
    return materialise(components(edges), "roots").select(F.col("node").alias("class"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    rows = materialise(described(docs), "described")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("rep")
    classes = materialise(
        rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("n").alias("n"), F.min("sig").alias("sig"), rep), "classes"
    )
    roots = links(docs, classes)
    named = materialise(
        classes.select("class", F.col("rep.doc_id").alias("least")).join(roots, "class", "left")
        .select("class", "least", F.coalesce("root", "class").alias("root")), "named"
    )
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    by_class = named.join(least, "root").select("class", "component")
    out = rows.select("doc_id", "class", "n").join(by_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
