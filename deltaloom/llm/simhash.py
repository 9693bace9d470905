"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's 64-bit fingerprint holds the majority of the XXH64 bits of its four-word shingles.
Fingerprints link when they differ in at most four bits. The 64 bits are three segments of
22, 21 and 21 bits, each decoded to the indices of nearby codewords. With at most four errors
either no segment has more than two, or one has three or four and of the others one has none and
the other at most one (pigeonhole). So a fingerprint gets the keys

* (Golay key of every segment, for two errors each), and
* (exact segment, Golay key of another segment for one error) for six ordered pairs,

about 170 in all, of 33 to 36 bits. Fingerprints that share a key meet in one sorted run; each
run is searched breadth-first and emits one edge for each fingerprint that is linked to the
run's component, never all pairs. Every link is verified by counting bits, so none is lost and
none invented. With keys this wide a run holds what is close and little else: of 10**9 unrelated
fingerprints a run would hold about three. Components of the fingerprints, not of the rows, are
then contracted.

Exact copies collapse to one fingerprint before any key is made. Memory: eight bytes for each
distinct fingerprint in the largest run.

Edge cases: null or empty text has fingerprint zero and links like any other; a very long text is
read whole, one slice at a time; a bit set in exactly half of the shingles is 0; repeated rows
give repeated rows of the result; a null doc_id joins its component, whose id is the least
non-null doc_id (null if it has none); of rows that tie for a component's representative the one
with the least text hash stays, once; an empty table gives no rows. Only doc_id and text are
read, so other columns may have any names; ``representatives`` carries them along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import golay
from deltaloom.llm._common import (
    LOWER_TO_SPACE,
    input_bytes,
    materialise,
    mix,
    narrow,
    single_spaced,
    table,
    text_slices,
)
from deltaloom.llm.components import components

SHINGLE = 4
SEED = 42
ERRORS = 4
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Runs of at most so many fingerprints compare all their pairs at once.
SMALL_RUN = 24

_U = np.uint64
_LANES = np.array(
    [sum(1 << (8 * bit) for bit in range(8) if byte >> bit & 1) for byte in range(256)], _U
)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    cols = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    cuts = np.arange(0, len(hashes), 255)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[cols[:, byte]], cuts)
        total[8 * byte : 8 * byte + 8] = (
            lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        )
    bits = np.flatnonzero(2 * total > len(hashes))
    return int(sum(1 << int(b) for b in bits))


def text_fingerprint(raw: bytes) -> int:
    text = single_spaced(raw, LOWER_TO_SPACE)
    if not text:
        return 0
    cuts = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = [0, *(cuts + 1).tolist()]
    ends = [*cuts.tolist(), len(text)]
    if len(starts) <= SHINGLE:
        return fingerprint(np.array([xxhash.xxh64_intdigest(text, SEED)], _U))
    digest = xxhash.xxh64_intdigest
    n = len(starts) - SHINGLE + 1
    made = (digest(text[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False))
    return fingerprint(np.fromiter(made, _U, n))


def _fingerprints(batches):
    for batch, texts in text_slices(batches):
        found = np.array([text_fingerprint(t) for t in texts], _U).view(np.int64)
        own = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], _U).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(own), pa.array(found)], ["doc_id", "tkey", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, fp) for every row: tkey hashes the raw text, as ``xxhash64`` does; fp holds
    the unsigned fingerprint's bits as a long."""
    return narrow(docs, "doc_id", "text").mapInArrow(
        _fingerprints, "doc_id long, tkey long, fp long"
    )


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs; fingerprints within four bits share a key."""
    fps = fps.view(_U)
    parts = [(fps >> _U(s)) & _U((1 << b) - 1) for s, b in SEGMENTS]
    wide = [golay.keys(p) for p in parts]
    rows, out = product(wide[0], wide[1], len(fps))
    rows, out = product((rows, out), wide[2], len(fps))
    rows, out = [rows], [out]
    near = [golay.near_keys(p) for p in parts]
    tag = 1
    for exact in range(3):
        for fuzzy in range(3):
            if exact == fuzzy:
                continue
            at, key = near[fuzzy]
            rows.append(at)
            out.append(_U(tag << 40) | (parts[exact][at] << _U(12)) | key.astype(_U))
            tag += 1
    return np.concatenate(rows), np.concatenate(out)


def product(a, b, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of every key of ``a`` with every key of ``b`` of the same of ``n`` rows."""
    (at, one), (bt, two) = a, b
    first = np.searchsorted(bt, np.arange(n + 1))
    many = np.diff(first)[at]  # how many keys of b meet each key of a
    spread = np.repeat(np.arange(len(at)), many)
    inner = np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)
    key = (one[spread].astype(_U) << _U(12)) | two[first[at[spread]] + inner].astype(_U)
    return at[spread], key


def _keyed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):  # some 340,000 keys at once
            fps = batch.column(0).slice(at, 2_000).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, key = fuzzy_keys(fps)
            # mixed, so that sorting by key and dealing by key both spread evenly
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(key).view(np.int64)), pa.array(fps[rows])], ["key", "fp"]
            )


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(_U))


def run_edges(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (member, root) of the components among ``fps`` linked within ``ERRORS`` bits."""
    left = np.unique(fps)
    out = []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        queue, members = [seed], []
        while queue and len(left):
            near = distance(left, queue.pop()) <= ERRORS
            members.append(left[near])
            queue.extend(left[near])
            left = left[~near]
        found = np.concatenate([left[:0], *members])
        out.append((found, np.full(len(found), seed)))
    return out


def _linked(batches):
    """Sorted (key, fp) rows in, edges (u, v) out; a run may span batches."""

    def edges(key: np.ndarray, fp: np.ndarray):
        cuts = np.flatnonzero(np.diff(key)) + 1
        first = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([first, [len(key)]]))
        out = []
        if (size > 1).any():
            small = np.repeat(size <= SMALL_RUN, size)
            for step in range(1, SMALL_RUN):
                a, b = fp[:-step], fp[step:]
                if not len(a):
                    break
                same = (key[:-step] == key[step:]) & small[:-step]
                if not same.any():
                    break
                at = np.flatnonzero(same)
                at = at[(distance(a[at], b[at]) <= ERRORS) & (a[at] != b[at])]
                out.append((a[at], b[at]))
            for k in np.flatnonzero(size > SMALL_RUN):
                out += run_edges(fp[first[k] : first[k] + size[k]])
        if not out:
            return None
        pair = np.stack([np.concatenate(x) for x in zip(*out, strict=True)], 1)
        pair = np.unique(np.sort(pair, 1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(pair[:, 1].copy()), pa.array(pair[:, 0].copy())], ["u", "v"]
        )

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        held.append((key, fp))
        if key[0] == key[-1] or sum(len(k) for k, _ in held) < 1 << 16:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = np.searchsorted(key, key[-1])
        if cut and (made := edges(key[:cut], fp[:cut])):
            yield made
        held = [(key[cut:], fp[cut:])]
    if held and (made := edges(*(np.concatenate(x) for x in zip(*held, strict=True)))):
        yield made


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (column fp) within ``ERRORS`` bits."""
    spark = fps.sparkSession
    # a key row is 16 bytes, about 170 to a fingerprint of 8; some 64 MB of them to a task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(fps) * 340 >> 26)
    keyed = fps.mapInArrow(_keyed, "key long, fp long")
    return (
        keyed.repartition(tasks, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_linked, "u long, v long")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, tkey, fp, root (the component's least fingerprint) and
    component_id."""
    rows = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints"
    )
    roots = components(fingerprint_links(distinct.select("fp")))
    named = distinct.join(
        roots.select(F.col("node").alias("fp"), "root"), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows, all columns kept, of one document of each component: that of the least doc_id
    (of several rows with that id, the one with the least hash; repeated rows once)."""
    found = near_duplicates(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tkey")).alias("_best")
    kept = materialise(
        found.groupBy("root")
        .agg(best)
        .select(F.col("_best.doc_id").alias("_doc"), F.col("_best.tkey").alias("_tkey"))
        .distinct(),
        "representatives",
    )
    own_text = F.xxhash64(F.coalesce("_row.text", F.lit("")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = row.join(
        kept, F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (own_text == F.col("_tkey")), "left_semi"
    )
    repeated = (
        found.groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    )
    if repeated.count():
        out = (
            out.select("_row", F.col("_row.doc_id").alias("_d"), own_text.alias("_t"))
            .dropDuplicates(["_d", "_t"])
            .select("_row")
        )
    return out.select("_row.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
