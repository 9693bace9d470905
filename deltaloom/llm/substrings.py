"""Exact substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text. Its minimiser is the least hash among
its word triples. Consecutive windows with one minimiser form a super-k-mer: one string of
words that holds all of them. It travels to the minimiser's bucket, packed with others of its
slice into one compressed block. Equal windows have equal minimisers, so all of a window's
occurrences meet in one bucket, where the windows are sorted by hash, equal ones are verified
byte by byte, and all but the earliest (doc_id, start) are reported as spans.

Pre-aggregation: of equal super-k-mers in one slice of the input only the earliest travels;
for the others the verdict is already known. So it is for those equal to an earlier one that the
same task sent from another slice: a task remembers what recurs, within ``KEPT`` bytes, so a
passage in every text leaves a task about twice, whatever the task reads. Known verdicts are spans of
their rows and are dealt by row, so they do not follow the passage to its bucket. Hot triples: word
triples that are the minimiser of more than ``HOT`` of a sample's windows rank after all others,
so a line that a third of all texts share draws no windows to its bucket; the sample only steers
this ranking and never decides a verdict. Blocks, not rows, are shuffled; a partition holds many
buckets and searches them one after another.

Edge cases: null or empty text has no words (the digest is that of the empty string); a very long
text is a slice of its own; repeated rows of one (doc_id, text) get equal verdicts, since neither
starts earlier; rows of one doc_id with different texts are ordered by where they start, and of
equal starts neither is earlier; a null doc_id counts as before all others; an empty table gives
no rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import (
    Words,
    concat_ranges,
    grams,
    input_bytes,
    inside,
    materialise,
    mix,
    narrow,
    single_spaced,
    sliding_min,
    table,
    text_slices,
)

WINDOW = 20
TRIPLE = 3
#: Share of a sample's windows above which a triple is hot, and the bytes of input sampled.
HOT = 1 / 2000
SAMPLE = 16 << 20
#: Bytes of input for each bucket, and partitions at most: beyond that a partition holds many buckets.
BUCKET = 2 << 20
PARTITIONS = 20_000
#: Bytes of recurring super-k-mers and number of hashes that a task remembers.
KEPT = 8 << 20
SEEN = 1 << 21

_U = np.uint64
_LAST = _U(1 << 63)
_NULL = np.iinfo(np.int64).min


def minimisers(words: Words, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser of each window, which windows lie in one text, word hashes)."""
    h = words.hashes()
    if len(h) < WINDOW:
        return np.zeros(0, _U), np.zeros(0, bool), h
    triple = grams(h, TRIPLE) >> _U(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, triple), len(hot) - 1)
        triple = np.where(hot[at] == triple, triple | _LAST, triple)
    return sliding_min(triple, WINDOW - TRIPLE + 1), inside(words.first, WINDOW, len(h)), h


def merge_spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint sorted (start, end) rows that cover the same words."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return np.stack([start[new], end[last]], 1)


def equal_bytes(words: Words, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the byte ranges at ``a`` and ``b`` (of equal ``length``) are equal."""
    same = np.ones(len(a), bool)
    todo, k = np.arange(len(a)), 0
    while len(todo):
        differ = words.block[a[todo] + k] ^ words.block[b[todo] + k]
        left = length[todo] - k
        short = left < 8
        differ[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
        same[todo[differ != 0]] = False
        todo, k = todo[(left > 8) & (differ == 0)], k + 8
    return same


def groups_of_equals(
    words: Words, key: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(item, group) for the items (byte ranges) that have an equal; verified byte by byte."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    twin = same | np.concatenate([same[1:], [False]])
    item = order[twin]
    if not len(item):
        return item, item
    group = np.cumsum(~same[twin]) - 1
    leader = item[np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])][group]
    length = end[item] - start[item]
    ok = length == end[leader] - start[leader]
    ok[ok] = equal_bytes(words, start[item[ok]], start[leader[ok]], length[ok])
    if not ok.all():  # a collision of hashes: part those groups by their bytes
        more: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(~ok):
            text = words.data[start[item[i]] : end[item[i]]]
            group[i] = more.setdefault((int(group[i]), text), len(key) + len(more))
    return item, group


def later_ones(group: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which items start later than the earliest (doc, at) of their group."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.lexsort((at, doc, group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = np.zeros(len(group), bool)
    late[order] = (doc[order] != doc[lead]) | (at[order] != at[lead])
    return late


def _keys(batch: pa.RecordBatch, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """doc_id (null: the least integer) and a hash of the raw text, for each row."""
    doc = batch.column(0).fill_null(int(_NULL)).to_numpy(zero_copy_only=False).astype(np.int64)
    return doc, np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], _U).view(np.int64)


def _runs(words: Words, hot: np.ndarray):
    """(first window, windows, minimiser, text) of each super-k-mer."""
    least, valid, h = minimisers(words, hot)
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, least, at, h
    text = np.searchsorted(words.first, at, side="right") - 1
    new = np.concatenate([[True], (least[at][1:] != least[at][:-1]) | (text[1:] != text[:-1])])
    first = at[new]
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
    return first, size, least[first], text[new], h


class Recurring:
    """Super-k-mers that came in an earlier slice of this task, with the earliest start sent.

    It only saves journeys: what it forgets, or never kept, travels and is judged in its bucket.
    """

    def __init__(self):
        self.sent: dict[int, tuple[bytes, int, int]] = {}
        self.seen = np.zeros(0, _U)
        self.size = 0

    def known(self, words: Words, key, lo, hi, doc, at) -> np.ndarray:
        """Which of the super-k-mers equal one that was sent and starts earlier; remembers those that recur."""
        out = np.zeros(len(key), bool)
        for i in np.flatnonzero(np.isin(key, self.seen)).tolist():
            k, mine = int(key[i]), (int(doc[i]), int(at[i]))
            old = self.sent.get(k)
            if old is None:
                if self.size + int(hi[i] - lo[i]) <= KEPT:
                    self.sent[k] = (words.data[lo[i] : hi[i]], *mine)
                    self.size += int(hi[i] - lo[i])
            elif old[0] == words.data[lo[i] : hi[i]]:
                if old[1:] < mine:
                    out[i] = True
                else:
                    self.sent[k] = (old[0], *mine)
        if len(self.seen) < SEEN:
            self.seen = np.union1d(self.seen, key)
        return out


def labels(spark: SparkSession, tasks: int) -> np.ndarray:
    """For each of ``tasks`` partitions a number that Spark's hash sends there, so that buckets are dealt
    out evenly and not by chance."""
    tried = spark.range(20 * tasks).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p"))
    out = np.arange(tasks, dtype=np.int64)
    for r in tried.groupBy("p").agg(F.min("id").alias("id")).collect():  # one row for each partition
        out[r["p"]] = r["id"]
    return out


def _split(hot: np.ndarray, buckets: int, label: np.ndarray):
    """Texts in, one compressed block of super-k-mers for each slice and bucket out."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        recurring = Recurring()
        for batch, raw in text_slices(batches):
            doc, tkey = _keys(batch, raw)
            texts = [single_spaced(t) for t in raw]
            keep = [i for i, t in enumerate(texts) if t]
            if not keep:
                continue
            words = Words([texts[i] for i in keep])
            first, size, least, text, h = _runs(words, hot)
            if not len(first):
                continue
            row = np.array(keep)[text]
            at = first - words.first[text]
            lo, hi = words.start[first], words.end[first + size + WINDOW - 2]
            # a super-k-mer equal to an earlier one of this slice needs no journey
            edge = grams(h, WINDOW)
            key = (edge[first] ^ (edge[first + size - 1] * _U(3))) + size.astype(_U)
            item, group = groups_of_equals(words, key, lo, hi)
            known = np.zeros(len(first), bool)
            known[item] = later_ones(group, doc[row[item]], at[item])
            left = np.flatnonzero(~known)
            known[left] = recurring.known(words, key[left], lo[left], hi[left], doc[row[left]], at[left])
            bucket = ((least * _U(0x9E3779B97F4A7C15)) >> _U(33)) % _U(buckets)
            # a verdict that is known needs no bucket of its passage: it is dealt by row
            bucket = np.where(known, (mix((doc[row] ^ tkey[row]).view(_U)) >> _U(33)) % _U(buckets), bucket).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.concatenate(
                [[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]
            )
            blocks = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                sent, done = own[~known[own]], own[known[own]]
                body = b"\n".join(words.data[x:y] for x, y in zip(lo[sent].tolist(), hi[sent].tolist(), strict=True))
                parts = [
                    struct.pack("<II", len(sent), len(done)),
                    doc[row[sent]], tkey[row[sent]], at[sent].astype(np.int32),
                    doc[row[done]], tkey[row[done]], at[done].astype(np.int32), size[done].astype(np.int32),
                ]
                head = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
                blocks.append(pack.compress(head + body))
            found = bucket[order[cuts[:-1]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[found % len(label)]), pa.array(found), pa.array(blocks, pa.binary())],
                ["label", "bucket", "block"],
            )

    return run


def _open(block: bytes):
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m = struct.unpack_from("<II", raw)
    at, out = 8, []
    for count, kind in ((n, "<i8"), (n, "<i8"), (n, "<i4"), (m, "<i8"), (m, "<i8"), (m, "<i4"), (m, "<i4")):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return out, raw[at:]


def _spans_by_row(doc, tkey, start, end):
    """(doc_id, tkey, spans) rows: the spans of each text, merged and packed."""
    order = np.lexsort((start, tkey, doc))
    doc, tkey, start, end = doc[order], tkey[order], start[order], end[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])])
    cuts = np.concatenate([np.flatnonzero(new), [len(doc)]])
    spans = [
        merge_spans(start[a:b], end[a:b]).astype("<i4").tobytes()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[cuts[:-1]]), pa.array(tkey[cuts[:-1]]), pa.array(spans, pa.binary())],
        ["doc_id", "tkey", "spans"],
    )


def repeated_windows(blocks: list[bytes]) -> pa.RecordBatch | None:
    """Spans to remove, from all the blocks of one bucket."""
    opened = [_open(b) for b in blocks]
    doc, tkey, at, ddoc, dkey, dat, dsize = (
        np.concatenate([o[0][k] for o in opened]) for k in range(7)
    )
    found = [(ddoc, dkey, dat.astype(np.int64), dat.astype(np.int64) + dsize + WINDOW - 1)]
    if len(doc):
        words = Words([body for o, body in opened if len(o[0])])
        # texts of the blocks are joined by newlines, as the super-k-mers within them
        wide = grams(words.hashes(), WINDOW)
        window = np.flatnonzero(inside(words.first, WINDOW, len(words)))
        kmer = np.searchsorted(words.first, window, side="right") - 1
        item, group = groups_of_equals(
            words, wide[window], words.start[window], words.end[window + WINDOW - 1]
        )
        src = kmer[item]
        begin = at[src] + window[item] - words.first[src]
        late = later_ones(group, doc[src], begin)
        src, begin = src[late], begin[late].astype(np.int64)
        found.append((doc[src], tkey[src], begin, begin + WINDOW))
    parts = [np.concatenate(x) for x in zip(*found, strict=True)]
    return _spans_by_row(*parts) if len(parts[0]) else None


def _bucket_spans(batches):
    """Blocks sorted by bucket in, spans to remove out; a bucket may span batches."""
    now, blocks = None, []
    for batch in batches:
        for bucket, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if blocks and (made := repeated_windows(blocks)):
                    yield made
                now, blocks = bucket, []
            blocks.append(block)
    if blocks and (made := repeated_windows(blocks)):
        yield made


def _sampled_minimisers(batches):
    for _, raw in text_slices(batches):
        texts = [t for t in map(single_spaced, raw) if t]
        if not texts:
            continue
        least, valid, _ = minimisers(Words(texts), np.zeros(0, _U))
        value, n = np.unique(least[valid], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["triple", "n"]
        )


def hot_triples(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the triples that are minimisers of too many of a sample's windows."""
    part = max(1, input_bytes(docs) // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
    seen = materialise(
        sample.mapInArrow(_sampled_minimisers, "triple long, n long")
        .groupBy("triple")
        .agg(F.sum("n").alias("n")),
        "triples",
    )
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = seen.filter(F.col("n") > max(64.0, total * HOT)).select("triple").collect()
    return np.sort(np.array([r[0] for r in hot], np.int64).view(_U))  # under 1 / HOT of them


def _kept(batches):
    for batch, raw in text_slices(batches):
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        n_words, n_removed, sha, kept = [], [], [], []
        for text, packed in zip(raw, spans, strict=True):
            words = single_spaced(text).split(b" ")
            words = [] if words == [b""] else words
            gone = np.zeros(len(words), bool)
            for part in packed or ():
                for a, b in np.frombuffer(part, "<i4").reshape(-1, 2).tolist():
                    gone[a:b] = True
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if n_removed[-1] else b" ".join(words)
            kept.append(left)
            sha.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(sha, pa.string()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, spans): for each text, arrays of packed (start, end) word spans to remove."""
    spark = docs.sparkSession
    docs = narrow(docs, "doc_id", "text")
    hot = hot_triples(docs)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTITIONS, input_bytes(docs) // BUCKET))
    buckets = max(tasks, input_bytes(docs) // BUCKET)
    blocks = docs.mapInArrow(_split(hot, buckets, labels(spark, tasks)), "label long, bucket long, block binary")
    spans = (
        blocks.repartition(tasks, "label")
        .select("bucket", "block")
        .sortWithinPartitions("bucket")
        .mapInArrow(_bucket_spans, "doc_id long, tkey long, spans binary")
    )
    # a text's spans: one packed row at most from each bucket its windows went to
    return materialise(
        spans.groupBy("doc_id", "tkey").agg(F.collect_list("spans").alias("spans")), "spans"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 and the kept text."""
    docs = narrow(docs, "doc_id", "text")
    spans = repeated_spans(docs).withColumnRenamed("doc_id", "_doc")
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(
        spans,
        (F.coalesce("doc_id", F.lit(int(_NULL))) == F.col("_doc"))
        & (F.xxhash64(text) == F.col("tkey")),
        "left",
    ).select("doc_id", "text", "spans")
    return joined.mapInArrow(
        _kept,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
