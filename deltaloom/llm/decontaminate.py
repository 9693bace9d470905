"""Benchmark decontamination by size-partitioned MinHash containment search.

A text contains a benchmark item when at least ``CONTAINED`` of the item's distinct word
shingles (five words; a shorter item is one shingle) occur in the text. Items are partitioned
by how many shingles they have, in classes that double, and each class has its own index. In each
class an item's sketch is the k shingles with the least hashes, k just over the share of the
class's largest size that may be missing: whatever shingles a containing text lacks, it has one of
the k. A text, however long, looks up its shingles only in the classes that its own size admits
(those whose smallest item needs no more shingles than it has), and loses nothing. Candidates are verified by exact containment of
the shingles' bytes.

The benchmark is the stated query set. It is dealt into blocks of at most about ``BLOCK`` bytes of
text, whose indexes are built by the tasks that search them; the driver holds none. What it spreads
is one Bloom filter of all sketch hashes, at most ``FILTER`` bits however large the benchmark, which
tells a text's own task which blocks may hold an item of it, if any. Only texts with a block are
shuffled, each to its blocks; a block that many texts go to is searched by a task for each ``PART``
bytes of them. A filter that is too full sends texts to more blocks than need be, and loses none.
Rows are one for each containing (document, item).

Edge cases: null or empty items match nothing; texts with too few words match nothing; null ids
stay null; of several contained items each is a row, so there are no ties; a very long text is one
row, searched whole; repeated rows give repeated results; empty tables give no rows. Only doc_id
and text, and of the benchmark item_id and text, are read, so other columns may have any names;
``without_contaminated`` carries those of the documents along.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import (
    LOWER_TO_SPACE,
    Words,
    broadcast_if_small,
    concat_ranges,
    grams,
    inside,
    materialise,
    mix,
    narrow,
    single_spaced,
    table,
    text_slices,
)

SHINGLE = 5
#: Containment of 0.8 or more, as a fraction.
CONTAINED = (4, 5)
BLOCK = 16 << 20
#: Text that one task searches for the items of one block.
PART = 32 << 20
#: The most bits of the filter (64 MB), the bits for each byte of benchmark below that, and those set for each hash.
FILTER = 1 << 29
BITS = 16
PROBES = 8

_U = np.uint64


def shingle_bytes(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def sketch(text: bytes) -> tuple[int, int, set[bytes], np.ndarray] | None:
    """(width, size class, shingles, sketch hashes) of an item; none without words.

    The class is the next power of 2 to the number of shingles.
    """
    flat = single_spaced(text, LOWER_TO_SPACE)
    if not flat:
        return None
    hit, of = CONTAINED
    words = flat.split(b" ")
    width = min(SHINGLE, len(words))
    shingles = shingle_bytes(words, width)
    size_class = 1 << (len(shingles) - 1).bit_length()
    k = size_class * (of - hit) // of + 1
    return width, size_class, shingles, np.unique(grams(Words([flat]).hashes(), width))[:k]


class Benchmark:
    """The sketches of one block of items: an index for each shingle width and size class."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, self.shingles = [], []
        sketches: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = defaultdict(list)
        hit, of = CONTAINED
        for item_id, text in items:
            made = sketch((text or "").encode())
            if made is None:
                continue
            width, size_class, shingles, hashes = made
            sketches[width, size_class].append((hashes, len(self.ids)))
            self.ids.append(item_id)
            self.shingles.append(shingles)
        #: least number of distinct shingles a containing text has
        self.needed = np.array([-(-len(s) * hit // of) for s in self.shingles], np.int64)
        #: (width, least needed, hashes, item of each hash, which low bits occur), smallest texts first
        self.index = []
        for (width, _), parts in sorted(sketches.items()):
            hashes = np.concatenate([h for h, _ in parts])
            item = np.repeat([i for _, i in parts], [len(h) for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            hashes, item = hashes[order], item[order]
            maybe = np.zeros(1 << 16, bool)
            maybe[(hashes & _U(0xFFFF)).astype(np.int64)] = True
            self.index.append((width, int(self.needed[item].min()), hashes, item, maybe))

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(text, item) pairs that share a sketch shingle and whose sizes allow containment.

        A class is looked up only in texts with as many shingles as its smallest item needs.
        """
        h = words.hashes()
        sizes = np.diff(words.first)
        out: set[tuple[int, int]] = set()
        made: dict[int, np.ndarray] = {}
        for width, least, hashes, item, maybe in self.index:
            admitted = np.flatnonzero(sizes - width + 1 >= max(1, least))
            if not len(admitted):
                continue
            if width not in made:
                made[width] = grams(h, width)
            g = made[width]
            if len(admitted) == len(sizes):
                at = np.flatnonzero(maybe[(g & _U(0xFFFF)).astype(np.int64)])
                at = at[inside(words.first, width, len(h))[at]]
            else:  # the windows of the admitted texts only
                own = concat_ranges(words.first[:-1][admitted], sizes[admitted] - width + 1)
                at = own[maybe[(g[own] & _U(0xFFFF)).astype(np.int64)]]
            lo = np.searchsorted(hashes, g[at])
            known = lo < len(hashes)
            known[known] = hashes[lo[known]] == g[at[known]]
            at, lo = at[known], lo[known]
            if not len(at):
                continue
            text = np.searchsorted(words.first, at, side="right") - 1
            hi = np.searchsorted(hashes, g[at], side="right")
            for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True):
                room = sizes[t] - width + 1
                out.update((t, i) for i in item[a:b].tolist() if self.needed[i] <= room)
        return out

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, those found in the text) for every containment."""
        flat = [single_spaced(t, LOWER_TO_SPACE) for t in texts]
        keep = [i for i, t in enumerate(flat) if t]
        if not keep or not self.ids:
            return []
        words = Words([flat[i] for i in keep])
        hit, of = CONTAINED
        out, seen = [], {}
        for t, item in sorted(self.candidates(words)):
            wanted = self.shingles[item]
            width = min(SHINGLE, next(iter(wanted)).count(b" ") + 1)
            if (t, width) not in seen:
                seen = {(t, width): shingle_bytes(flat[keep[t]].split(b" "), width)}
            found = len(wanted & seen[t, width])
            if found * of >= len(wanted) * hit:
                out.append((keep[t], item, len(wanted), found))
        return out


def _keys(hashes: np.ndarray, width: int, block: int = -1) -> np.ndarray:
    """Filter keys of hashes that some item of ``block`` (-1: of any block) has."""
    return mix(hashes ^ mix(np.array([width + 8 * (block + 1)], _U) * _U(0x9E3779B97F4A7C15)))


def _places(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (keys + _U(probe) * ((keys >> _U(32)) | _U(1))) & _U(bits - 1)


def _filter_words(bits: int):
    """(slot, ored) of the filter's 64-bit words that a task's items set; slot -w says that items of width w occur."""

    def run(batches):
        for batch, texts in text_slices(batches):
            keys, widths = [], set()
            for text, block in zip(texts, batch.column("block").to_pylist(), strict=True):
                if made := sketch(text):
                    width, _, _, hashes = made
                    widths.add(width)
                    keys += [_keys(hashes, width), _keys(hashes, width, block)]
            if not keys:
                continue
            keys = np.concatenate(keys)
            at = np.concatenate([_places(keys, j, bits) for j in range(PROBES)])
            at.sort()
            slot = (at >> _U(6)).astype(np.int64)
            first = np.flatnonzero(np.diff(slot, prepend=-1))
            ored = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), first)
            slot = np.concatenate([slot[first], [-w for w in widths]])
            ored = np.concatenate([ored.view(np.int64), np.ones(len(widths), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(ored)], ["slot", "ored"])

    return run


class Filter:
    """Which blocks may hold an item whose sketch has a shingle of a text."""

    def __init__(self, words: np.ndarray, widths: list[int], blocks: int):
        self.words, self.widths, self.blocks = words, widths, blocks

    def among(self, keys: np.ndarray) -> np.ndarray:
        """The positions of the keys that may have been set."""
        at = np.arange(len(keys))
        for j in range(PROBES):
            place = _places(keys[at], j, 64 * len(self.words))
            at = at[(self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1]
        return at

    def routes(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text, block) wherever an item of the block may be contained, in order."""
        flat = [single_spaced(t, LOWER_TO_SPACE) for t in texts]
        keep = np.array([i for i, t in enumerate(flat) if t], np.int64)
        if not len(keep) or not self.widths:
            return []
        words = Words([flat[i] for i in keep])
        h, longest = words.hashes(), int(np.diff(words.first).max())
        out: set[tuple[int, int]] = set()
        for width in self.widths:
            if width > longest:
                continue
            g = grams(h, width)
            at = self.among(_keys(g, width))
            at = at[inside(words.first, width, len(h))[at]]
            for block in range(self.blocks) if len(at) else ():
                hit = at[self.among(_keys(g[at], width, block))]
                text = np.unique(np.searchsorted(words.first, hit, side="right") - 1)
                out.update((t, block) for t in keep[text].tolist())
        return sorted(out)


def blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark as (item_id, text, block), written once, and the number of blocks."""
    items = narrow(benchmark, "item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK) or 1
    block = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")  # copies of an item go to several
    return materialise(items.withColumn("block", block), "benchmark"), n


def bloom(items: DataFrame, n: int):
    """The filter of ``n`` blocks of items, broadcast; of bounded size."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(FILTER, 1 << max(16, (size * BITS).bit_length()))
    made = narrow(items, "text", "block").mapInArrow(_filter_words(bits), "slot long, ored long")
    found = made.groupBy("slot").agg(F.bit_or("ored").alias("ored")).toArrow()
    slot, ored = found.column("slot").to_numpy(), found.column("ored").to_numpy()
    words = np.zeros(bits // 64, _U)
    words[slot[slot >= 0]] = ored[slot >= 0].view(_U)
    return items.sparkSession.sparkContext.broadcast(Filter(words, sorted((-slot[slot < 0]).tolist()), n))


def _route(shared):
    def run(batches):
        for batch, texts in text_slices(batches):
            found = shared.value.routes(texts)
            own = batch.take(pa.array([t for t, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array([b for _, b in found], pa.int32())], ["id", "text", "block"]
            )

    return run


def _search(items: pa.Table, texts: pa.Table) -> pa.Table:
    """The containments of a part of the texts that were sent to a block, in slices of bounded size."""
    out = {"id": [], "item_id": [], "n_shingles": [], "n_found": []}
    if texts.num_rows:
        own = Benchmark(list(zip(items["item_id"].to_pylist(), items["text"].to_pylist(), strict=True)))
        for batch, raw in text_slices(texts.to_batches()):
            ids = batch.column("id").to_pylist()
            for t, i, n, m in own.matches(raw):
                for column, value in zip(out.values(), (ids[t], own.ids[i], n, m), strict=True):
                    column.append(value)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _found(texts: DataFrame, items: DataFrame, shared) -> DataFrame:
    """(id, item_id, n_shingles, n_found) of every containment, for rows of (id, text)."""
    routed = materialise(texts.mapInArrow(_route(shared), "id long, text string, block int"), "routed")
    sizes = routed.groupBy("block").agg(F.sum(F.octet_length("text")).alias("size"))
    # A row for each block that texts go to: the benchmark's bytes / BLOCK at most.
    sizes = materialise(sizes.select("block", F.ceil(F.col("size") / PART).cast("long").alias("parts")), "parts")
    few = broadcast_if_small(sizes)
    dealt = routed.withColumn("at", F.monotonically_increasing_id()).join(few, "block")
    dealt = dealt.select("id", "text", "block", F.pmod("at", "parts").alias("part"))
    spread = items.join(few, "block").select("item_id", "text", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return spread.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(
        _search, "id long, item_id long, n_shingles long, n_found long"
    )


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for every contained item."""
    items, n = blocks(benchmark)
    found = _found(narrow(docs, "doc_id", "text"), items, bloom(items, n)).withColumnRenamed("id", "doc_id")
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def _divide(shared, wanted: bool):
    """Rows whose text has a block (or none) to go to."""

    def run(batches):
        for batch, texts in text_slices(batches):
            routed = {t for t, _ in shared.value.routes(texts)}
            yield batch.filter(pa.array([(i in routed) == wanted for i in range(batch.num_rows)]))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text contains no benchmark item.

    Rows without a block pass through; the others are written, searched, and those found left out.
    """
    items, n = blocks(benchmark)
    shared = bloom(items, n)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    suspects = docs.mapInArrow(_divide(shared, True), docs.schema).select(whole, F.monotonically_increasing_id().alias("id"))
    suspects = materialise(suspects, "suspects")
    found = _found(suspects.select("id", "doc.text"), items, shared)
    dirty = materialise(found.select("id").distinct(), "contaminated")
    clean = suspects.join(broadcast_if_small(dirty), "id", "left_anti").select("doc.*")
    return docs.mapInArrow(_divide(shared, False), docs.schema).unionAll(clean)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
