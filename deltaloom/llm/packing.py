"""Best-fit packing planned over a histogram of lengths.

Tokenise once; every document becomes pieces of at most ``limit`` tokens. Only the counts
of pieces by length reach the driver (at most ``limit`` numbers). There best-fit decreasing
runs over counts: all pieces of one length are dealt to all open sequences of one free space
at once, so that the plan is a short list of runs. Pieces take planned slots by joining on
their rank within their length. Ranks come from two levels (length and salt), so that a
length shared by a third of all pieces is never sorted by one task.

Edge cases: null or empty text is the single end token; a very long text is cut into pieces, and
the encoder's memory is bounded in bytes, within a text too; pieces of one length that tie in
doc_id, piece, start and ids are alike, so that it does not matter which takes which slot;
repeated rows are packed as often as they occur; an empty table gives no rows; a null doc_id stays
null. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm._common import materialise, narrow, table, text_slices

LIMIT = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Parts of at most so many characters are remembered, at about so many bytes each besides their own.
LONG_PART, ENTRY = 64, 240
#: Pieces ranked together by one task; lengths with more are split by a salt, into at most SALTS.
PER_SALT = 100
SALTS = 4_096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class Encoder:
    """Token ids (little-endian unsigned 32-bit) of whole texts.

    Text between single spaces is encoded once and remembered, within a bound of bytes: the tokenizer's pattern never
    joins what a single space parts. Texts with other runs of white space around a space, and
    texts that spell a special token, are encoded as a whole.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None, remember: int = 48 << 20):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [
            t.content for t in self.whole.get_added_tokens_decoder().values() if t.special
        ]
        encode = lambda t: self.whole.encode(t, add_special_tokens=False).ids
        if ranks:
            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding(
                "ranks", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={}
            ).encode_ordinary
        self.encode = encode

        class Memory(dict):
            """Ids by part, of about ``remember`` bytes; longer parts are not kept."""

            held = 0

            def __missing__(memory, part: str):
                odd = not part or part[0].isspace() or part[-1].isspace()
                out = None if odd else array("I", encode(" " + part)).tobytes()
                if len(part) <= LONG_PART:
                    memory.held += ENTRY + len(part) + len(out or b"")
                    if memory.held > remember:
                        memory.clear()
                        memory.held = ENTRY
                    memory[part] = out
                return out

        self.memory = Memory()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return array("I", self.encode(text)).tobytes()
        parts = list(map(self.memory.__getitem__, rest))
        if None in parts:
            return array("I", self.encode(text)).tobytes()
        return array("I", self.encode(head)).tobytes() + b"".join(parts)


@lru_cache(maxsize=2)
def encoder_for(tokenizer: str, ranks: str | None) -> Encoder:
    """One encoder for each Python worker, whatever number of tasks it runs."""
    return Encoder(tokenizer, ranks)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; a shorter one comes first."""
    head = n % limit
    out = [(0, head)] if head else []
    return out + [(s, limit) for s in range(head, n, limit)]


def _pieces(tokenizer: str, ranks: str | None, limit: int, keep_ids: bool):
    def run(batches):
        encoder = encoder_for(tokenizer, ranks)
        end = array("I", [END_ID]).tobytes()
        for batch, raw in text_slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw, strict=True):
                ids = encoder.ids(text.decode("utf-8", "replace")) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(
                        (doc_id, k, start, length, zlib.crc32(part), part if keep_ids else None)
                    )
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names
            )

    return run


def pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None, limit: int = LIMIT, keep_ids: bool = True
) -> DataFrame:
    """Token pieces of every document, with their ids unless ``keep_ids`` is off."""
    return narrow(docs, "doc_id", "text").mapInArrow(
        _pieces(tokenizer, ranks, limit, keep_ids), PIECES
    )


def plan_best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts by length.

    Returns runs (length, from_rank, pieces, each, sequence, offset): the pieces of that length
    from rank ``from_rank`` go to consecutive sequences from ``sequence`` on, ``each`` to a
    sequence (the last may get fewer), the first at ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: (sequence, how many)
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for free in [f for f in sorted(room) if f >= length]:
            each = free // length
            spans, rest = room.pop(free), []
            for first, n in spans:
                if not left:
                    rest.append((first, n))
                    continue
                full = min(n, left // each)
                if full:
                    runs.append((length, rank, full * each, each, first, limit - free))
                    rank, left = rank + full * each, left - full * each
                    room[free - each * length].append((first, full))
                if full < n and left:
                    runs.append((length, rank, left, left, first + full, limit - free))
                    room[free - left * length].append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    rest.append((first + full, n - full))
            room[free] += rest
            if not room[free]:
                del room[free]
            if not left:
                break
        if left:
            each = limit // length
            full, tail = divmod(left, each)
            runs.append((length, rank, left, each, made, 0))
            if full:
                room[limit - each * length].append((made, full))
            if tail:
                room[limit - tail * length].append((made + full, 1))
            made += full + bool(tail)
        room.pop(0, None)
    return runs


def place(cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32 and more).

    A column ``_row``, if there, tells repeated rows apart and must be stored with the pieces.
    """
    spark = cut_pieces.sparkSession
    order = ["doc_id", "piece", "start", "ids_crc32", *(["_row"] if "_row" in cut_pieces.columns else [])]
    by_length = {
        int(r["length"]): int(r["n"])
        for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }  # at most ``limit`` rows
    runs = plan_best_fit(by_length, limit)
    salts = spark.createDataFrame(
        [(n, min(SALTS, -(-c // PER_SALT))) for n, c in by_length.items()] or [(0, 1)], "length long, _salts long"
    )
    salted = (
        cut_pieces.join(F.broadcast(salts), "length")  # bounded by the limit, not by the corpus
        # repeated rows are dealt apart by where they stand; which of them takes which slot is all one
        .withColumn(
            "_salt", F.pmod(F.xxhash64(*order), "_salts").cast("int")
        )
        .drop("_salts")
    )
    # one row for each length and salt: SALTS for a length at most
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "length",
        "_salt",
        (
            F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
        ).alias("_before"),
    )
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = (
        salted.withColumn("_own", F.row_number().over(own) - 1)
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_own"))
    )
    plan = spark.createDataFrame(
        runs or [(0, 0, 0, 1, 0, 0)],
        "length long, _from long, _pieces long, _each long, _seq long, _off long",
    )
    # The plan's runs for one length, as an array: the rank finds its run by position.
    plan = plan.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_pieces", "_each", "_seq", "_off"))).alias(
            "_runs"
        )
    )
    hit = F.filter(
        "_runs",
        lambda r: (r["_from"] <= F.col("_rank"))
        & (F.col("_rank") < r["_from"] + r["_pieces"]),
    )[0]
    return (
        ranked.join(F.broadcast(plan), "length")  # bounded by the limit, not by the corpus
        .withColumn("_run", hit)
        .withColumn("_k", F.col("_rank") - F.col("_run._from"))
        .withColumn("sequence_id", F.col("_run._seq") + F.expr("_k div _run._each"))
        .withColumn("offset", F.col("_run._off") + (F.col("_k") % F.col("_run._each")) * F.col("length"))
        .drop("_salt", "_own", "_before", "_rank", "_runs", "_run", "_k")
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    limit: int = LIMIT,
    keep_ids: bool = True,
) -> DataFrame:
    """Packs documents into sequences of at most ``limit`` tokens, one row for each piece."""
    made = pieces(docs, tokenizer, ranks, limit, keep_ids).withColumn("_row", F.monotonically_increasing_id())
    made = materialise(made, "pieces")
    placed = place(made, limit)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*cols, *(["ids"] if keep_ids else []))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(
        docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), keep_ids=False
    )
