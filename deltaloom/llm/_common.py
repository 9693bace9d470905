"""Shared plumbing: scratch tables, bounded Arrow batches and vectorised word handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six bytes.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
TO_SPACE = bytes.maketrans(WHITESPACE, b" " * len(WHITESPACE))
LOWER_TO_SPACE = bytes.maketrans(
    WHITESPACE + bytes(range(65, 91)), b" " * len(WHITESPACE) + bytes(range(97, 123))
)

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + _local_scratch()
    return named.rstrip("/")


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    """One folder for each driver process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="deltaloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files.

    The files go when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/deltaloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out._scratch = path
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(df: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for ``df``, which no plan may read again."""
    fs, where = _file_system(df.sparkSession, df._scratch)
    fs.delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df``, which must be cheap to count, marked for broadcast if it has few rows.

    A larger one is left to a shuffled join, whose skewed partitions adaptive execution splits.
    """
    return F.broadcast(df) if df.count() <= rows else df


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes under ``df`` (file sizes; no job is run); 0 if it has none."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return size if size < 1 << 55 else 0  # without statistics Catalyst says 2 ** 63


def held_out(doc_id: Column) -> Column:
    """Rows kept from every training set: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4 << 20
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches of about ``size`` text bytes each, with the texts (null: empty) as bytes.

    Spark itself bounds the bytes of an Arrow batch (``spark.sql.execution.arrow.maxBytesPerBatch``,
    64 MB by default); a text longer than ``size`` is a slice of its own.
    """
    held: list[pa.RecordBatch] = []
    total = 0

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        one = t.to_batches()[0]
        texts = one.column(one.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        return one, [x or b"" for x in texts]

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        at = 0
        if column.nbytes + total > size and held:
            yield flush()
            held, total = [], 0
        if column.nbytes > 2 * size and batch.num_rows > 1:
            lengths = pc.binary_length(column.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            group = np.cumsum(lengths) // size
            for cut in [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]:
                held = [batch.slice(at, cut - at)]
                at = cut
                yield flush()
            held, total = [], 0
            continue
        held.append(batch)
        total += column.nbytes
    if held:
        yield flush()


def single_spaced(raw: bytes, mapping: bytes = TO_SPACE) -> bytes:
    """The words of a text joined by one space."""
    out = raw.translate(mapping).strip(b" ")
    return b" ".join(w for w in out.split(b" ") if w) if b"  " in out else out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _C2
    x = (x ^ (x >> _U(27))) * _C3
    return x ^ (x >> _U(31))


class Words:
    """All words of single-spaced texts as positions in one buffer.

    ``texts`` must be single-spaced and hold a word each. ``first[d]`` is the index of the
    first word of text ``d``; ``first[-1]`` is the number of words.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        buf = np.frombuffer(self.data, np.uint8)
        seps = np.flatnonzero((buf == 32) | (buf == 10))
        self.start = np.concatenate([[0], seps + 1]).astype(np.int64)
        self.end = np.concatenate([seps, [len(buf)]]).astype(np.int64)
        breaks = np.flatnonzero(buf[seps] == 10) + 1
        self.first = np.concatenate([[0], breaks, [len(self.start)]]).astype(np.int64)
        self.padded = self.data + b"\0" * 16
        self.block = np.ndarray((len(self.data) + 9,), "<u8", buffer=self.padded, strides=(1,))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        length = self.end - self.start
        h = mix(length.astype(np.uint64) * _C1 + _C2)
        todo, k = np.arange(len(length)), 0
        while len(todo):
            left = length[todo] - 8 * k
            part = self.block[self.start[todo] + 8 * k]
            short = left < 8
            if short.any():
                keep = (_U(1) << (left[short].astype(np.uint64) * _U(8))) - _U(1)
                part[short] &= keep
            h[todo] = mix((h[todo] ^ part) * _C1)
            todo, k = todo[left > 8], k + 1
        return h

    def heads(self, size: int) -> np.ndarray:
        """The first ``size`` (1 to 8) bytes of each word as an integer, zero-filled."""
        take = np.minimum(self.end - self.start, size).astype(np.uint64) * _U(8)
        part = self.block[self.start]
        return np.where(take >= 64, part, part & ((_U(1) << np.minimum(take, _U(63))) - _U(1)))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive entries of ``h``, by doubling."""
    done, width = h, 1
    parts = {1: h}
    while width * 2 <= n:
        done = mix(done[:-width] * _C1 + (done[width:] ^ _C3) * _C2)
        width *= 2
        parts[width] = done
    while width < n:
        step = max(w for w in parts if w <= n - width)
        size = len(h) - width - step + 1
        done = mix(done[:size] * _C1 + (parts[step][width : width + size] ^ _C3) * _C2)
        width += step
    return done


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive entries of ``x``."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the first ``total - n + 1`` positions start a window within one text."""
    size = max(0, total - n + 1)
    ok = np.ones(size, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < size)]] = False
    return ok


def concat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i] .. start[i] + length[i]`` for every i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str, total: str) -> DataFrame:
    """``df`` (cheap to read twice) with each row's ``rank`` from 0 among those with the same ``by``, nulls alike, in
    ascending ``order`` (nulls first), and how many (``total``) there are.

    Rows are dealt by range, so that a hot group is spread over tasks; a row's rank is its place in
    its range plus its group's rows in earlier ranges. Written to the shared folder.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) >> 26)
    dealt = materialise(
        df.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()),
        "ranges",
    )
    part = F.shiftright("_at", 33)
    mine = [F.col(f"`{b}`").alias(f"_{k}") for k, b in enumerate(by)]
    keys = [f"_{k}" for k in range(len(by))]
    runs = dealt.groupBy(part.alias("_part"), *mine).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)  # a row for each range that holds the group
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select("_part", *keys, "_first", before.alias("_before"), F.sum("_n").over(group).alias("_all")), "runs")
    on = [part == F.col("_part"), *[F.col(f"`{b}`").eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)]]
    out = dealt.join(broadcast_if_small(runs), on)
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(rank), F.col("_all").alias(total))


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """``n`` rows by ``order`` (a bounded TakeOrdered)."""
    return df.orderBy(*order).limit(n)


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def is_letter_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
