"""A table as numbered snapshots and a pointer: readers see one version, commits are atomic."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.operators import chunking
from deltaloom.operators.merge import without

#: Bytes of a file that a whole commit aims at, and key ranges of files that one plan holds.
FILE_BYTES = 128 << 20
MOST = 50_000
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class ConflictError(RuntimeError):
    """Another commit came first."""


class SnapshotTable:
    """``<path>/<folder>/part-…`` are files; ``<path>/_manifests/<id>`` lists the files, their statistics and
    the schema of one version; ``<path>/_versions/<n>`` names the manifest of version n.

    A version is committed by creating its marker exclusively, so of two commits of one version
    one fails. Files are never changed: a commit of a change writes new files for those that hold
    a row which goes, and for what comes, and shares all others with the version before. Paths
    may be on any file system that Spark reads.

    ``keys`` cluster a table: a whole commit is dealt and sorted by them, and each file's rows, nulls, least and greatest
    keys are kept in the manifest. A change by the first key, an integer, compares the ranges of its keys with those of
    the files and opens only files that it may touch; it writes a file for each of these ranges, so that files stay
    apart. ``compact`` joins small neighbours. ``marks`` hold the greatest batch of each stream.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        marks = self._path(f"{self.path}/_versions")
        if not self._fs.exists(marks):
            return []
        found = [s for s in self._fs.listStatus(marks) if s.getPath().getName().isdigit()]
        return sorted(int(s.getPath().getName()) for s in found if s.getLen())

    def version(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def _read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _write(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), False)
        try:
            out.write(bytearray(data), 0, len(data))
        finally:
            out.close()

    def _manifest_name(self, version: int) -> str:
        return self._read(f"_versions/{version}").decode()

    def manifest(self, version: int | None = None) -> dict:
        """``files`` (relative to the path) and ``schema`` of a version."""
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return json.loads(self._read(self._manifest_name(version)))

    def _frame(self, manifest: dict, files: Sequence[str], *more: Column) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        names = [F.col(f"`{f.name}`") for f in schema]
        if not files:
            return self.spark.createDataFrame([], schema).select(*names, *[F.lit(None).cast("string").alias("_file")] * bool(more))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files]).select(*names, *more)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        return self._frame(manifest, manifest["files"])

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self.manifest(version)["schema"])

    def _stored(self, df: DataFrame, by: str | None = None) -> list[str]:
        """Writes ``df`` (a file at least for each value of ``by``); the names of its files."""
        folder = f"d-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{folder}")
        out, root = [], self._path(f"{self.path}/{folder}")
        found = self._fs.listFiles(root, True)
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.rsplit("/", 1)[-1].startswith("part-"):
                out.append(_name(name))
        return sorted(out)

    def _stats(self, manifest: dict, files: Sequence[str], keys: Sequence[str]) -> dict:
        """Rows, and nulls, the least and the greatest of each key, of each of the files: one scan of their keys."""
        if not files or not keys:
            return {}
        df = self._frame(manifest, files, F.col("_metadata.file_path").alias("_file"))
        made = [F.count(F.lit(1)).alias("rows")]
        for k, name in enumerate(keys):
            c = F.col(f"`{name}`").cast("long")
            made += [F.min(c).alias(f"low{k}"), F.max(c).alias(f"high{k}"), F.count_if(c.isNull()).alias(f"nulls{k}")]
        out = {}
        for r in df.groupBy("_file").agg(*made).collect():  # a row for each new file
            per = {n: [r[f"low{k}"], r[f"high{k}"], r[f"nulls{k}"]] for k, n in enumerate(keys)}
            out[_name(r["_file"])] = {"rows": r["rows"], "keys": per}
        return out

    def _check(self, expect: int | None) -> None:
        if (now := self.version()) != expect:
            raise ConflictError(f"{self.path} is at version {now}, not {expect}")

    def _publish(self, files: list[str], schema: T.StructType, expect: int | None, stats: dict, keys: Sequence[str], marks: dict) -> int:
        version = 0 if expect is None else expect + 1
        name = f"_manifests/{uuid.uuid4().hex}.json"
        body = {"files": files, "schema": schema.jsonValue(), "keys": list(keys), "marks": marks}
        self._write(name, json.dumps(body | {"stats": {f: stats[f] for f in files if f in stats}}).encode())
        try:
            self._write(f"_versions/{version}", name.encode())
        except Exception as error:
            raise ConflictError(f"{self.path}: version {version} was committed by another") from error
        return version

    def _usable(self, schema: T.StructType, keys: Sequence[str]) -> list[str]:
        """The keys that statistics are kept of: integers, whose order Spark and Python share."""
        kinds = {f.name: f.dataType for f in schema}
        return [k for k in keys if isinstance(kinds.get(k), WHOLE)]

    def commit(self, df: DataFrame, expect: int | None = None, keys: Sequence[str] = (), mark: tuple[str, int] | None = None) -> int:
        """Writes ``df`` whole as the version after ``expect`` (the one it was made from), clustered by ``keys``."""
        self._check(expect)
        old = {} if expect is None else self.manifest(expect)
        keys = self._usable(df.schema, keys or old.get("keys", ()))
        if keys:
            tasks = max(chunking._bytes(df) // FILE_BYTES, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            df = df.repartitionByRange(tasks, *[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
        files = self._stored(df)
        stats = self._stats({"schema": df.schema.jsonValue()}, files, keys)
        marks = old.get("marks", {}) | ({mark[0]: mark[1]} if mark else {})
        return self._publish(files, df.schema, expect, stats, keys, marks)

    def marked(self, stream: str, manifest: dict | None = None) -> int:
        """The last batch of a stream that is part of the table; -1: none."""
        if manifest is None:
            manifest = self.manifest() if self.version() is not None else {}
        return manifest.get("marks", {}).get(stream, -1)

    def greatest(self, key: str, version: int | None = None):
        """The greatest value of a key, from statistics; by a scan where a file has none."""
        manifest = self.manifest(version)
        stats = [manifest.get("stats", {}).get(f, {}).get("keys", {}).get(key) for f in manifest["files"]]
        if all(s is not None for s in stats):
            return max((s[1] for s in stats if s[1] is not None), default=None)
        return self._frame(manifest, manifest["files"]).agg(F.max(F.col(f"`{key}`"))).first()[0]

    def _may_touch(self, manifest: dict, keys: DataFrame) -> list[str]:
        """The files that may hold a row with one of ``keys``, by the ranges of the first key with statistics."""
        files, stats = manifest["files"], manifest.get("stats", {})
        lead = next((k for k in manifest.get("keys", ()) if k in keys.columns and isinstance(keys.schema[k].dataType, WHOLE)), None)
        if lead is None or not files:
            return files
        c = F.col(f"`{lead}`").cast("long")
        bounds = self._bounds(manifest, lead)
        made = keys.select(c.alias("k"), _bin(bounds, lead).alias("b")).groupBy("b").agg(
            F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("k").isNull()).alias("nulls")
        )
        rows = made.collect()  # a row for each range of files that the keys meet
        spans = sorted((r["low"], r["high"]) for r in rows if r["low"] is not None)
        lows, highs, nulls = [s[0] for s in spans], [s[1] for s in spans], any(r["nulls"] for r in rows)

        def hit(f: str) -> bool:
            s = stats.get(f, {}).get("keys", {}).get(lead)
            if s is None or (nulls and s[2]):
                return True
            # spans are apart: the last one that begins by the file's end is the only one that may reach its begin
            return s[0] is not None and bisect_left(highs, s[0]) < bisect_right(lows, s[1])

        return [f for f in files if hit(f)]

    def _bounds(self, manifest: dict, key: str) -> list[int]:
        """Where the key ranges of files begin: all, or evenly chosen ones beyond ``MOST``."""
        lows = sorted({s["keys"][key][0] for s in manifest.get("stats", {}).values() if s["keys"].get(key, [None])[0] is not None})
        return lows[:: max(1, -(-len(lows) // MOST))]

    def change(self, drops: Sequence[DataFrame], add: DataFrame | None, expect: int, mark: tuple[str, int] | None = None) -> int:
        """The version after ``expect``: without the rows whose keys are in one of ``drops`` (frames of
        some of the table's columns, nulls alike), with the rows of ``add``.

        Files to rewrite are found among those that statistics leave, by reading their key columns alone; a
        change without drops reads nothing and adds files. A change whose ``mark`` (stream, batch) is already
        part of the table is none.
        """
        self._check(expect)
        manifest = self.manifest(expect)
        marks = manifest.get("marks", {})
        if mark and self.marked(mark[0], manifest) >= mark[1]:
            return expect
        touched: set[str] = set()
        self.opened: set[str] = set()
        for keys in drops:
            some = [f for f in self._may_touch(manifest, keys) if f not in touched]
            if not some:
                continue
            self.opened.update(some)
            old = self._frame(manifest, some, F.col("_metadata.file_path").alias("_file")).select(*keys.columns, "_file")
            on = [F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys.columns]
            hit = old.alias("o").join(keys.distinct().alias("k"), on, "left_semi").select("_file").distinct()
            touched |= {_name(r[0]) for r in hit.collect()}  # names of files, as in the manifest
        files = [f for f in manifest["files"] if f not in touched]
        fresh = add
        if touched:
            kept = self._frame(manifest, sorted(touched))
            for keys in drops:
                kept = without(kept, keys)
            fresh = kept if add is None else kept.unionByName(add)
        stats, keys = manifest.get("stats", {}), manifest.get("keys", [])
        if fresh is not None:
            fresh = fresh.select(*[f["name"] for f in manifest["schema"]["fields"]])
            made = self._clustered(manifest, fresh, touched, add) if keys and stats else self._stored(fresh)
            stats = stats | self._stats(manifest, made, keys)
            files += made
        marks = marks | ({mark[0]: mark[1]} if mark else {})
        return self._publish(files, T.StructType.fromJson(manifest["schema"]), expect, stats, keys, marks)

    def _clustered(self, manifest: dict, fresh: DataFrame, touched: set[str], add: DataFrame | None) -> list[str]:
        """Writes rows by the key ranges of files, none of which a new file crosses."""
        keys, stats = manifest["keys"], manifest["stats"]
        rows = sum(stats[f]["rows"] for f in touched if f in stats) + (add.count() if add is not None else 0)
        usual = max(1_000, sum(s["rows"] for s in stats.values()) // max(1, len(stats)))
        dealt = fresh.withColumn("_bin", _bin(self._bounds(manifest, keys[0]), keys[0]))
        order = [F.col(f"`{k}`") for k in keys]
        # ranges keep a file's rows together, whatever there is of them
        dealt = dealt.repartitionByRange(max(1, -(-rows // usual)), *order).sortWithinPartitions("_bin", *order)
        return self._stored(dealt, "_bin")

    def compact(self, expect: int, least: int | None = None) -> int:
        """The version after ``expect`` with runs of neighbours of fewer than ``least`` rows together (half of the usual size)
        written as one file each; ``expect`` itself if there are none."""
        self._check(expect)
        manifest = self.manifest(expect)
        stats, keys = manifest.get("stats", {}), manifest.get("keys", [])
        known = [f for f in manifest["files"] if f in stats and keys and stats[f]["keys"][keys[0]][0] is not None]
        if not known:
            return expect
        # the usual size is that of the larger half, so that many small files do not make it small
        sizes = sorted(stats[f]["rows"] for f in known)
        least = least or max(1, sizes[-(-3 * len(sizes) // 4) - 1] // 2)
        groups, now, n = [], [], 0
        for f in sorted(known, key=lambda f: (stats[f]["keys"][keys[0]][0], f)):
            small = stats[f]["rows"] < least
            if not small or n >= 2 * least:
                groups, now, n = [*groups, now], [], 0
            if small:
                now, n = [*now, f], n + stats[f]["rows"]
        groups = [g for g in [*groups, now] if len(g) > 1]
        if not groups:
            return expect
        old = [f for g in groups for f in g]
        where = self.spark.createDataFrame([(f, k) for k, g in enumerate(groups) for f in g], "_name string, _bin long")
        df = self._frame(manifest, old, F.regexp_extract(F.col("_metadata.file_path"), r"^.*/(d-[0-9a-f]{32}/.*)$", 1).alias("_file"))
        df = df.join(F.broadcast(where) if len(old) <= MOST else where, F.col("_file") == F.col("_name"), "left")
        unknown = F.raise_error(F.concat(F.lit("a file that no group has: "), "_file")).cast("long")
        df = df.withColumn("_bin", F.coalesce("_bin", unknown)).drop("_file", "_name")
        df = df.repartitionByRange(len(groups), "_bin", *keys).sortWithinPartitions("_bin", *keys)
        made = self._stored(df, "_bin")
        files = [f for f in manifest["files"] if f not in set(old)] + made
        stats = stats | self._stats(manifest, made, keys)
        return self._publish(files, T.StructType.fromJson(manifest["schema"]), expect, stats, keys, manifest.get("marks", {}))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` versions, and the files that none of those lists."""
        versions = self.versions()
        gone, stay = versions[:-keep], versions[-keep:]
        if not gone:
            return
        kept = {f for v in stay for f in self.manifest(v)["files"]}
        for v in gone:
            name = self._manifest_name(v)
            for f in json.loads(self._read(name))["files"]:
                if f not in kept:
                    self._fs.delete(self._path(f"{self.path}/{f}"), False)
            self._fs.delete(self._path(f"{self.path}/_versions/{v}"), False)
            self._fs.delete(self._path(f"{self.path}/{name}"), False)


def _name(path: str) -> str:
    """A file's name in a manifest: its path from the folder of its commit on."""
    return "d-" + path.rsplit("/d-", 1)[-1]


def _bin(bounds: Sequence[int], key: str) -> Column:
    """The number of the last bound that is not above a key; -1 below all, and for null."""
    if not bounds:
        return F.lit(0).cast("long")
    held, value = f"split('{','.join(map(str, bounds))}', ',')", f"cast(`{key}` as bigint)"
    return F.coalesce(F.expr(chunking._search(f"cast({held} as array<bigint>)", value)).cast("long"), F.lit(-1).cast("long"))
