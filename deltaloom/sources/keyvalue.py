"""A key-value store as a Spark data source: read by shard, filtered by key, written all or nothing.

``<path>/manifest.json`` lists the files of each shard, oldest first; a key lies in the shard of its hash, and its latest
record counts. A read is a partition for each shard; filters on the key (equality, IN) leave only the
shards of these keys and are applied there. A write adds a file for each task and shard; only the commit, a single
replacement of the manifest, makes them part of the store, and an abort deletes them. Paths are those of
``pyarrow.fs`` (local, s3, hdfs, ...), which all executors must reach.

Memory: the latest records of one shard; give a large store more ``shards`` when it is made. A record without key is an
error. Of two drivers that commit at once one fails if its manifest is no longer the one it started from.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

NAME = "deltaloom_kv"


def shard_of(key: str, shards: int) -> int:
    return zlib.crc32(key.encode()) % shards


class Store:
    """Files and manifest of a store."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def manifest(self) -> dict | None:
        """``shards``, ``files`` (a list for each shard) and ``version``; None for a store that is not there."""
        if self.fs.get_file_info(f"{self.root}/manifest.json").type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.root}/manifest.json") as f:
            return json.loads(f.read())

    def publish(self, manifest: dict) -> None:
        name = f"{self.root}/manifest-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(name) as f:
            f.write(json.dumps(manifest).encode())
        self.fs.move(name, f"{self.root}/manifest.json")

    def write(self, name: str, lines: list[str]) -> None:
        self.fs.create_dir(f"{self.root}/data", recursive=True)
        with self.fs.open_output_stream(f"{self.root}/data/{name}") as f:
            f.write("\n".join(lines).encode())

    def lines(self, name: str) -> Iterator[dict]:
        with self.fs.open_input_stream(f"{self.root}/data/{name}") as f:
            for line in f.read().splitlines():
                yield json.loads(line)

    def delete(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete_file(f"{self.root}/data/{name}")


def plain(value):
    """A value as JSON holds it."""
    if isinstance(value, datetime | date):
        return value.isoformat()
    return str(value) if isinstance(value, Decimal) else value


def typed(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value)
    return Decimal(value) if isinstance(kind, T.DecimalType) else value


@dataclass
class Shard(InputPartition):
    number: int
    files: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, key: str):
        self.path, self.schema, self.key, self.keys = path, schema, key, None

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        """Keys by equality; all other filters are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.key,):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = some if self.keys is None else self.keys & some
            else:
                yield f

    def partitions(self):
        held = Store(self.path).manifest()
        if held is None:
            raise ValueError(f"{self.path} is no key-value store")
        wanted = None if self.keys is None else {shard_of(k, held["shards"]) for k in self.keys if k is not None}
        found = [Shard(k, files) for k, files in enumerate(held["files"]) if files and (wanted is None or k in wanted)]
        return found or [Shard(-1, [])]

    def read(self, partition: Shard):
        store, latest = Store(self.path), {}
        for name in partition.files:
            for record in store.lines(name):
                if self.keys is None or record[self.key] in self.keys:
                    latest[record[self.key]] = record
        for record in latest.values():
            yield tuple(typed(record.get(f.name), f.dataType) for f in self.schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, key: str, shards: int, overwrite: bool):
        self.path, self.key, self.overwrite = path, key, overwrite
        self.before = Store(path).manifest()
        self.shards = self.before["shards"] if self.before and not overwrite else shards

    def write(self, iterator):
        store, held, made = Store(self.path), {}, []

        def flush() -> None:
            for k, lines in held.items():
                made.append((k, f"{k}-{uuid.uuid4().hex}.jsonl"))
                store.write(made[-1][1], lines)
            held.clear()

        size = 0
        for row in iterator:
            record = {name: plain(v) for name, v in row.asDict().items()}
            if record.get(self.key) is None:
                store.delete([name for _, name in made])
                raise ValueError(f"a record without {self.key}")
            line = json.dumps(record)
            held.setdefault(shard_of(record[self.key], self.shards), []).append(line)
            size += len(line)
            if size > 32 << 20:
                flush()
                size = 0
        flush()
        return Written(made)

    def commit(self, messages):
        store = Store(self.path)
        now = store.manifest()
        if (now or {}).get("version") != (self.before or {}).get("version"):
            self.abort(messages)
            raise RuntimeError(f"{self.path} was written by another")
        old = [[] for _ in range(self.shards)] if self.overwrite or now is None else now["files"]
        for k, name in sorted(f for m in messages if m for f in m.files):
            old[k] = [*old[k], name]
        store.publish({"shards": self.shards, "files": old, "version": uuid.uuid4().hex})

    def abort(self, messages):
        store = Store(self.path)
        for m in messages:
            if m:
                store.delete([name for _, name in m.files])


class KeyValueSource(DataSource):
    """Options: ``path``, ``key`` (its column, text; "key" if not given), ``shards`` of a new store (16)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        raise ValueError("a key-value store is read with a schema")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, self.options.get("key", "key"))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        key = self.options.get("key", "key")
        if key not in schema.names or not isinstance(schema[key].dataType, T.StringType):
            raise ValueError(f"the key column {key!r} must be text")
        return Writer(self.options["path"], key, int(self.options.get("shards", 16)), overwrite)


def install(spark: SparkSession) -> None:
    """Makes the source known to the session, with filters on keys, and to requests as format ``keyvalue`` (its options hold
    ``schema``, as DDL, and ``key``)."""
    from deltaloom.sources import loaders

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyValueSource)

    def load(session: SparkSession, resource):
        options = {k: v for k, v in resource.options.items() if k != "schema"}
        return session.read.format(NAME).schema(resource.options["schema"]).options(path=resource.path, **options).load()

    loaders.register("keyvalue", load)
