"""Incremental synchronisation: new source rows as a stream, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deltaloom.functions.compare import fit
from deltaloom.operators import merge
from deltaloom.sources.store import ConflictError, SnapshotTable


TRIES = 5


def _once(table: SnapshotTable, stream: str, batch_id: int, ids: Sequence[str], change) -> None:
    """Commits a micro-batch with its number, unless the table already has it. ``change(version)`` gives the keys of rows that go and
    the rows that come; another writer's commit in between is followed by a new attempt."""
    for k in range(TRIES):
        version = table.version()
        if version is not None and table.marked(stream) >= batch_id:
            return
        drops, add = change(version)
        try:
            if version is None:
                table.commit(add, keys=ids, mark=(stream, batch_id))
            else:
                table.change(drops, add, version, mark=(stream, batch_id))
            return
        except ConflictError:
            if k + 1 == TRIES:
                raise


def _stream_id(checkpoint: str, name: str | None) -> str:
    return name or checkpoint.rstrip("/")


def _start(stream: DataFrame, apply, checkpoint: str, available_now: bool, interval: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def upsert_stream(
    stream: DataFrame,
    table: SnapshotTable,
    ids: Sequence[str],
    checkpoint: str,
    append_only: bool = False,
    available_now: bool = True,
    interval: str = "1 minute",
    name: str | None = None,
) -> StreamingQuery:
    """Applies each micro-batch to a snapshot table, exactly once: the manifest holds the stream's last batch.

    ``name`` stands for the stream in the manifest (the checkpoint's path if not given); a new checkpoint
    needs a new name, as its batches count from 0 again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.take(1):
                return

            def change(version):
                rows = merge.dedupe_max(batch, ids)
                if version is None:
                    return [], rows
                old = table.read(version)
                rows = fit(rows, old.schema)
                return ([], merge.transient_delete(rows, old, ids)) if append_only else ([rows.select(*ids)], rows)

            _once(table, _stream_id(checkpoint, name), batch_id, ids, change)
        finally:
            batch.unpersist()

    return _start(stream, apply, checkpoint, available_now, interval)


def append_stream(
    stream: DataFrame, table: SnapshotTable, checkpoint: str, available_now: bool = True, interval: str = "1 minute", name: str | None = None
) -> StreamingQuery:
    """Adds the rows of each micro-batch, as they are and once, though they have no id: a batch that runs again is known
    by its number in the manifest. Nothing of the table is read."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        def change(version):
            return [], batch if version is None else fit(batch, table.schema(version))

        _once(table, _stream_id(checkpoint, name), batch_id, (), change)

    return _start(stream, apply, checkpoint, available_now, interval)


def sync_new_ids(
    spark: SparkSession, source_path: str, schema, table: SnapshotTable, id_: str, checkpoint: str, name: str | None = None
) -> StreamingQuery:
    """Streams files of ``source_path``; only ids beyond the destination's greatest are added. That one is the
    high-water mark of the manifest's statistics: no batch scans the table."""
    stream = spark.readStream.schema(schema).parquet(source_path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        def change(version):
            top = None if version is None else table.greatest(id_, version)
            fresh = merge.dedupe_max(batch if top is None else batch.filter(F.col(id_) > top), [id_])
            return [], fresh if version is None else fit(fresh, table.schema(version))

        if batch.take(1):
            _once(table, _stream_id(checkpoint, name), batch_id, [id_], change)

    return _start(stream, apply, checkpoint, True, "")
