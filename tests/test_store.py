"""Snapshots: statistics, clustering, compaction, and batches of streams that count once."""

import random

import pytest
from pyspark.sql import functions as F

from deltaloom.sources.store import ConflictError, SnapshotTable
from deltaloom.streaming.incremental import append_stream, sync_new_ids, upsert_stream

SCHEMA = "id long, x double"


def frame(spark, ids, x=1.0):
    return spark.createDataFrame([(i, x) for i in ids], SCHEMA)


def table(spark, tmp_path, n=4000, name="t", files=16):
    t = SnapshotTable(spark, str(tmp_path / name))
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    spark.conf.set("spark.sql.shuffle.partitions", str(files))
    try:
        t.commit(frame(spark, ids), keys=["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return t


def spans(t):
    m = t.manifest()
    return sorted(tuple(m["stats"][f]["keys"]["id"][:2]) for f in m["files"])


def content(t):
    return sorted(map(tuple, t.read().collect()))


def test_one_id_opens_one_file(spark, tmp_path):
    t = table(spark, tmp_path)
    before = set(t.manifest()["files"])
    assert len(before) >= 12 and t.greatest("id") == 3999
    t.change([frame(spark, [1234]).select("id")], frame(spark, [1234], 9.0), 0)
    assert len(t.opened) == 1 and len(before - set(t.manifest()["files"])) == 1
    assert content(t) == sorted([(i, 9.0 if i == 1234 else 1.0) for i in range(4000)])
    # files stay apart
    found = spans(t)
    assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_far_apart_changes_inserts_and_tails_keep_files_apart(spark, tmp_path):
    t = table(spark, tmp_path)
    want = {i: 1.0 for i in range(4000)}
    rng = random.Random(4)
    for k in range(4):
        gone = {3, 3990 - k, *rng.sample(range(4000), 3)}
        come = {*rng.sample(range(4000), 4), 5000 + 10 * k, -7 - k}
        t.change([frame(spark, gone | come).select("id")], frame(spark, come, float(k)), t.version())
        want = {i: x for i, x in want.items() if i not in gone} | dict.fromkeys(come, float(k))
        assert content(t) == sorted(want.items())
    found = spans(t)
    assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False)) and t.greatest("id") == 5030
    # keys that no file may hold open none
    t.change([frame(spark, [10**9]).select("id")], None, t.version())
    assert t.opened == set() and content(t) == sorted(want.items())


@pytest.mark.parametrize("name", ["t", "d-" + "0" * 32])  # a path that looks like a file's folder
def test_compaction_joins_small_neighbours(spark, tmp_path, name):
    t = table(spark, tmp_path, name=name)
    for k in range(12):
        t.change([], frame(spark, [4000 + k]), t.version())
    many = len(t.manifest()["files"])
    now = t.compact(t.version())
    assert now == t.version() and len(t.manifest()["files"]) <= many - 11
    assert content(t) == sorted([(i, 1.0) for i in range(4012)])
    assert t.compact(now) == now  # nothing left to join
    with pytest.raises(ConflictError):
        t.compact(now - 1)


def test_null_keys_and_tables_without_statistics(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.commit(spark.createDataFrame([(None, 1.0), (1, 1.0), (2, 1.0)], SCHEMA), keys=["id"])
    t.change([spark.createDataFrame([(None,)], "id long")], None, 0)
    assert content(t) == [(1, 1.0), (2, 1.0)]
    plain = SnapshotTable(spark, str(tmp_path / "p"))
    plain.commit(frame(spark, [1, 2]))
    plain.change([frame(spark, [2]).select("id")], frame(spark, [3]), 0)
    assert content(plain) == [(1, 1.0), (3, 1.0)] and plain.greatest("id") == 3
    text = SnapshotTable(spark, str(tmp_path / "s"))
    text.commit(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double"), keys=["id"])
    text.change([spark.createDataFrame([("b",)], "id string")], None, 0)
    assert content(text) == [("a", 1.0)]


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    t = table(spark, tmp_path, 10)
    for _ in range(2):
        t.change([], frame(spark, [7, 7]), t.version(), mark=("s", 0))
    assert content(t).count((7, 1.0)) == 3 and t.version() == 1
    t.change([], frame(spark, [8]), 1, mark=("other", 0))
    t.change([], frame(spark, [9]), 2, mark=("s", 1))
    t.compact(3)
    assert t.marked("s") == 1 and t.marked("other") == 0 and t.marked("none") == -1


def test_streams_append_exactly_once_and_read_no_table(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "in")
    frame(spark, [1, 1, 2]).write.parquet(src)
    t = SnapshotTable(spark, str(tmp_path / "out"))
    stream = lambda: spark.readStream.schema(frame(spark, [1]).schema).parquet(src)
    append_stream(stream(), t, str(tmp_path / "cp"), name="s").awaitTermination(120)
    # a driver that dies after the commit and before the checkpoint runs the batch again
    append_stream(stream(), t, str(tmp_path / "cp-lost"), name="s").awaitTermination(120)
    assert content(t) == [(1, 1.0), (1, 1.0), (2, 1.0)]
    frame(spark, [3]).write.mode("append").parquet(src)
    append_stream(stream(), t, str(tmp_path / "cp"), name="s").awaitTermination(120)
    assert content(t) == [(1, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    new = SnapshotTable(spark, str(tmp_path / "new"))
    sync_new_ids(spark, src, frame(spark, [1]).schema, new, "id", str(tmp_path / "cp2")).awaitTermination(120)
    frame(spark, [2, 9]).write.mode("append").parquet(src)
    monkeypatch.setattr(SnapshotTable, "read", lambda *a: pytest.fail("the table was read"))
    sync_new_ids(spark, src, frame(spark, [1]).schema, new, "id", str(tmp_path / "cp2")).awaitTermination(120)
    monkeypatch.undo()
    assert [r[0] for r in content(new)] == [1, 2, 3, 9]
    up = SnapshotTable(spark, str(tmp_path / "up"))
    for _ in range(2):
        upsert_stream(stream(), up, ["id"], str(tmp_path / "cp3"), name="u").awaitTermination(120)
    assert up.marked("u") == 0 and up.read().agg(F.count("id")).first()[0] == 4
