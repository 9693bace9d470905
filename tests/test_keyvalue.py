"""The key-value source: shards, filters on keys, all-or-nothing writes, and a sync from it."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from deltaloom.contract import parse_request
from deltaloom.plans.engine import Engine
from deltaloom.sources import keyvalue
from deltaloom.sources.store import SnapshotTable

SCHEMA = "key string, n long, x double, d date, at timestamp, p decimal(10,2)"


@pytest.fixture
def path(spark, tmp_path):
    keyvalue.install(spark)
    return str(tmp_path / "kv")


def frame(spark, ids, x=1.0):
    return spark.createDataFrame([(f"k{i}", i, x) for i in ids], "key string, n long, x double").selectExpr(
        "key", "n", "x", "date'2024-02-29' d", "timestamp'2024-02-29 01:02:03' at", "cast(n as decimal(10,2)) p"
    )


def write(df, path, mode="append"):
    df.write.format(keyvalue.NAME).option("path", path).option("shards", 8).mode(mode).save()


def read(spark, path):
    return spark.read.format(keyvalue.NAME).schema(SCHEMA).option("path", path).load()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_latest_record_and_shards(spark, path):
    write(frame(spark, range(200)).repartition(3), path)
    assert rows(read(spark, path)) == rows(frame(spark, range(200)))
    write(frame(spark, range(50, 60), 9.0), path)
    want = rows(frame(spark, [i for i in range(200) if not 50 <= i < 60]).union(frame(spark, range(50, 60), 9.0)))
    assert rows(read(spark, path)) == want and read(spark, path).rdd.getNumPartitions() == 8
    write(frame(spark, range(3)), path, "overwrite")
    assert rows(read(spark, path)) == rows(frame(spark, range(3)))


def test_filters_on_keys_open_their_shards_only(spark, path):
    write(frame(spark, range(200)), path)
    one = read(spark, path).filter(F.col("key") == "k7")
    assert one.rdd.getNumPartitions() == 1 and [r.n for r in one.collect()] == [7]
    some = read(spark, path).filter(F.col("key").isin("k7", "k8", "nobody") & (F.col("n") > 7))
    assert [r.n for r in some.collect()] == [8]


def test_an_aborted_write_leaves_nothing(spark, path):
    write(frame(spark, range(20)), path)
    before, files = rows(read(spark, path)), sorted(os.listdir(f"{path}/data"))
    bad = frame(spark, range(100, 120)).repartition(4).withColumn("x", F.when(F.col("n") == 110, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        write(bad, path)
    assert rows(read(spark, path)) == before
    with pytest.raises(Exception, match="without key"):
        write(frame(spark, [5]).withColumn("key", F.lit(None).cast("string")), path)
    assert rows(read(spark, path)) == before and len(files) <= len(os.listdir(f"{path}/data"))
    with pytest.raises(Exception, match="must be text"):
        write(spark.range(3).withColumnRenamed("id", "key"), path)


def test_of_two_writers_one_fails(spark, path):
    write(frame(spark, range(4)), path)
    late = keyvalue.Writer(path, "key", 8, False)
    write(frame(spark, range(4, 6)), path)
    with pytest.raises(RuntimeError, match="another"):
        late.commit([])
    assert read(spark, path).count() == 6


def test_a_sync_from_a_store(spark, path, tmp_path):
    write(frame(spark, range(40)), path)
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.commit(frame(spark, range(30), 2.0))
    r = {"id": uuid.uuid4().hex, "source": {"path": path, "format": "keyvalue", "options": {"schema": SCHEMA}}, "dest": {"path": table.path}, "strategy": {"ids": ["n"]}}
    out = Engine(spark).sync(parse_request(json.dumps(r)))
    assert out.status == "ok" and rows(table.read()) == rows(frame(spark, range(40))), out.error
