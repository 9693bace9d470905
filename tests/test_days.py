"""Spans of days as jobs of their own, and partitions that the two sides spell differently."""

import json
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltaloom.contract import Resource, parse_request
from deltaloom.functions.criteria import Days, criterion
from deltaloom.operators import diff
from deltaloom.plans.engine import Engine, synchronise
from deltaloom.sources import loaders
from deltaloom.sources.store import SnapshotTable

FIRST = date(2020, 2, 27)


def table(spark, changed=(), n=60):
    """Ten rows a day, one of them at midnight and one a second before the next."""
    times = [datetime(2020, 2, 27) + timedelta(days=i // 10, seconds=9599.9 * (i % 10)) for i in range(n)]
    rows = [(i, t, -1.0 if i in changed else float(i)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "id long, ts timestamp, v double")


def request(source, dest, **more):
    return parse_request(json.dumps({"source": source, "dest": dest, "strategy": {"ids": ["id"]}} | more))


def values(df):
    return {r["id"]: r["v"] for r in df.collect()}


@pytest.mark.parametrize("kind", ["parquet", "jdbc"])
def test_spans_of_days_and_no_others(spark, tmp_path, kind):
    src = table(spark)
    if kind == "jdbc":
        options = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
        loaders.save(src, Resource(table="SRC", format="jdbc", options=options))
        source = {"table": "SRC", "format": "jdbc", "options": options}
    else:
        src.write.parquet(str(tmp_path / "src"))
        source = {"path": str(tmp_path / "src")}
    target = SnapshotTable(spark, str(tmp_path / "dst"))
    target.commit(table(spark, changed=(0, 9, 10, 29, 30, 59), n=60).filter("id <> 19"))
    engine, asked = Engine(spark), request(source, {"path": target.path})
    out = engine.sync_days(asked, "ts", date(2020, 2, 28), date(2020, 2, 29))
    assert [r.status for r in out] == ["ok", "ok"] and [r.transferred > 0 for r in out] == [True, True]
    held = values(target.read())
    assert {i for i, v in held.items() if v != i} == {0, 9, 30, 59} and len(held) == 60
    before = target.version()
    again = engine.sync_days(asked, "ts", date(2020, 2, 28), date(2020, 2, 29), 5)
    assert [r.transferred for r in again] == [0] and target.version() == before
    engine.sync_days(asked, "ts", FIRST, date(2020, 3, 3), 4)
    assert values(target.read()) == {i: float(i) for i in range(60)}


def test_the_first_failure_is_the_last_span(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "src"))
    doubled = table(spark).unionAll(table(spark, changed=(12,)).filter("id = 12"))
    SnapshotTable(spark, str(tmp_path / "dst")).commit(table(spark, changed=(12,)).filter("id < 30"))
    doubled.write.parquet(str(tmp_path / "doubled"))
    asked = request({"path": str(tmp_path / "doubled")}, {"path": str(tmp_path / "dst")})
    out = Engine(spark).sync_days(asked, "ts", FIRST, date(2020, 3, 3))
    assert [r.status for r in out] == ["ok", "error"]  # the second day repeats an id


def test_the_column_has_no_other_criterion(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "src"))
    asked = request({"path": str(tmp_path / "src"), "criteria": {"ts": "is not null"}}, {"path": str(tmp_path / "dst")})
    with pytest.raises(ValueError, match="criterion of its own"):
        Engine(spark).sync_days(asked, "ts", FIRST, FIRST)


def test_days_are_whole(spark):
    found = table(spark).filter(criterion("ts", Days(date(2020, 2, 28), date(2020, 2, 28))))
    assert sorted(r.id for r in found.collect()) == list(range(10, 20))


def slices(spark, keys):
    return spark.createDataFrame([(i, k, 1.0) for i, k in enumerate(keys)], "id long, k string, v double")


@pytest.mark.parametrize(
    "src, dst, wrong",
    [
        (["2020-01-05", "b"], ["2020-1-5", "b"], True),
        (["7", "b"], [" 07 ", "b"], True),
        (["2020-01-05"], ["2020-01-06"], False),
        (["b"], ["B"], False),
        (["7", "07"], ["7", "08"], False),
        ([None, "x"], ["", "x"], False),
    ],
)
def test_partitions_that_are_spelt_differently(spark, tmp_path, src, dst, wrong):
    a, b = slices(spark, src), slices(spark, dst)
    if wrong:
        with pytest.raises(ValueError, match="spell differently"):
            synchronise(a, b, ["id"], ["k"])
    else:
        assert sorted(map(str, synchronise(a, b, ["id"], ["k"]).result.collect())) == sorted(map(str, a.collect()))
    assert sorted(map(str, synchronise(a, b, ["id"], ["k"], spelling=False).result.collect())) == sorted(map(str, a.collect()))


def test_requests_refuse_or_allow_other_spellings(spark, tmp_path):
    slices(spark, ["2020-01-05"]).write.parquet(str(tmp_path / "src"))
    target = SnapshotTable(spark, str(tmp_path / "dst"))
    target.commit(slices(spark, ["2020-1-5"]))
    ask = lambda **p: request({"path": str(tmp_path / "src")}, {"path": target.path}, strategy={"ids": ["id"], "partition": {"columns": ["k"]} | p})
    refused = Engine(spark).sync(ask())
    assert refused.status == "error" and "2020-1-5" in refused.error
    assert Engine(spark).sync(ask(checkValues=False)).status == "ok"
    assert [r.k for r in target.read().collect()] == ["2020-01-05"]


def test_other_key_columns_must_be_equal(spark):
    schema = "method string, k string, n int"
    plan = spark.createDataFrame([("insert", "1", 1), ("removed", "01", 2), ("removed", "1.0", 1), ("inSync", "001", 1)], schema)
    assert [tuple(r) for r in diff.misspelt(plan, ["k", "n"]).collect()] == [("1", 1, "1.0", 1)]
    assert diff.misspelt(plan.select("method", F.col("n").alias("k")), ["k"]).count() == 0
