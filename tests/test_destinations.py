"""Destinations: snapshots by touched files, JDBC tables in one transaction, catalog tables, settings."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from deltaloom.contract import Resource, parse_request
from deltaloom.plans.engine import Change, Engine, synchronise
from deltaloom.sources import loaders
from deltaloom.sources.store import ConflictError, SnapshotTable

SCHEMA = "id long, kind int, x double, note string"


def frame(spark, ids, change=(), kinds=4):
    return spark.createDataFrame([(i, i % kinds, i * 1.5 + (100 if i in change else 0), f"n{i}") for i in ids], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("id", "kind", "x", "note").collect()))


def request(source, dest, **extra):
    return parse_request(json.dumps({"id": uuid.uuid4().hex, "source": source, "dest": dest, "strategy": {"ids": ["id"]}} | extra))


@pytest.fixture
def derby(spark):
    options = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}

    def table(name, df):
        loaders.save(df, Resource(table=name, format="jdbc", options=options | {"createTableColumnTypes": "note VARCHAR(64)"}))
        return {"table": name, "format": "jdbc", "options": options}

    return table


@pytest.mark.parametrize("dst, changed", [(range(1, 16), ()), (range(1, 16), (3,)), (range(5, 30), (7, 8)), ([], ())])
@pytest.mark.parametrize("parts", [[], ["kind"]])
def test_jdbc_destination(spark, derby, tmp_path, dst, changed, parts):
    frame(spark, range(1, 21)).write.parquet(str(tmp_path / "src"))
    dest = derby("EVENTS", frame(spark, dst, changed))
    r = request({"path": str(tmp_path / "src")}, dest, strategy={"ids": ["id"], "partition": {"columns": parts}},
                transfer={"writers": 2, "batchSize": 3, "suffix": "ns", "maxRetries": 0})
    out = Engine(spark).sync(r)
    assert out.status == "ok", out.error
    assert rows(loaders.load(spark, r.dest)) == rows(frame(spark, range(1, 21)))
    con = loaders.connection(spark, r.dest)
    found = con.getMetaData().getTables(None, "APP", "%", None)
    names = []
    while found.next():
        names.append(found.getString(3))
    con.close()
    assert names == ["EVENTS"]  # staging tables are gone


def test_jdbc_without_ids_and_with_a_failure(spark, derby, tmp_path):
    frame(spark, range(1, 21)).write.parquet(str(tmp_path / "src"))
    dest = derby("EVENTS", frame(spark, range(1, 25), (6,)))
    by = {"ids": [], "partition": {"columns": ["kind"]}}
    assert Engine(spark).sync(request({"path": str(tmp_path / "src")}, dest, strategy=by)).status == "ok"
    resource = parse_request(json.dumps({"source": dest, "dest": dest})).dest
    assert rows(loaders.load(spark, resource)) == rows(frame(spark, range(1, 21)))
    # a statement that fails undoes those before it
    long = frame(spark, [99]).withColumn("id", F.lit(None).cast("long"))
    con = loaders.connection(spark, resource)
    statement = con.createStatement()
    statement.executeUpdate('ALTER TABLE EVENTS ADD CONSTRAINT small_kind CHECK ("kind" < 4)')
    statement.close()
    con.close()
    bad = frame(spark, [50]).withColumn("kind", F.lit(9))
    whole = loaders.load(spark, resource)
    transfer = parse_request(json.dumps({"source": dest, "dest": dest})).transfer
    with pytest.raises(Exception, match="(?i)check constraint"):
        loaders.write_change(whole, Change([frame(spark, [1, 2]).select("id")], bad), resource, transfer)
    assert rows(loaders.load(spark, resource)) == rows(frame(spark, range(1, 21))) and long.count() == 1


def test_jdbc_source_is_read_in_parts_and_once(spark, derby, tmp_path):
    src = derby("SRC", frame(spark, range(1, 41)))
    table = SnapshotTable(spark, str(tmp_path / "dst"))
    table.commit(frame(spark, range(1, 30), (5,)))
    r = request(src | {"readers": 4, "split": "id"}, {"path": str(tmp_path / "dst")})
    assert loaders.load(spark, r.source).rdd.getNumPartitions() == 4
    out = Engine(spark).sync(r)
    assert out.status == "ok", out.error
    assert rows(table.read()) == rows(frame(spark, range(1, 41)))
    hinted = Resource(table="SRC", format="jdbc", options=src["options"], hint="/* no hint */")
    assert loaders.load(spark, hinted).count() == 40


def test_catalog_table(spark, tmp_path):
    frame(spark, range(1, 21)).write.parquet(str(tmp_path / "src"))
    name = f"t{uuid.uuid4().hex[:8]}"
    for dst, changed in ((range(1, 16), (3,)), (range(1, 16), ())):
        frame(spark, dst, changed).write.mode("overwrite").saveAsTable(name)
        out = Engine(spark).sync(request({"path": str(tmp_path / "src")}, {"table": name}))
        assert out.status == "ok", out.error
        assert rows(spark.table(name)) == rows(frame(spark, range(1, 21)))
    spark.sql(f"drop table {name}")


def test_one_changed_row_of_a_hundred_slices_writes_one_file(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    src = frame(spark, range(10_000), kinds=100)
    table.commit(src.repartitionByRange(100, "kind"))
    before = set(table.manifest()["files"])
    assert len(before) == 100
    src.withColumn("x", F.when(F.col("id") == 4242, -1.0).otherwise(F.col("x"))).write.parquet(str(tmp_path / "src"))
    r = request({"path": str(tmp_path / "src")}, {"path": str(tmp_path / "t")}, strategy={"ids": ["id"], "partition": {"columns": ["kind"]}, "chunk": {"size": 0}})
    out = Engine(spark).sync(r)
    assert out.status == "ok" and out.methods == {"inSync": 99, "merge": 1}, out.error
    after = set(table.manifest()["files"])
    assert len(before - after) == 1 and table.read().filter("x = -1").count() == 1 and table.read().count() == 10_000
    # an append adds files and rewrites none
    frame(spark, range(10_000, 10_010), kinds=100).union(spark.read.parquet(str(tmp_path / "src"))).write.parquet(str(tmp_path / "more"))
    r = request({"path": str(tmp_path / "more")}, {"path": str(tmp_path / "t")}, strategy={"ids": ["id"]})
    assert Engine(spark).sync(r).methods == {"insert": 1}
    assert after < set(table.manifest()["files"]) and table.read().count() == 10_010
    table.vacuum(keep=1)
    assert table.read().count() == 10_010 and len(table.versions()) == 1
    with pytest.raises(ConflictError):
        table.change([], frame(spark, [1]), expect=0)


def test_columns_the_source_lacks(spark, tmp_path):
    src = frame(spark, range(1, 21)).drop("note")
    dst = frame(spark, range(1, 16), (4,))
    for parts in ([], ["kind"]):
        got = {r.id: r for r in synchronise(src, dst, ["id"], parts).result.collect()}
        assert sorted(got) == list(range(1, 21)) and got[4].x == 6.0 and got[4].note == "n4" and got[20].note is None
    assert {r.id for r in synchronise(src, dst, [], ["kind"]).result.collect()} == set(range(1, 21))
    src.write.parquet(str(tmp_path / "src"))
    SnapshotTable(spark, str(tmp_path / "t")).commit(dst)
    assert Engine(spark).sync(request({"path": str(tmp_path / "src")}, {"path": str(tmp_path / "t")})).status == "ok"
    assert {r.id: r.note for r in SnapshotTable(spark, str(tmp_path / "t")).read().collect()}[4] == "n4"


def test_values_that_do_not_fit_fail_the_sync(spark, tmp_path):
    spark.createDataFrame([(1, 2**40), (2, 5)], "id long, v long").write.parquet(str(tmp_path / "src"))
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.commit(spark.createDataFrame([(2, 5)], "id long, v int"))
    out = Engine(spark).sync(request({"path": str(tmp_path / "src")}, {"path": str(tmp_path / "t")}, transfer={"maxRetries": 0}))
    assert out.status == "error" and "does not fit int" in out.error and table.version() == 0


@pytest.mark.parametrize("strategy, commits", [
    ({"partition": {"columns": ["kind"], "syncMode": "individual"}}, 3),
    ({"chunk": {"size": 10, "syncMode": "individual"}}, 2),
    ({"partition": {"columns": ["kind"]}}, 1),
])
def test_slices_one_by_one(spark, tmp_path, strategy, commits):
    frame(spark, range(1, 31)).write.parquet(str(tmp_path / "src"))
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.commit(frame(spark, [i for i in range(1, 31) if i not in (22, 23)], (5,)))
    out = Engine(spark).sync(request({"path": str(tmp_path / "src")}, {"path": str(tmp_path / "t")}, strategy={"ids": ["id"]} | strategy))
    assert out.status == "ok", out.error
    assert rows(table.read()) == rows(frame(spark, range(1, 31))) and table.version() == commits


def test_a_slice_is_tried_three_times(spark, tmp_path, monkeypatch):
    frame(spark, range(1, 9)).write.parquet(str(tmp_path / "src"))
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.commit(frame(spark, range(1, 9), (5, 6)))
    engine, calls = Engine(spark), []
    own = SnapshotTable.change

    def sometimes(self, *args, **kw):
        calls.append(1)
        if len(calls) in (1, 2):
            raise RuntimeError("lost")
        return own(self, *args, **kw)

    monkeypatch.setattr(SnapshotTable, "change", sometimes)
    monkeypatch.setattr(Engine, "PAUSE_S", 0)
    r = request({"path": str(tmp_path / "src")}, {"path": str(tmp_path / "t")}, transfer={"maxRetries": 0},
                strategy={"ids": ["id"], "partition": {"columns": ["kind"], "syncMode": "individual"}})
    assert engine.sync(r).status == "ok" and len(calls) == 4 and rows(table.read()) == rows(frame(spark, range(1, 9)))


def test_append_only_chunks_are_skipped_fast(spark):
    src = frame(spark, range(1, 41))
    dst = frame(spark, range(1, 36), (3,))  # 3 differs, but counts and ids of its chunk agree
    out = synchronise(src, dst, ["id"], chunk_size=10, append_only=True)
    assert out.methods == {"inSync": 3, "insert": 1} and out.moved.count() == 5
    assert {r.id for r in out.result.collect()} == set(range(1, 41))


def test_settings_are_used_or_refused():
    base = {"source": {"table": "a"}, "dest": {"table": "b"}}
    for change in (
        {"strategy": {"mergeStyle": "sideways"}},
        {"strategy": {"diff": {"batchSize": 0}}},
        {"transfer": {"writers": -1}},
        {"dest": {"path": "/x"}, "transfer": {"tempDatabase": "tmp"}},
        {"source": {"table": "a", "readers": 4}},
    ):
        with pytest.raises(ValueError):
            parse_request(json.dumps(base | change)).init().validate()


def test_locks_and_finished_jobs_are_forgotten(spark, tmp_path):
    frame(spark, range(1, 9)).write.parquet(str(tmp_path / "src"))
    engine = Engine(spark)
    for k in range(2):
        SnapshotTable(spark, str(tmp_path / f"t{k}")).commit(frame(spark, range(1, 5)))
        r = request({"path": str(tmp_path / "src")}, {"path": str(tmp_path / f"t{k}")}, async_=True)
        engine.sync(r)
        engine.running[r.request_id()].result()
    assert not engine.locks._held and len(engine.running) == 1


def sent(spark, before=frozenset()):
    """Rows that left databases: the output of every JDBC scan of the executions not in ``before``."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, total, seen = store.executionsList(), 0, set()
    for k in range(executions.size()):
        e = executions.apply(k).executionId()
        seen.add(e)
        if e in before:
            continue
        nodes = store.planGraph(e).allNodes()
        for n in range(nodes.size()):
            node = nodes.apply(n)
            if not node.name().startswith("Scan JDBC"):
                continue
            values, metrics = store.executionMetrics(e), node.metrics()
            for m in range(metrics.size()):
                if metrics.apply(m).name() == "number of output rows" and values.contains(metrics.apply(m).accumulatorId()):
                    total += int(values.apply(metrics.apply(m).accumulatorId()).replace(",", ""))
    return total, seen


@pytest.mark.parametrize("parts, batch", [(["kind"], 512), (["kind"], 1), (["kind", "half"], 3)])
def test_jdbc_source_sends_only_slices_that_differ(spark, derby, tmp_path, parts, batch):
    half = lambda df: df.withColumn("half", F.when(F.col("id") % 2 == 0, 7))
    src = derby("SRC", half(frame(spark, range(1, 2001), kinds=20)))
    table = SnapshotTable(spark, str(tmp_path / "dst"))
    table.commit(half(frame(spark, [i for i in range(1, 2001) if i % 20 != 3], (47,), kinds=20)))
    strategy = {"ids": ["id"], "partition": {"columns": parts}, "diff": {"batchSize": batch}}
    _, before = sent(spark)
    out = Engine(spark).sync(request(src, {"path": str(tmp_path / "dst")}, strategy=strategy))
    assert out.status == "ok", out.error
    # one partition of twenty is missing, another has a changed row
    assert rows(table.read()) == rows(frame(spark, range(1, 2001), kinds=20))
    assert out.transferred == 200
    n, _ = sent(spark, before)
    assert 200 <= n <= 200 + 3 * 2 * 20, n  # the slices, and signatures


def test_jdbc_tail_criteria_and_columns(spark, derby, tmp_path):
    src = derby("SRC", frame(spark, range(1, 1001), kinds=4))
    table = SnapshotTable(spark, str(tmp_path / "dst"))
    table.commit(frame(spark, range(1, 901), kinds=4))
    strategy = {"ids": ["id"], "partition": {"columns": ["kind"]}}
    _, before = sent(spark)
    out = Engine(spark).sync(request(src | {"criteria": {"kind": [1, 2]}}, {"path": str(tmp_path / "dst"), "criteria": {"kind": [1, 2]}}, strategy=strategy))
    assert out.status == "ok" and out.methods == {"insert": 2}, (out.error, out.methods)
    n, before = sent(spark, before)
    assert n <= 50 + 20, n
    assert rows(table.read()) == rows(frame(spark, [i for i in range(1, 1001) if i <= 900 or i % 4 in (1, 2)], kinds=4))
    # ids beyond the destination's greatest, by one maximum
    table.commit(frame(spark, range(1, 901), kinds=4), expect=table.version())
    out = Engine(spark).sync(request(src, {"path": str(tmp_path / "dst")}, strategy={"ids": ["id"], "diff": {"newIdOnly": True}}))
    assert out.status == "ok" and sent(spark, before)[0] <= 100 and table.read().count() == 1000, out.error
    # what the database cannot sum is read once instead
    Resource(table="BIG", format="jdbc", options=src["options"])
    loaders.save(frame(spark, range(1, 50)), Resource(table="BIG", format="jdbc", options={k: v for k, v in src["options"].items() if k != "createTableColumnTypes"}))
    plain = {"table": "BIG", "format": "jdbc", "options": {k: v for k, v in src["options"].items() if k != "createTableColumnTypes"}}
    table.commit(frame(spark, range(1, 40)), expect=table.version())
    out = Engine(spark).sync(request(plain, {"path": str(tmp_path / "dst")}))
    assert out.status == "ok" and rows(table.read()) == rows(frame(spark, range(1, 50))), out.error


def test_a_source_that_changes_meanwhile_is_an_error(spark):
    from deltaloom.sources.jdbc import MovedError, check_staged

    plan = spark.createDataFrame([(4, 1, 4, None)], "src_cnt long, src_min long, src_max long, in_sync_id long")
    check_staged(frame(spark, [1, 2, 3, 4]), plan, "id")
    for ids in ([1, 2, 3], [1, 2, 3, 5]):
        with pytest.raises(MovedError):
            check_staged(frame(spark, ids), plan, "id")
