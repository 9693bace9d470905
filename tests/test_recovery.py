"""Runs that stop half-way, several drivers, and catalog tables that change by partition."""

import json
import os
import subprocess
import sys
import time
import uuid

import pytest
from pyspark.sql import functions as F

from deltaloom.contract import parse_request
from deltaloom.plans.engine import Engine
from deltaloom.plans.journal import Journal
from deltaloom.sources.lease import HeldError, Lease, leased
from deltaloom.sources.store import SnapshotTable

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "id long, kind int, x double"


def frame(spark, ids, change=(), kinds=4):
    return spark.createDataFrame([(i, i % kinds, i * 1.5 + (100 if i in change else 0)) for i in ids], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("id", "kind", "x").collect()))


def request(source, dest, strategy, **more):
    return parse_request(json.dumps({"id": "r", "source": source, "dest": dest, "strategy": {"ids": ["id"]} | strategy} | more))


def test_a_killed_run_continues_where_it_stopped(spark, tmp_path, monkeypatch):
    src, table = str(tmp_path / "src"), SnapshotTable(spark, str(tmp_path / "t"))
    frame(spark, range(40)).write.parquet(src)
    table.commit(frame(spark, range(40), range(40)))
    r = request({"path": src}, {"path": table.path}, {"partition": {"columns": ["kind"], "syncMode": "individual"}}, transfer={"maxRetries": 0})
    own, done = Engine._slice, []

    def dies(self, request, sides, response, where):
        if len(done) == 2:
            raise KeyboardInterrupt
        own(self, request, sides, response, where)
        done.append(1)

    monkeypatch.setattr(Engine, "_slice", dies)
    with pytest.raises(KeyboardInterrupt):
        Engine(spark).sync(r)
    assert table.version() == 2
    done[:] = []
    monkeypatch.setattr(Engine, "_slice", lambda *a: (own(*a), done.append(1)))
    out = Engine(spark).sync(r)
    assert out.status == "ok" and len(done) == 2 and table.version() == 4 and rows(table.read()) == rows(frame(spark, range(40)))
    monkeypatch.setattr(Engine, "_slice", own)
    assert Engine(spark).sync(r).status == "ok" and table.version() == 4  # the journal is gone, nothing differs


def test_sixty_thousand_slices_page_by_page(spark, tmp_path):
    journal = Journal(spark, uuid.uuid4().hex, str(tmp_path))
    journal.write(spark.range(60_000).select((F.col("id") * 7 % 60_000).alias("id"), F.lit(None).cast("int").alias("part")))
    at = 0
    for number, row in journal.remaining():
        assert number == at == row["id"]
        at += 1
        if at == 2_500:
            journal.mark(number)
            break
    assert Journal(spark, journal.path.rsplit("journal-", 1)[1], str(tmp_path)).done() == 2_499
    rest = [n for n, _ in journal.remaining()]
    assert rest == list(range(2_500, 60_000))
    journal.close()
    assert not journal.exists() and journal.done() == -1


def test_of_two_drivers_one_runs_and_an_expired_lease_is_taken_over(spark, tmp_path):
    root, mine = str(tmp_path), Lease(spark, str(tmp_path), "job x", 60)
    mine.take()
    code = (
        "import sys\nsys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\nfrom deltaloom.sources.lease import Lease, HeldError\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "lease = Lease(spark, sys.argv[2], 'job x', float(sys.argv[3]))\n"
        "try:\n    lease.take()\n    print('TAKEN', flush=True)\n    import os; os._exit(9)\nexcept HeldError:\n    print('HELD')\n"
    )
    other = lambda ttl: subprocess.run([sys.executable, "-c", code, REPO, root, str(ttl)], capture_output=True, text=True, timeout=120).stdout
    assert "HELD" in other(60)
    mine.release()
    assert "TAKEN" in other(1)  # and dies with it
    again = Lease(spark, root, "job x", 1)
    with leased(spark, root, "job x", wait_s=30, ttl_s=1):
        with pytest.raises(HeldError):
            Lease(spark, root, "job x").take()
        time.sleep(3.5)  # renewed meanwhile
        with pytest.raises(HeldError):
            Lease(spark, root, "job x").take()
    again.take()
    again.release()


def test_a_job_held_by_another_driver_is_refused(spark, tmp_path):
    frame(spark, range(4)).write.parquet(str(tmp_path / "src"))
    r = request({"path": str(tmp_path / "src")}, {"path": str(tmp_path / "t")}, {})
    SnapshotTable(spark, str(tmp_path / "t")).commit(frame(spark, range(2)))
    engine = Engine(spark, leases=str(tmp_path))
    with leased(spark, str(tmp_path), "job r"):
        out = engine.sync(r)
        assert out.status == "error" and "another driver" in out.error
    assert engine.sync(r).status == "ok"


def test_one_dirty_partition_of_a_catalog_table_is_written(spark, tmp_path):
    name = f"t{uuid.uuid4().hex[:8]}"
    frame(spark, range(200), (42,), kinds=20).select("id", "x", "kind").write.partitionBy("kind").saveAsTable(name)
    where = spark.sql(f"describe formatted {name}").filter("col_name = 'Location'").first()["data_type"].removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(where) for f in fs if f.endswith(".parquet")}
    before = files()
    src = str(tmp_path / "src")
    frame(spark, [i for i in range(200) if i % 20 != 7], kinds=20).write.parquet(src)
    out = Engine(spark).sync(request({"path": src}, {"table": name}, {"partition": {"columns": ["kind"]}}))
    assert out.status == "ok" and out.methods == {"inSync": 18, "merge": 1, "removed": 1}, (out.error, out.methods)
    assert rows(spark.table(name)) == rows(frame(spark, [i for i in range(200) if i % 20 != 7], kinds=20))
    gone = {f.split("kind=")[1].split("/")[0] for f in before - files()}
    assert gone == {"2", "7"} and not os.path.isdir(f"{where}/kind=7")
    spark.sql(f"drop table {name}")


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    from deltaloom.sources import loaders

    name = f"t{uuid.uuid4().hex[:8]}"
    frame(spark, range(20), (3,)).write.saveAsTable(name)
    src = str(tmp_path / "src")
    frame(spark, range(20)).write.parquet(src)
    r = request({"path": src}, {"table": name}, {}, transfer={"maxRetries": 0})
    own = loaders._swap

    def fails(result, table):
        own(result.withColumn("x", F.raise_error(F.lit("lost"))), table)

    monkeypatch.setattr(loaders, "_swap", fails)
    assert Engine(spark).sync(r).status == "error" and rows(spark.table(name)) == rows(frame(spark, range(20), (3,)))
    monkeypatch.setattr(loaders, "_swap", own)
    assert Engine(spark).sync(r).status == "ok" and rows(spark.table(name)) == rows(frame(spark, range(20)))
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    spark.sql(f"drop table {name}")
