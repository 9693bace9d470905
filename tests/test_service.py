import json
import threading
import urllib.error
import urllib.request

import pytest

from deltaloom.contract import Resource, parse_request
from deltaloom.plans.engine import Engine
from deltaloom.plans.http import routes, server
from deltaloom.plans.transfer import Transfers
from deltaloom.sources.store import SnapshotTable


def frame(spark, ids):
    return spark.createDataFrame([(i, i % 4, float(i)) for i in ids], "id long, kind int, x double")


@pytest.fixture
def api(spark, tmp_path):
    frame(spark, range(1, 21)).write.parquet(str(tmp_path / "src"))
    SnapshotTable(spark, str(tmp_path / "dst")).commit(frame(spark, range(1, 11)))
    engine = Engine(spark)
    web = server(routes(engine, transfers=Transfers(spark)), port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def call(method, path, data=None):
        body = json.dumps(data).encode() if data is not None else None
        r = urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", body, method=method)
        try:
            with urllib.request.urlopen(r, timeout=120) as out:
                return out.status, json.loads(out.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield call, tmp_path
    web.shutdown()


def test_routes(spark, api):
    call, path = api
    body = {"id": "j", "source": {"path": f"{path}/src"}, "dest": {"path": f"{path}/dst"}, "strategy": {"ids": ["id"]}}
    status, r = call("POST", "/v1/api/sync", body)
    assert status == 200 and r["transferred"] == 10 and r["methods"] == {"insert": 1}
    assert call("GET", "/v1/api/jobs")[1][0]["status"] == "done"
    assert call("GET", "/v1/api/job/j,k")[1][0]["progress"]["pct"] in (50, 100)
    assert len(call("GET", "/v1/api/history/j")[1]) == 1 and call("GET", "/status")[1]["status"] == "ok"
    assert call("GET", "/v1/api/schedules")[1] == []
    assert call("POST", "/v1/api/sync", {"source": {}})[0] == 400 and call("GET", "/v1/api/nothing")[0] == 404
    to = {"path": f"{path}/copy", "format": "json"}
    status, t = call("POST", "/v1/api/transfer", {"source": {"path": f"{path}/src"}, "dest": to, "writers": 3, "omit": True})
    assert status == 200 and (t["status"], t["rows"]) == ("done", 20)
    assert call("GET", f"/v1/api/task/{t['id']}")[1]["rows"] == 20 and len(call("GET", "/v1/api/tasks")[1]) == 1


def test_failed_transfer_keeps_its_error(spark, tmp_path):
    t = Transfers(spark).run(Resource(path=str(tmp_path / "none")), Resource(path=str(tmp_path / "x")), retries=1)
    assert t.status == "error" and t.attempts == 2 and t.error


def test_asked_partitions_and_direct_append(spark, api):
    _, path = api
    spark.read.parquet(f"{path}/src").createOrReplaceTempView("src_view")
    body = {
        "source": {"path": f"{path}/src", "partitionSql": "select distinct kind from src_view where kind < 2"},
        "dest": {"path": f"{path}/dst"},
        "strategy": {"ids": ["id"], "partition": {"columns": ["kind"]}, "directAppend": True},
        "dmlTimeout": 300,
    }
    r = Engine(spark).sync(parse_request(json.dumps(body)))
    assert r.status == "ok", r.error
    got = sorted(x.id for x in SnapshotTable(spark, f"{path}/dst").read().collect())
    assert got == sorted([*range(1, 11), *[i for i in range(11, 21) if i % 4 < 2]])


def test_transfers_in_the_background_and_without_duplicates(spark, tmp_path, monkeypatch):
    import time
    import uuid

    from deltaloom.sources import loaders

    frame(spark, range(20)).write.parquet(str(tmp_path / "src"))
    options = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    dest = Resource(table="T", format="jdbc", options=options)
    loaders.save(frame(spark, [100]), dest)
    own, calls = loaders._change_jdbc, []

    def late(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost after the stage")
        return own(*args)

    monkeypatch.setattr(loaders, "_change_jdbc", late)
    transfers = Transfers(spark)
    t = transfers.run(Resource(path=str(tmp_path / "src")), dest, async_=True, writers=2)
    end = time.time() + 120
    while transfers.get(t.id).status == "running" and time.time() < end:
        time.sleep(0.2)
    assert (t.status, t.rows, t.attempts) == ("done", 20, 2), t.error
    assert loaders.load(spark, dest).count() == 21
    with pytest.raises(ValueError):
        transfers.run(Resource(path="x"), dest, mode="sideways")


def test_a_broken_file_does_not_stop_the_scheduler(tmp_path):
    from datetime import datetime

    from deltaloom.plans.control import Scheduler

    good = {"source": {"table": "a"}, "dest": {"table": "b"}, "schedule": {"frequency": {"value": 1, "unit": "hour"}}}
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "good.json").write_text(json.dumps(good))
    ran = []

    def run(request):
        ran.append(request)
        raise RuntimeError("down")

    s = Scheduler(str(tmp_path), run, parse_request, reload_s=0)
    assert len(s.tick(datetime(2020, 1, 1))) == 1 and len(s.broken) == 1 and len(s.entries) == 1
    assert next(iter(s.entries.values()))["errors"] == 1
    (tmp_path / "bad.json").write_text(json.dumps(good) + " ")
    import os

    os.utime(tmp_path / "bad.json", (1, 1))
    assert len(s.tick(datetime(2020, 1, 1, 0, 0, 1))) >= 1 and not s.broken and len(s.entries) == 2


def test_spans_of_days():
    from datetime import date

    from deltaloom.plans.quality import days, over_dates

    assert list(days(date(2020, 1, 30), date(2020, 2, 2), 3)) == [(date(2020, 1, 30), date(2020, 2, 1)), (date(2020, 2, 2), date(2020, 2, 2))]

    class Done:
        def __init__(self, status):
            self.status = status

    out = over_dates(lambda r: Done("error" if r[0].day == 2 else "ok"), lambda a, b: (a, b), date(2020, 1, 1), date(2020, 1, 5))
    assert [o.status for o in out] == ["ok", "error"]


def test_scalars_of_other_databases(spark):
    from deltaloom.functions.criteria import layout, translated
    from deltaloom.operators.projection import with_pseudo

    assert layout('YYYY-MM-DD"T"HH24:MI:SS') == "yyyy-MM-dd'T'HH:mm:ss"
    df = spark.sql("select timestamp'2020-03-04 05:06:07' ts, cast(null as timestamp) created")
    pseudo = {
        "d": "TO_CHAR(t.ts, 'YYYY-MM-DD')", "m": "to_char(t.ts, 'YYYYMM')", "s": "UNIX_SECONDS(COALESCE(t.created, t.ts))",
        "o": "ROUND((CAST(t.ts AS DATE) - to_date('1970-01-01','YYYY-MM-DD')) * 86400)", "v": "date(t.ts)::varchar(10)",
        "old": "t.ts < NOW() - INTERVAL 3 DAY", "older": "t.ts < sysdate - 3", "y": "DATE_FORMAT(t.ts, 'yyyy')",
    }
    r = with_pseudo(df, pseudo).first()
    assert (r.d, r.m, r.s, r.o, r.v, r.old, r.older, r.y) == ("2020-03-04", "202003", 1583298367, 1583298367, "2020-03-04", True, True, "2020")
    assert translated("t.a + 1") == "t.a + 1"
