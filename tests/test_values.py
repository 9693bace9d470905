"""Signatures on every value, rules that hold in every mode, ranges and sketched chunks."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from deltaloom.contract import parse_request
from deltaloom.operators import chunking, diff
from deltaloom.operators.signature import plan_columns, signature
from deltaloom.plans.engine import Engine, synchronise
from deltaloom.sources.store import SnapshotTable

SCHEMA = "id long, x double, n int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_values_are_no_zeros(spark):
    """A slice for each pair of values: in sync where they are the same, and only there."""
    values = [NAN, INF, -INF, 1e31, -1e300, 1e16, 3e15, 0.0, None]
    pairs = list(enumerate((a, b) for a in values for b in values))
    src, dst = ([(2 * k + j, p[side] if not j else 1.5, k) for k, p in pairs for j in (0, 1)] for side in (0, 1))
    out = synchronise(frame(spark, src), frame(spark, dst), ["id"], ["n"])
    got = {r.n: r.method for r in out.plan.collect()}
    zero = lambda v: "0.0" if v is None else str(v)  # noqa: E731 - a null counts as zero, as documented
    assert got == {k: "inSync" if zero(a) == zero(b) else "merge" for k, (a, b) in pairs}
    result = {r.id: str(r.x) for r in out.result.collect()}
    assert all(result[2 * k] == str(a) for k, (a, b) in pairs if zero(a) != zero(b))


def test_odd_values_move_between_rows_of_equal_sums(spark):
    a = frame(spark, [(1, NAN, 1), (2, INF, 1), (3, 1e31, 1)])
    assert synchronise(a, frame(spark, [(3, NAN, 1), (1, INF, 1), (2, 1e31, 1)]), ["id"]).in_sync  # a multiset, as sums are
    assert not synchronise(a, frame(spark, [(3, NAN, 1), (1, INF, 1), (2, 1e31, 1)]), ["id"], hashed=True).in_sync


def test_a_fraction_against_a_decimal_or_an_integer(spark):
    src = spark.createDataFrame([(1, NAN)], "id long, x double")
    for kind in ("decimal(20,2)", "long"):
        dst = spark.createDataFrame([(1,)], "id long").withColumn("x", F.lit(0).cast(kind))
        assert diff.diff(src, dst, ["id"]).first()["method"] == "merge"
        with pytest.raises(Exception, match="does not fit"):
            synchronise(src, dst, ["id"])


def test_snowflake_ids_and_sums_of_extremes(spark):
    top = 1_700_000_000_000_000_000
    ids = [top + 7 * k for k in range(10)]
    src = frame(spark, [(i, 1.0, 2**31 - 1) for i in ids])
    assert synchronise(src, src, ["id"]).in_sync
    out = synchronise(src, frame(spark, [(i, 1.0, 2**31 - 1) for i in ids[:-1]] + [(ids[-1], 1.0, 5)]), ["id"])
    assert out.methods == {"merge": 1}
    values = [2**63 - 1, -(2**63), 2**63 - 1, 12345, -1, 0]
    df = spark.createDataFrame([(v, v % 2**31 - 2**30, v % 2**15 - 2**14) for v in values], "a long, b int, c short")
    got = signature(df, plan_columns(df)).first()
    assert [int(got[f"sum_{c}"]) for c in "abc"] == [sum(r[k] for r in df.collect()) for k in range(3)]


def test_row_hash_sees_what_sums_do_not(spark):
    a = frame(spark, [(1, 1.0, 5), (2, 2.0, 6)])
    swapped, nulled = frame(spark, [(1, 2.0, 5), (2, 1.0, 6)]), frame(spark, [(1, 1.0, 5), (2, 2.0, 6)]).withColumn("n", F.col("n"))
    assert synchronise(a, swapped, ["id"]).in_sync
    out = synchronise(a, swapped, ["id"], hashed=True)
    assert not out.in_sync and sorted(map(tuple, out.result.collect())) == sorted(map(tuple, a.collect()))
    assert synchronise(a, nulled, ["id"], hashed=True).in_sync
    zero, null = frame(spark, [(1, 1.0, 0)]), frame(spark, [(1, 1.0, None)])
    assert synchronise(zero, null, ["id"]).in_sync and not synchronise(zero, null, ["id"], hashed=True).in_sync
    close = frame(spark, [(1, 1.0000000001, 5), (2, 2.0, 6)])
    assert synchronise(a, close, ["id"], hashed=True).in_sync


def run(spark, tmp_path, src, dst, **strategy):
    name = uuid.uuid4().hex
    src.write.parquet(str(tmp_path / name))
    table = SnapshotTable(spark, str(tmp_path / f"d{name}"))
    table.commit(dst)
    body = {"id": name, "source": {"path": str(tmp_path / name)} | strategy.pop("source", {}), "dest": {"path": table.path}, "strategy": {"ids": ["id"]} | strategy}
    return Engine(spark).sync(parse_request(json.dumps(body))), table


@pytest.mark.parametrize("settings", [{}, {"chunk": {"size": 4}}, {"diff": {"ranges": 3}}, {"diff": {"depth": 3}}, {"ids": []}, {"chunk": {"size": 4}, "diff": {"hash": True}}])
def test_an_empty_source_empties_the_destination_in_every_mode(spark, tmp_path, settings):
    dst = frame(spark, [(i, 1.0, i % 2) for i in range(10)])
    out, table = run(spark, tmp_path, dst.limit(0), dst, **settings)
    assert out.status == "ok" and table.read().count() == 0, (out.status, out.error, out.methods)
    again, _ = run(spark, tmp_path, dst.limit(0), dst.limit(0), **settings)
    assert again.status == "ok", again.error


def test_two_changes_far_apart_move_two_ranges(spark, tmp_path):
    rows = [(i, i * 1.5, i % 7) for i in range(1, 4001)]
    changed = {17, 3907}
    src, dst = frame(spark, rows), frame(spark, [(i, x + (9 if i in changed else 0), n) for i, x, n in rows if i != 2000] + [(5000, 1.0, 1)])
    out, table = run(spark, tmp_path, src, dst, diff={"ranges": 8})
    assert out.status == "ok" and out.transferred <= 4 * 4000 / 250, (out.error, out.transferred)
    assert sorted(map(tuple, table.read().collect())) == rows
    # by partition, and with slices that stay whole
    src, dst = frame(spark, rows), frame(spark, [(i, x + (9 if i in changed else 0), n) for i, x, n in rows if n != 5])
    out, table = run(spark, tmp_path, src, dst, partition={"columns": ["n"]}, diff={"ranges": 6})
    assert out.status == "ok" and out.methods["insert"] == 1 and out.methods["merge"] == 2, (out.error, out.methods)
    assert sorted(map(tuple, table.read().collect())) == rows and out.transferred < 571 + 2 * 20


def test_ranges_of_spread_ids(spark, tmp_path):
    rows = [(k * (1 << 50) - (1 << 62), float(k), 0) for k in range(8000)]
    dst = frame(spark, [(i, x + (k == 4321), n) for k, (i, x, n) in enumerate(rows)])
    out, table = run(spark, tmp_path, frame(spark, rows), dst, diff={"ranges": 10})
    assert out.status == "ok" and out.transferred <= 10 and sorted(map(tuple, table.read().collect())) == sorted(rows)


def test_ranges_of_ids_in_clusters(spark, tmp_path):
    """Ids in clusters far apart, each within one range of equal width: the ranges of both changes are cut again."""
    rows = [(c * 10**12 + k, float(k), c % 2) for c in range(6) for k in range(700)] + [(1 << k, 0.5, 0) for k in range(45, 62)]
    dst = frame(spark, [(i, x + (i in (3, 5 * 10**12 + 650)), n) for i, x, n in rows])
    for more in ({}, {"partition": {"columns": ["n"]}}):
        out, table = run(spark, tmp_path, frame(spark, rows), dst, diff={"ranges": 5}, **more)
        assert out.status == "ok" and 2 <= out.transferred <= 2 * 4 * len(rows) / 32, (out.error, out.transferred, out.methods)
        assert sorted(map(tuple, table.read().collect())) == sorted(rows)
    # one id that differs is moved alone, however ids are spread
    out, table = run(spark, tmp_path, frame(spark, rows), dst.filter("id <> 1 << 61").unionByName(frame(spark, [((1 << 61) + 1, 0.5, 0)])), diff={"ranges": 20})
    assert out.status == "ok" and out.transferred <= 9 and sorted(map(tuple, table.read().collect())) == sorted(rows), (out.error, out.transferred)


@pytest.mark.parametrize("n, size", [(1000, 64), (1000, 1000), (50_000, 2_000), (5, 2), (1, 1)])
def test_sketched_chunks_are_of_even_size(spark, n, size):
    df = spark.range(n).select((F.col("id") * F.col("id") - 500).alias("id"))
    bounds = [r["lo"] for r in chunking.sketched(df, "id", size).orderBy("chunk").collect()]
    ids = sorted(k * k - 500 for k in range(n))
    assert bounds[0] == ids[0] and bounds == sorted(set(bounds))
    at = [ids.index(b) for b in bounds] + [n]
    assert len(bounds) == -(-n // size) and all(abs(b - a - size) <= max(1, 0.02 * size) for a, b in zip(at[:-2], at[1:-1], strict=True))


def test_sketched_chunks_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(chunking, "FAN", 7)
    df = spark.range(5000)
    got = chunking.sketched(df, "id", 50).orderBy("chunk").collect()
    assert [r["chunk"] for r in got] == list(range(len(got))) and 98 <= len(got) <= 105
    sizes = [b["lo"] - a["lo"] for a, b in zip(got, got[1:], strict=False)]
    assert max(sizes) <= 55 and got[0]["lo"] == 0


@pytest.mark.parametrize("n, size", [(20_030, 200), (50_400, 400), (9_999, 100)])
def test_chunks_of_two_levels_are_even_and_as_many_as_by_ranks(spark, monkeypatch, n, size):
    monkeypatch.setattr(chunking, "FAN", 7)
    df = spark.range(n).select(((F.col("id") * 7919) % n * 3).alias("id")).repartition(5)
    got = chunking.sketched(df, "id", size).orderBy("chunk").collect()
    assert [r["chunk"] for r in got] == list(range(-(-n // size))) and got[0]["lo"] == 0
    sizes = [(b["lo"] - a["lo"]) // 3 for a, b in zip(got, got[1:], strict=False)]
    assert all(abs(s - size) <= size // 100 for s in sizes), sizes


def test_the_default_plan_of_chunks_shuffles_no_ids(spark):
    df = spark.range(10_000)
    plan = df.agg(F.percentile_approx("id", [0.5], 10_000))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_chunks_by_the_users_query(spark, tmp_path):
    rows = [(i, 1.0 * i, 0) for i in range(1, 101)]
    frame(spark, rows).createOrReplaceTempView("of_chunks")
    sql = "select count(*) c, min(id) a, max(id) b from (select id from of_chunks where id >= $max order by id limit $limit)"
    out, table = run(spark, tmp_path, frame(spark, rows), frame(spark, [(i, x + (i == 33), n) for i, x, n in rows]), chunk={"size": 16}, source={"chunkSql": sql})
    assert out.status == "ok" and out.transferred == 16 and out.methods == {"merge": 1, "inSync": 6}, (out.error, out.methods)
    with pytest.raises(ValueError, match="chunk"):
        parse_request(json.dumps({"source": {"path": "a", "chunkSql": sql}, "dest": {"path": "b"}})).init().validate()
