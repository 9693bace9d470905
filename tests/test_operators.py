import pytest
from pyspark.sql import functions as F

from deltaloom.functions.types import DiffColumn
from deltaloom.operators import chunking, diff, merge, narrow, projection, signature

SCHEMA = "id long, event_type int, quantity double"


def table(spark, ids, types=None, schema=SCHEMA):
    return spark.createDataFrame([(i, (types or {}).get(i, i % 3), i * 1.5) for i in ids], schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_signature_values(spark):
    df = table(spark, range(1, 12))
    s = signature.signature(df, signature.plan_columns(df, ["id"])).first().asDict()
    assert (s["cnt"], s["sum_id"], s["unique_cnt_id"], s["min_id"], s["max_id"], s["non_null_cnt_id"]) == (11, 66, 11, 1, 11, 11)
    by = signature.signature(df, signature.plan_columns(df, ["id"], ["event_type"]), ["event_type"])
    assert {r.event_type: r.cnt for r in by.collect()} == {0: 3, 1: 4, 2: 4}
    assert "sum_event_type" not in by.columns


def test_signature_modes(spark):
    df = table(spark, range(5))
    assert [c.label for c in signature.plan_columns(df, ["id"], count_only=True)] == [
        "cnt", "unique_cnt_id", "non_null_cnt_id", "max_id", "min_id",
    ]
    own = [DiffColumn("MAX", "quantity"), DiffColumn("SUM", "event_type")]
    assert [c.label for c in signature.plan_columns(df, ["id"], ["event_type"], own)][-1] == "max_quantity"
    assert [c.label for c in signature.plan_columns(df, [], [], [DiffColumn("COUNT", "1", alias="cnt")])] == ["cnt"]
    folded = signature.fold(signature.count_signature(df, ["id"], ["event_type"])).first()
    assert tuple(folded) == (5, 0, 4)


def test_swapped_values_are_seen_by_hashes_only(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id long, x int")
    b = spark.createDataFrame([(1, 20), (2, 10)], "id long, x int")
    cols = signature.plan_columns(a, ["id"])
    assert signature.signature(a, cols).first() == signature.signature(b, cols).first()
    assert signature.row_hash_signature(a).first() != signature.row_hash_signature(b).first()


def test_id_consistency(spark):
    get = lambda ids: signature.id_consistency(spark.createDataFrame([(i,) for i in ids], "id long"), "id").first()["problem"]
    assert get([1, 2, 0]) is None and get([1, 1]) == "duplicate" and get([1, None]) == "null"


@pytest.mark.parametrize(
    "src, dst, ids, want, at",
    [
        (range(1, 12), range(1, 12), ["id"], "inSync", 11),
        (range(1, 12), [], ["id"], "insert", None),
        (range(1, 12), range(1, 6), ["id"], "insert", 5),
        (range(1, 12), [1, 2, 3, 5], ["id"], "merge", None),
        (range(2, 12), range(1, 6), ["id"], "deleteMerge", None),
        (range(1, 12), range(1, 14), ["id"], "deleteMerge", None),
        (range(0, 3), range(0, 2), ["id"], "insert", 1),
        (range(-3, 3), range(-3, 1), ["id"], "insert", 0),
        (range(1, 12), range(1, 6), [], "deleteInsert", None),
        ([], range(3), ["id"], "removed", None),
        ([], [], ["id"], "inSync", None),
    ],
)
def test_decisions(spark, src, dst, ids, want, at):
    r = diff.diff(table(spark, src), table(spark, dst), ids).first()
    assert (r.method, r.in_sync_id) == (want, at)


def test_partition_plan_with_null_values(spark):
    a = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, p string")
    b = spark.createDataFrame([(1, None), (4, "y")], "id long, p string")
    got = {r.p: r.method for r in diff.diff(a, b, ["id"], ["p"]).collect()}
    assert got == {None: "insert", "x": "insert", "y": "removed"}


def test_id_range():
    probe = narrow.IdRange(1, 9999)
    assert [probe.next(x) for x in (False, True, True, True)] == [5000, 7499, 8748, 9372]
    probe = narrow.IdRange(1, 9999)
    assert [probe.next(x) for x in (False, True, True, False)] == [5000, 7499, 8748, 8124]
    assert narrow.IdRange(1, 9999).next(True) == 14998


def test_max_in_sync(spark):
    src = table(spark, range(1, 10000))
    dst = src.withColumn("quantity", F.when(F.col("id") == 9995, 0.0).otherwise(F.col("quantity")))
    cols = signature.plan_columns(src, ["id"])
    assert narrow.max_in_sync(src, dst, "id", cols, 1, 9999, 5) == 9684
    got = {r.c: (r.src_cnt, r.dst_cnt) for r in narrow.probe_all(src, dst, "id", [0, 50]).collect()}
    assert got == {0: (0, 0), 50: (50, 50)}


def test_new_ids(spark):
    src, dst = table(spark, range(1, 13)), table(spark, [1, 2, 3, 7])
    assert [r[0] for r in rows(narrow.new_ids(src, dst, "id"))] == [8, 9, 10, 11, 12]
    assert [r[0] for r in rows(narrow.new_ids(src, dst, "id", ["event_type"]))] == [5, 6, 8, 9, 10, 11, 12]
    assert narrow.new_ids(src, dst.limit(0), "id").count() == 12


def test_chunk_walk(spark):
    plan = list(chunking.walk(table(spark, range(2, 13)), table(spark, range(1, 12)), "id", 5))
    assert [(c.low, c.high, c.src_cnt, c.dst_cnt) for c in plan][0][:1] == (1,)
    assert sum(c.src_cnt for c in plan) == 11 and sum(c.dst_cnt for c in plan) == 11
    assert all(a.high + 1 == b.low for a, b in zip(plan, plan[1:], strict=False))
    assert list(chunking.walk(table(spark, []), table(spark, []), "id", 5)) == []


@pytest.mark.parametrize("ids", [list(range(0, 23)), [1, 5, 1000, 1001, 1002, 1003, 10**9, 10**9 + 7], [-5, -4, 0, 3, 90]])
def test_chunk_boundaries_and_assignment(spark, ids):
    src = table(spark, ids)
    bounds = chunking.boundaries(src, "id", 4)
    got = sorted(map(tuple, chunking.with_ranges(bounds).collect()))
    want = [(k, ids[4 * k], ids[4 * k + 4] if 4 * k + 4 < len(ids) else None, len(ids[4 * k : 4 * k + 4])) for k in range(-(-len(ids) // 4))]
    assert got == want
    others = sorted({i + d for i in ids for d in (-2, 0, 1, 3)})
    placed = {r.id: r.chunk for r in chunking.assign(table(spark, others), bounds, "id").collect()}
    assert placed == {i: max([k for k, lo, *_ in want if lo <= i], default=0) for i in others}


def test_dedupe_takes_each_maximum(spark):
    t = spark.createDataFrame([(1, 5, 1.0), (1, 2, 9.0), (2, 1, 1.0)], SCHEMA)
    assert rows(merge.dedupe_max(t, ["id"])) == [(1, 5, 9.0), (2, 1, 1.0)]
    assert rows(merge.dedupe_latest(t, ["id"], "quantity")) == [(1, 2, 9.0), (2, 1, 1.0)]
    assert merge.dedupe_max(t, []).count() == 3


def test_apply(spark):
    d = table(spark, [1, 2, 3, 9], {2: 7})
    t = table(spark, [2, 3, 4])
    ids = lambda df: [r[0] for r in rows(df)]
    old, new = dict((r[0], r) for r in rows(d)), dict((r[0], r) for r in rows(t))
    assert rows(merge.apply(d, t, "insert", ["id"])) == sorted([*old.values(), new[4]])
    assert rows(merge.apply(d, t, "merge", ["id"])) == sorted([old[1], old[9], *new.values()])
    where = F.col("id") >= 3
    assert ids(merge.apply(d, t, "deleteMerge", ["id"], where)) == [1, 2, 3, 4]
    assert rows(merge.apply(d, t, "deleteInsert", ["id"], where))[1] == old[2]
    assert ids(merge.apply(d, t, "deleteInsert", [])) == [2, 3, 4]
    assert ids(merge.apply(d, t, "deleteInsert", [], where)) == [1, 2, 2, 3, 4]
    assert rows(merge.apply(d, t, "merge", ["id"], append_only=True)) == sorted([*old.values(), new[4]])
    assert ids(merge.apply(d, t, "deleteMerge", ["id"], append_update_only=True)) == [1, 2, 3, 4, 9]
    for style in ("insertOrReplace", "insertOnDuplicateUpdate", "insertOnConflictUpdate", "merge", "mergeInto"):
        assert rows(merge.dml(style, d, t, ["id"])) == rows(merge.upsert(d, t, ["id"]))
    assert ids(merge.dml("transientDelete", d, t, ["id"])) == [4]
    assert ids(merge.dml("filteredDelete", d, None, where=where)) == [1, 2]
    assert ids(merge.dml("append", d, t, ["id"])) == [1, 2, 2, 3, 3, 4, 9]


def test_apply_errors(spark):
    d = table(spark, [1])
    for bad in (lambda: merge.apply(d, d, "nothing"), lambda: merge.dml("merge", d, None), lambda: merge.dml("x", d, d), lambda: merge.filtered_delete(d, None)):
        with pytest.raises(ValueError):
            bad()


def test_upsert_keeps_other_columns(spark):
    d, t = table(spark, [1, 2]), table(spark, [2, 3]).select("id", (F.col("quantity") * 10).alias("quantity"))
    assert rows(merge.upsert_columns(d, t, ["id"]).na.fill(-1)) == [(1, 1, 1.5), (2, 2, 30.0), (3, -1, 45.0)]


def test_projection(spark):
    df = spark.createDataFrame([("a", 0, "", 2.0)], "Name string, n int, s string, `window` double")
    assert projection.sync_projection(df, ["n"], ["NAME", "window"], {"name": "upper(t.Name)"}).first().asDict() == {
        "n": 0, "Name": "A", "window": 2.0,
    }
    assert projection.omit_empty(df, keep=["n"]).first().asDict() == {"Name": "a", "n": 0, "s": None, "window": 2.0}
    assert projection.adapt_case(df, ["A", "B"]).columns == ["NAME", "N", "S", "WINDOW"]
    assert projection.with_pseudo(df, {"d": "t.n + 1"}).first()["d"] == 1
    assert projection.staging_name("my table", {"p": -3, "q": ["x", "y"]}, "ns1", "tmp") == "tmp.my_table_ns1_tmp_3_x"


def test_plan_roll_up(spark):
    plan = spark.createDataFrame([("inSync", 4, 4), ("insert", 3, 1), ("removed", None, 2)], "method string, src_cnt long, dst_cnt long")
    assert tuple(diff.roll_up(plan).first()) == (7, 7, 3, 42)
    assert {r.method: r.slices for r in diff.method_histogram(plan).collect()} == {"inSync": 1, "insert": 1, "removed": 1}


def test_chunk_template(spark):
    table(spark, range(1, 20)).createOrReplaceTempView("chunk_src")
    text = "select $hint count(*) n, min(id) lo, max(id) hi from (select id from chunk_src where id >= $max $where order by id limit $limit)"
    assert tuple(chunking.window_sql(spark, text, 5, 4, "id % 2 = 0").first()) == (4, 6, 12)


def test_dense_counts_and_layouts():
    from deltaloom.functions.compare import layout_for

    assert narrow.dense_remaining(9999, 9999, 9999, 9684) == (315, 315)
    assert layout_for("yyyy-MM-dd HH:mm:ss", "2020-01-02") == "yyyy-MM-dd"


def test_skewed_ids_and_many_chunks(spark, monkeypatch):
    """Dense ids and one far away: every row finds its chunk without meeting the others of its range."""
    src = table(spark, [*range(20_000), 10**12])
    bounds = chunking.boundaries(src, "id", 100)
    want = {i: i // 100 for i in range(20_000)} | {10**12: 200}
    for most in (100_000, 7):
        monkeypatch.setattr(chunking, "MOST", most)
        placed = chunking.assign(src, bounds, "id")
        assert {r.id: r.chunk for r in placed.collect()} == want
        if most > 7:
            assert "Join" not in placed._jdf.queryExecution().executedPlan().toString()
    below = chunking.assign(table(spark, [-5, 10**13]), bounds, "id")
    assert {r.id: r.chunk for r in below.collect()} == {-5: 0, 10**13: 200}


def test_bisection_of_all_slices_at_once(spark):
    src = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(1, 2001)], "id long, p string, x double")
    dst = src.withColumn("x", F.when(F.col("id").isin(1501, 402), 0.0).otherwise(F.col("x")))
    cols = signature.plan_columns(src, ["id"], ["p"], exact=False)
    spans = spark.createDataFrame([("a", 2, 2000), ("b", 1, 1999)], "p string, low long, high long")
    got = {r.p: r.at for r in narrow.bisect(src, dst, "id", cols, spans, ["p"], 8).collect()}

    def expected(bad, low, high):
        probe, found, matched = narrow.IdRange(low, high), None, False
        for _ in range(8):
            c = probe.next(matched)
            matched = bad > c
            found = c if matched else found
        return found

    assert got == {"a": expected(402, 2, 2000), "b": expected(1501, 1, 1999)}


def test_default_signatures_shuffle_only_sums(spark):
    df = spark.createDataFrame([(1, "a", True, "x")], "id long, s string, b boolean, p string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    fast = signature.signature(df, signature.plan_columns(df, ["id"], ["p"], exact=False), ["p"])
    assert "Expand" not in plan(fast) and "distinct" not in plan(fast)
    assert "Expand" in plan(signature.signature(df, signature.plan_columns(df, ["id"], ["p"]), ["p"]))
    swapped = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string"), spark.createDataFrame([(1, "b"), (2, "a")], "id long, s string")
    assert diff.diff(swapped[0], swapped[0], ["id"]).first()["method"] == "inSync"


def test_merge_with_a_filter(spark):
    d, t = table(spark, [1, 2], {1: 7, 2: 7}), table(spark, [2, 3])
    where = F.col("event_type") < 5
    assert [r[0] for r in rows(merge.dml("merge", d, t, ["id"], where))] == [1, 2, 2, 3]  # 2 is outside the filter
    assert [r[0] for r in rows(merge.dml("mergeInto", d, t, ["id"], where))] == [1, 2, 3]
    assert [r[0] for r in rows(merge.dml("insertOrReplace", d, t, ["id"], F.col("id") > 2))] == [1, 2, 3]


def test_values_that_do_not_fit(spark):
    d = spark.createDataFrame([(1, 1)], "id long, v int")
    for bad in (2**40, 1.5, "x"):
        t = spark.createDataFrame([(2, bad)], f"id long, v {'long' if bad == 2**40 else 'double' if bad == 1.5 else 'string'}")
        with pytest.raises(Exception, match="does not fit int"):
            merge.upsert(d, t, ["id"]).collect()
    fine = spark.createDataFrame([(2, "7"), (3, None)], "id long, v string")
    assert rows(merge.upsert(d, fine, ["id"]).na.fill(-1)) == [(1, 1), (2, 7), (3, -1)]


def test_upsert_keeps_columns_the_slice_lacks(spark):
    d = spark.createDataFrame([(1, 5, "note"), (2, 6, "kept")], "id long, v int, extra string")
    t = spark.createDataFrame([(2, 9), (3, 9)], "id long, v int")
    assert rows(merge.upsert(d, t, ["id"]).na.fill("-")) == [(1, 5, "note"), (2, 9, "kept"), (3, 9, "-")]


def test_single_row_guard(spark):
    df = table(spark, range(4))
    assert signature.single(df.limit(0)) is None and signature.single(df.filter("id = 2"))["id"] == 2
    with pytest.raises(ValueError):
        signature.single(df)


def test_record_folds(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 2)], "k string, x int, y int")
    r = signature.fold_records(df, {"x": "sum", "y": "max", "z": "min"}, ["k"]).first()
    assert r.asDict() == {"k": "a", "sum_x": 4, "max_y": 5}
