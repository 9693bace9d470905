import pytest
from pyspark.sql import functions as F

from deltaloom.functions import compare, criteria
from deltaloom.functions.criteria import Between, GreaterOrEqual, GreaterThan, LessOrEqual
from deltaloom.functions.types import DiffColumn, diff_columns


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i, f"n{i}", None if i % 4 == 0 else i) for i in range(1, 13)], "id long, name string, x long")


@pytest.mark.parametrize(
    "filters, want",
    [
        ({"id": 3}, [3]),
        ({"id": "3"}, [3]),
        ({"name": "n4"}, [4]),
        ({"id": [1, "2", 99]}, [1, 2]),
        ({"name": ["n1", "n'2"]}, [1]),
        ({"id": Between(2, 4)}, [2, 3, 4]),
        ({"id": LessOrEqual(2)}, [1, 2]),
        ({"id": GreaterThan(10)}, [11, 12]),
        ({"id": GreaterOrEqual(11)}, [11, 12]),
        ({"id": " <= 8 ", "x": "is null"}, [4, 8]),
        ({"x": "is not null", "id": "> 9"}, [10, 11]),
        ({"x": None, "id": GreaterThan(4)}, [8, 12]),
        ({"name": "<> 'n1'", "id": "< 3"}, [2]),
    ],
)
def test_criteria(numbers, filters, want):
    assert sorted(r.id for r in numbers.filter(criteria.conjunction(filters)).collect()) == want


def test_raw_fragments_are_checked():
    for bad in ("> 1; drop table x", "is null or 1 > 0", "> (select 1)"):
        with pytest.raises(ValueError):
            criteria.criterion("id", bad)


def test_pseudo_columns_and_none(numbers):
    p = criteria.conjunction({"half": 3}, pseudo={"half": "id div 2"})
    assert sorted(r.id for r in numbers.filter(p).collect()) == [6, 7]
    assert criteria.conjunction({}, None) is None


def test_batches():
    assert criteria.batches([{"k": i} for i in range(1, 6)], 2) == [{"k": [1, 2]}, {"k": [3, 4]}, {"k": [5]}]
    assert criteria.batches([{"k": 1, "d": "a"}, {"k": 1, "d": "b"}]) == [{"k": [1], "d": ["a", "b"]}]
    assert criteria.batches_by([("insert", {"k": 1}), ("merge", {"k": 2}), ("insert", {"k": 3})]) == {
        "insert": [{"k": [1, 3]}],
        "merge": [{"k": [2]}],
    }


def test_columns_by_type(spark):
    df = spark.createDataFrame(
        [],
        "b boolean, t tinyint, s smallint, i int, l long, f float, d double, n decimal(7,2), ts timestamp, tn timestamp_ntz, "
        "dt date, str string, bin binary, a array<int>, m map<string,int>",
    )
    got = {c.name: (c.func, c.label) for c in diff_columns(df)}
    assert {n for n, (f, _) in got.items() if f == "SUM"} == {"s", "i", "l", "f", "d", "n"}
    assert {n for n, (f, _) in got.items() if f == "MAX"} == {"ts", "tn", "dt"}
    assert got["str"] == ("COUNT", "cnt_str") and got["a"][0] == "COUNT" and got["ts"][1] == "max_ts"


def test_similarity(spark):
    df = spark.createDataFrame([(1.000001, 1.000002), (1.0, None), (None, None), (2.5, 2.6)], "a double, b double")
    got = [r[0] for r in df.select(compare.similar(F.col("a"), F.col("b"), 5)).collect()]
    assert got == [True, False, True, False]
    ts = spark.sql("select timestamp'2020-01-01 10:00:00' a, timestamp'2020-01-01 11:00:00' b")
    assert ts.select(compare.similar(F.col("a"), F.col("b"), None, "yyyy-MM-dd")).first()[0]
    assert not ts.select(compare.similar(F.col("a"), F.col("b"), None, "yyyy-MM-dd HH")).first()[0]


def test_fractions_round_as_databases_round_them(spark):
    """Scaled doubles, not the doubles' texts, are rounded: 3.34 + 0.01 is 3.3499999999999996, whose tenfold is 33.5."""
    import duckdb

    pairs = [(k / 100, k / 100 + 0.01) for k in range(-2000, 2000)]
    pairs += [(0.25, 0.349), (1e305, 2e305), (1e17, 1e17 + 64), (float("inf"), 1.0), (float("nan"), 1.0), (-0.04, 0.04)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a double, b double")
    got = {r.i: r.same for r in df.select("i", compare.similar(F.col("a"), F.col("b"), 1).alias("same")).collect()}
    con = duckdb.connect()
    want = {i: con.execute("select round(?::double, 1) = round(?::double, 1)", [a, b]).fetchone()[0] for i, (a, b) in enumerate(pairs)}
    assert got == want and not got[pairs.index((3.34, 3.34 + 0.01))]
    exact = spark.sql("select 3.34bd a, 3.3499999999999996bd b").select(compare.similar(F.col("a"), F.col("b"), 1))
    assert exact.first()[0]  # decimals are exact


def test_alignment_is_lenient(spark):
    df = spark.createDataFrame([("7", "x", 1)], "N string, m string, extra int")
    like = spark.createDataFrame([], "n int, m long")
    assert compare.align(df, like.schema).first().asDict() == {"n": 7, "m": None}


def test_other_functions_pass_through(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert df.agg(DiffColumn("AVG", "x").column()).first()[0] == 2.0
    assert df.agg(DiffColumn("MIN", "x").column()).first()[0] == 1.0


def test_items_in_parentheses_are_lists_of_literals(spark):
    import pytest

    from deltaloom.functions.criteria import criterion

    df = spark.createDataFrame([(k, f"it's {k}") for k in range(6)], "id long, name string")
    ids = lambda where: sorted(r.id for r in df.filter(where).collect())
    assert ids(criterion("id", ["(1, 2)", 4, "5"])) == [1, 2, 4, 5]
    assert ids(criterion("name", ["('it''s 1', 'it''s 3')", "it's 0"])) == [0, 1, 3]
    for bad in ("(select 1)", "(1 2)", "(1); drop table x --)"):
        with pytest.raises(ValueError):
            criterion("id", [bad])
