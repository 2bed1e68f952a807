"""Checks that ride on the job which writes a table."""

import pytest
from pyspark.sql import functions as F

from channelweave.operators import channels, integrity
from channelweave.operators.integrity import BrokenTable, assert_disjoint, checked_left_join, complete_arm, overlaps

NAMES = {"x": "a"}
WIDE = "id long, a_value_first double, a_value_last double, a_time_first double, a_time_last double, y0 int"


def test_left_join_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "id long, t string")
    dimension = spark.createDataFrame([(1, "u", None), (2, "v", 5), (9, "w", 1), (9, "w", 1), (None, "z", 1)], "id long, race string, more int")
    got = checked_left_join(rows, dimension, "id", ["race"])
    assert got.columns == ["id", "t", "race", "more"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "p", "u", None), (1, "q", "u", None), (2, "r", "v", 5)]


@pytest.mark.parametrize("dimension, found", [
    ([(1, "u")], {"repeated": 0, "race": 1}),
    ([(1, "u"), (2, None)], {"repeated": 0, "race": 1}),
    ([(1, "u"), (2, "v"), (1, "u")], {"repeated": 2, "race": 0}),
    ([], {"repeated": 0, "race": 3}),
])
def test_left_join_told_broken(spark, dimension, found):
    rows = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "id long, t string")
    with pytest.raises(BrokenTable) as e:
        checked_left_join(rows, spark.createDataFrame(dimension, "id long, race string"), "id", ["race"])
    assert e.value.found == found


def test_left_join_of_null_keys_and_no_rows(spark):
    rows, dimension = spark.createDataFrame([(None, "p")], "id long, t string"), spark.createDataFrame([(None, "u")], "id long, race string")
    with pytest.raises(BrokenTable):
        checked_left_join(rows, dimension, "id", ["race"])
    assert [tuple(r) for r in checked_left_join(rows, dimension, "id", []).collect()] == [(None, "p", None)]
    assert checked_left_join(rows.where("id = 4"), dimension, "id", ["race"]).collect() == []


def test_arm_as_complete_case(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 1.0, 2.0, 3.0, 4.0, 1), (2, nan, 2.0, 3.0, 4.0, 1), (3, None, 2.0, 3.0, 4.0, 0), (4, inf, 2.0, 3.0, 4.0, 0), (5, 1.0, 2.0, 3.0, 4.0, None), (1, 1.0, 2.0, 3.0, 4.0, 0), (None, 1.0, 1.0, 1.0, 1.0, 0)]
    wide = spark.createDataFrame(data, WIDE)
    rows, found = complete_arm(wide, "id", NAMES, "y0")
    want = channels.complete_case(wide, "id", NAMES, "y0")
    assert rows.columns == want.rows.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.rows.collect()))
    assert found == {"n_cohort": 7, "n": 4, "n_dropped": 3, "drop_rate": pytest.approx(3 / 7), "prevalence": 0.25, "target_missing": 1}
    _, empty = complete_arm(wide.where("id = 99"), "id", NAMES, "y0")
    assert empty == {"n_cohort": 0, "n": 0, "n_dropped": 0, "drop_rate": None, "prevalence": None, "target_missing": 0}


def test_overlaps_as_sets(spark):
    data = [(k % 17 if k % 5 else None, k % 4, k % 3 if k % 7 else None) for k in range(60)]
    rows = spark.createDataFrame(data, "key long, u int, v int")
    conditions = {"a": ("u = 1", lambda u, v: u == 1), "b": ("v = 2", lambda u, v: v == 2), "c": ("u = 9", lambda u, v: False), "d": ("u = 1 OR u = 1", lambda u, v: u == 1)}
    want = {s: {k for k, u, v in data if k is not None and f(u, v)} for s, (_, f) in conditions.items()}
    got = overlaps(rows, "key", {s: F.expr(c) for s, (c, _) in conditions.items()}).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in want for b in want if a < b}
    for r in got:
        a, b = want[r.a], want[r.b]
        assert (r.n_a, r.n_b, r.n_both, r.disjoint, r.equal) == (len(a), len(b), len(a & b), not a & b, a == b)
    assert overlaps(rows.where("key = 99"), "key", {"a": F.expr("u = 1"), "b": F.expr("v = 1")}).collect() == []
    with pytest.raises(ValueError):
        overlaps(rows, "key", {"a": F.expr("u = 1")})


def test_disjoint(spark):
    rows = spark.createDataFrame([(1, "train"), (2, "test"), (2, "train"), (3, "test")], "key long, split string")
    split = {s: F.col("split") == s for s in ("train", "test", "dev")}
    with pytest.raises(BrokenTable) as e:
        assert_disjoint(rows, "key", split)
    assert e.value.found == {"train, test": 1}
    assert_disjoint(rows.where("key <> 2"), "key", split)


def test_metrics_are_of_all_rows(spark):
    """Also of those that are not written."""
    rows = spark.range(100).withColumnRenamed("id", "key").groupBy("key").agg(F.count("*").alias("n"))
    out, found = integrity.written(rows, "probe", keep=F.col("n") > 5, rows=F.count("*"), kept=F.count_if(F.col("n") > 5))
    assert found == {"rows": 100, "kept": 0} and out.count() == 0
