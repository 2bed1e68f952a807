"""Cohorts, windows, pairs, roles, targets and channels on hand-made rows: ties, nulls,
bounds, and the two orders of ranking and filtering."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from channelweave.operators import channels, cohort, resolve, targets
from channelweave.operators.windowed import first_last, labs_window, offset_window, window_join
from channelweave.plans import catalogue

T0 = datetime(2020, 1, 10, 12)


@pytest.fixture(scope="module")
def clinic(spark):
    stay = lambda s, h, i, t: (s, h, i, t, t + timedelta(days=2), 2.0)
    icu = spark.createDataFrame(
        [stay(1, 11, 102, T0), stay(1, 12, 101, T0), stay(2, 21, 201, T0), stay(3, 31, 301, T0), stay(3, 32, 302, T0 + timedelta(days=9)), stay(4, 41, 401, T0)],
        "subject_id long, hadm_id long, stay_id long, intime timestamp, outtime timestamp, los double",
    )
    patients = spark.createDataFrame([(1, 18, "F"), (2, 17, "M"), (3, 70, None), (4, 40, "M")], "subject_id long, anchor_age int, gender string").withColumn("dod", F.lit(None).cast("date"))
    admissions = spark.createDataFrame([(11, 0, "E", "A"), (12, 1, "E", "B"), (21, 0, "E", "A"), (32, 0, "E", "Z"), (41, 1, "U", None)], "hadm_id long, hospital_expire_flag int, admission_type string, race string")
    return cohort.single_site_cohort(icu, patients, admissions)


def test_single_site(clinic):
    got = {r.subject_id: r for r in clinic.collect()}
    # 1: tie by stay; 2: too young; 3: the first stay has no admission, so the patient goes
    assert set(got) == {1, 4} and got[1].stay_id == 101
    assert got[1].t_win_end - got[1].t_win_start == timedelta(hours=48)


def test_multi_site(spark):
    rows = [
        (1, 1, "p1", 5, "> 89", "Female", "x", "Expired", 2014, 1), (2, 1, "p1", 5, "50", "Female", "x", "Alive", 2014, 2),
        (3, 2, "p2", 5, "17", "Male", "x", "Alive", 2014, 1), (4, 2, "p2", 5, "18", "Male", "x", "Alive", 2015, 1),
        (5, 3, "p3", 6, "", "Male", "x", "Alive", 2014, 1), (6, 3, "p3", 6, "abc", "Male", "x", "Alive", 2014, 2), (7, 3, "p3", 6, None, "Male", "x", "Alive", 2014, 3),
        (8, 4, "p4", 6, "44", "Other", "", "", 2014, 1), (9, 4, "p4", 6, "44", "Other", "", "Alive", 2014, 2), (10, 5, "p5", 6, "30", "Male", "x", "Alive", 2014, 1), (11, 5, "p5", 6, "31", "Male", "x", "Alive", None, 9),
    ]
    schema = "patientunitstayid long, patienthealthsystemstayid long, uniquepid string, hospitalid int, age string, gender string, ethnicity string, hospitaldischargestatus string, hospitaldischargeyear int, unitvisitnumber int"
    got = {r.uniquepid: r for r in cohort.multi_site_cohort(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v.patientunitstayid for k, v in got.items()} == {"p1": 1, "p2": 4, "p4": 9, "p5": 11}
    assert got["p1"].age == 90.0 and got["p1"].hospital_expire_flag == 1


def test_labs_window(spark, clinic):
    at = lambda h, us=0: T0 + timedelta(hours=h, microseconds=us)
    rows = [(1, None, 1, at(-24)), (1, 12, 2, at(24)), (1, 99, 3, at(0)), (1, 12, 4, at(0, 900_000)), (1, 12, 5, at(23.999)), (1, None, 6, at(-24.001)), (7, None, 7, at(0))]
    labs = spark.createDataFrame(rows, "subject_id long, hadm_id long, specimen_id long, charttime timestamp")
    labs = labs.withColumns({"itemid": F.lit(5), "valuenum": F.lit(1.0), "ref_range_lower": F.lit(0.0), "ref_range_upper": F.lit(1.0), "flag": F.lit(""), "priority": F.lit(""), "order_provider_id": F.lit("")})
    got = {r.specimen_id: r.hours_from_t0 for r in labs_window(labs, clinic).collect()}
    assert set(got) == {1, 4, 5} and got[1] == -24.0 and got[4] == 0.0


def test_window_of_expressions(spark):
    """Bounds worked out at the join are those of columns: the start is in, the end is not."""
    at = lambda h, us=0: T0 + timedelta(hours=h, microseconds=us)
    rows = [(1, 1, at(-24)), (1, 2, at(-24, -1)), (1, 3, at(24)), (1, 4, at(24, -1)), (2, 5, at(0)), (3, 6, at(0)), (None, 7, at(0)), (1, 8, None)]
    events = spark.createDataFrame(rows, "id long, n long, t timestamp")
    people = spark.createDataFrame([(1, T0), (2, None)], "id long, t0 timestamp")
    bounds = F.expr("c.t0 - INTERVAL 24 HOURS"), F.expr("c.t0 + INTERVAL 24 HOURS")
    for closed, want in ((False, {1, 4}), (True, {1, 3, 4})):
        got = window_join(events, people, "id", "t", *bounds, closed=closed)
        named = window_join(events, cohort.anchored(people, "t0"), "id", "t", closed=closed)
        assert got.columns == ["id", "n", "t", "t0"]
        assert {r.n for r in got.collect()} == {r.n for r in named.collect()} == want


def test_offset_window(spark):
    events = spark.createDataFrame([(1, -1440), (1, 1440), (1, 1441), (2, 0), (1, None)], "id long, offset int")
    got = offset_window(events, spark.createDataFrame([(1,)], "id long"), "id", "offset").collect()
    assert sorted(r.hours_from_t0 for r in got) == [-24.0, 24.0]


def test_first_last(spark):
    rows = [("a", 1.0, 5.0, 1), ("b", 9.0, 1.0, 2), ("b", 1.0, 1.0, 1), ("c", None, 0.0, 1), ("c", 7.0, 1.0, 2), ("c", 99.0, 2.0, 3), ("c", 3.0, 3.0, 4), ("d", float("nan"), 0.0, 1)]
    got = {r.k: tuple(r)[1:] for r in first_last(spark.createDataFrame(rows, "k string, v double, t double, i long"), ["k"], "v", "t", "i").collect()}
    assert got == {"a": (1.0, 5.0, 1.0, 5.0), "b": (1.0, 1.0, 9.0, 1.0), "c": (7.0, 1.0, 3.0, 3.0)}


def test_resolve(spark):
    scan = spark.createDataFrame(
        [(1, " Glucose", "Blood", 0.99, 95, 0.95), (2, "glucose ", None, 0.99, 95, 0.99), (3, "Ratio", "Blood", 0.5, 50, 1.0), (4, "Comment", "Urine", 0.01, 1, 0.0), (5, "Low", "Blood", 0.96, 96, 0.1)],
        "itemid int, label string, fluid string, completeness double, n_subj long, frac double",
    )
    got = resolve.roles(scan, F.col("label") == "Comment", F.col("label").isin("Ratio", "Comment"), F.col("fluid"), ranged=F.col("frac"))
    assert {r.itemid: (r.excluded, r.role) for r in got.collect()} == {1: (None, "core"), 2: ("non_blood", None), 3: ("derived", None), 4: ("non_analyte", None), 5: (None, "discretionary")}
    twice = resolve.duplicate_labels(scan, "itemid", "label")
    assert [tuple(r) for r in twice.collect()] == [("glucose", [1, 2])]
    config = resolve.resolved_config(got, "itemid", "label", "test", twice)
    assert [c["itemid"] for c in config["core"]] == [1] and config["n_cohort_with_window_labs"] == 96 and not config["enough_core"]
    assert config["excluded"] == {"derived": ["Ratio"], "non_blood": ["glucose "]}


def test_targets(spark):
    rows = spark.createDataFrame([(1, "F", 65, "A1"), (2, None, 64, "B1"), (3, "M", None, "C9"), (4, "F", 80, None)], "id long, gender string, anchor_age int, race string")
    buckets = spark.createDataFrame([("A1", "a"), ("B1", "b"), ("C9", "c")], "raw string, bucket string")
    got, left = targets.demographic_targets(rows, "id", buckets, ("a", "b"))
    assert {r.id: tuple(r)[1:] for r in got.collect()} == {1: (1, 1, 0), 2: (0, 0, 1), 3: (0, 0, None), 4: (1, 1, None)}
    assert {tuple(r) for r in left.collect()} == {(None, 1), ("C9", 1)}


NAMES = {"x": "x", "y": "y"}


def wide(spark):
    nan, inf = float("nan"), float("inf")
    paired = spark.createDataFrame([(1, "x", 1.0, 2.0, 3.0, 4.0), (1, "y", inf, 6.0, 7.0, 8.0), (2, "x", 9.0, 1.0, 1.0, 1.0), (3, "x", nan, 1.0, 5.0, 1.0), (3, "y", 1.0, 1.0, 1.0, 1.0)], "id long, kind string, value_first double, time_first double, value_last double, time_last double")
    people = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None)], "id long, y int")
    return channels.build_wide(paired, people, "id", "kind", {**NAMES, "z": "z"})


def test_wide_and_arms(spark):
    w = wide(spark)
    rows = {r.id: r for r in w.collect()}
    assert set(rows) == {1, 2, 3, 4} and all(rows[i].z_value_first is None for i in rows) and rows[1].y_time_last == 8.0
    arm = channels.complete_case(w, "id", NAMES, "y")
    assert [r.id for r in arm.rows.collect()] == [1]
    meta = channels.arm_meta(arm, w).first()
    assert (meta.n, meta.n_dropped, meta.prevalence) == (1, 3, 0.0)
    filled = {r.id: r for r in channels.impute(w, "id", {"x": "x", "z": "z"}, "y").rows.collect()}
    assert set(filled) == {1, 2, 3} and filled[3].x_value_first == 5.0 and filled[2].z_time_first == -999.0 and filled[1].z_value_first == 0.0
    with pytest.raises(ValueError, match="unknown method"):
        channels.impute(w, "id", NAMES, "y", "median")
    with pytest.raises(ValueError, match="not value columns"):
        channels.audit(["a_time_first"], [])


def test_retarget(spark):
    arm = channels.impute(wide(spark), "id", NAMES, "y")
    same = channels.retarget(arm, arm.rows.select("id", "y"), "y")
    assert sorted(map(str, same.rows.select(*arm.rows.columns).collect())) == sorted(map(str, arm.rows.collect()))
    other = channels.retarget(arm, spark.createDataFrame([(1, 1), (2, None), (3, 0)], "id long, o int"), "o")
    assert {r.id: r.y for r in other.rows.collect()} == {1: 1, 3: 0} and other.meta["base_arm"] == "impute_mean"
    with pytest.raises(ValueError, match="unique"):
        channels.retarget(arm, spark.createDataFrame([(1, 1), (1, 0)], "id long, o int"), "o")


def test_windows_are_dealt_by_customer_after_they_are_cut(spark, sf_dir):
    """Items meet their window at the order: no join by customer reads all of them."""
    plan = catalogue.t_paired(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression [custkey") :]
    first, *others = [line for line in dealt.splitlines() if "Join" in line]
    assert "l_shipdate" in first and "l_orderkey" in first
    assert not any("l_shipdate" in line for line in others)


def test_orders_carry_an_anchor_and_no_window(spark, sf_dir):
    """What is dealt by order is the order, its customer and the anchor: the window's bounds
    are worked out at the join."""
    for query in (catalogue.t_paired, catalogue.null_tolerant_id_match):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        met = next(line for line in plan.splitlines() if "Join" in line and "l_shipdate" in line)
        assert met.count("365") == 2 and plan.count("365") == 2 and "t_win" not in plan


@pytest.mark.parametrize("name", ["impute_mean_value", "impute_sentinel_time", "impute_chained", "zscore_sentinel", "completeness_scan"])
def test_joins_run_once_where_rows_are_read_again(spark, sf_dir, name):
    """What is read for statistics and for the result is written first."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
