"""Kernels on closed forms, measures by brute force, and invariants of the nulls."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from channelweave.functions import sums
from channelweave.functions.decompose import atoms, broja, ccs, nodes
from channelweave.functions.gaussian import Moments, information
from channelweave.functions.special import digamma, f_survival, incomplete_beta, inverse_normal, t_two_sided
from channelweave.operators import information as info
from channelweave.operators import quantize
from channelweave.plans import pid, resample, studies

BIT = math.log(2)


def table_of(f):
    t = np.zeros((2, 2, 2))
    for v in range(2):
        for s in range(2):
            t[v, s, f(v, s)] += 1
    return t


def bits(found):
    return [round(found[a] / BIT, 4) + 0.0 for a in ("red", "u_val", "u_str", "syn")]


def test_closed_forms():
    copy = np.zeros((2, 2, 2))
    copy[0, 0, 0] = copy[1, 1, 1] = 1
    for f in (broja, ccs):
        assert bits(f(table_of(lambda v, s: v ^ s))) == [0, 0, 0, 1]
        assert bits(f(copy)) == [1, 0, 0, 0]
        assert bits(f(table_of(lambda v, s: v))) == [0, 1, 0, 0]
        assert bits(f(np.ones((3, 2, 2)))) == [0, 0, 0, 0]
    assert bits(broja(table_of(lambda v, s: v & s))) == [0.3113, 0, 0, 0.5]
    assert abs(bits(ccs(table_of(lambda v, s: v & s)))[0] - 0.1038) < 2e-4
    with pytest.raises(ValueError, match="unknown measure"):
        atoms(copy, "other")
    assert not atoms(np.ones((1, 2, 2)), "broja")["converged"]


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 6), st.integers(2, 6), st.integers(0, 10_000))
def test_broja_is_certified(nv, ns, seed):
    rng = np.random.default_rng(seed)
    table = rng.multinomial(800, rng.dirichlet(np.full(nv * ns * 2, 0.3))).reshape(nv, ns, 2).astype(float)
    if min((table.sum((1, 2)) > 0).sum(), (table.sum((0, 2)) > 0).sum(), (table.sum((0, 1)) > 0).sum()) < 2:
        return
    found = broja(table)
    assert found["converged"] and found["gap"] <= 1e-9
    assert abs(sum(found[a] for a in ("red", "u_val", "u_str", "syn")) - nodes(table / table.sum())[2]) < 1e-8


def test_special_functions():
    assert abs(digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12
    assert np.allclose(digamma(np.array([0.5, 10.0])), [-1.9635100260214235, 2.2517525890667211])
    assert abs(inverse_normal(np.array([0.975]))[0] - 1.959963984540054) < 1e-9
    assert abs(incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-12
    assert abs(t_two_sided(2.228138851964939, 10) - 0.05) < 1e-9 and abs(f_survival(4.964602743730711, 1, 10) - 0.05) < 1e-8
    assert t_two_sided(math.inf, 5) == 0 and math.isnan(f_survival(1.0, 0, 5))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    v, s = rng.integers(0, 3, 3000), rng.integers(0, 4, 3000)
    y = (rng.random(3000) < 0.2 + 0.2 * (v == 1) + 0.2 * ((v + s) % 2)).astype(int)
    data = [(int(i % 2), i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(v, s, y, strict=True))]
    return spark.createDataFrame([*data, (0, -1, None, 1, 1), (0, -2, 1, None, 0), (0, -3, 1, 1, None)], "k int, key long, v int, s int, y int").persist()


def test_measures(rows):
    counts = info.joint_counts(rows, ["k"])
    tables = {k: np.zeros((3, 4, 2)) for k in (0, 1)}
    for r in counts.collect():
        tables[r.k][r.v, r.s, r.y] = r.n
    assert sum(t.sum() for t in tables.values()) == 3000
    for r in info.mutual_information(counts, ["k"]).collect():
        assert np.allclose([r.i_val, r.i_str, r.i_joint], nodes(tables[r.k] / tables[r.k].sum()))
    for m in ("broja", "ccs"):
        for r in pid.decompose(counts, ["k"], m).collect():
            assert r.converged and abs(r.red + r.u_val + r.u_str + r.syn - r.i_joint) < 1e-9 and abs(r.red_pct + r.u_val_pct + r.u_str_pct + r.syn_pct - 100) < 1e-6
            assert (r.n_v, r.n_s, r.n_y, r.n_cells, r.min_cell) == (3, 4, 2, 24, tables[r.k].min())
    mm = {r.k: r.i_joint_mm for r in info.mutual_information(counts, ["k"]).collect()}
    assert all(abs(r.i_joint_mm - mm[r.k]) < 1e-9 for r in pid.decompose(counts, ["k"], "ccs").collect())


def test_nulls(rows):
    counts = info.joint_counts(rows, ["k"])
    real = {(r.k, r.v, r.s, r.y): r.n for r in counts.collect()}
    total = lambda t, *at: {k: sum(n for c, n in t.items() if tuple(c[i] for i in at) == k) for k in {tuple(c[i] for i in at) for c in t}}
    for kind, kept in (("permutation", [(0, 1, 2), (0, 3)]), ("conditional", [(0, 1, 2), (0, 1, 3)])):
        drawn = {}
        for r in resample.null_tables(counts, ["k"], kind, 2).collect():
            drawn.setdefault(r.draw, {})[r.k, r.v, r.s, r.y] = r.n
        for t in drawn.values():
            assert t != real and all(total(t, *at) == total(real, *at) for at in kept)
    draws = resample.null_draws(counts, ["k"], draws=30, seed=3)
    again = resample.null_draws(counts.repartition(7), ["k"], draws=30, seed=3)
    key = lambda d: sorted((r.k, r.draw, r.i_joint) for r in d.collect())
    assert key(draws) == key(again) and len(key(draws)) == 60
    gate = resample.joint_gate(counts, ["k"], info.mutual_information(counts, ["k"]), 100).collect()
    assert all(g.gate_pass and g.n_used == 100 and abs(g.p - 1 / 101) < 1e-12 for g in gate)
    with pytest.raises(KeyError):
        resample.null_draws(counts, ["k"], "other")


def test_sequential_gate(spark):
    """The verdicts of a thousand draws, by few of them where there is nothing."""
    rng = np.random.default_rng(5)
    data = [(k, v, s, int(rng.random() < 0.3 + strength * (v + s))) for k, strength in enumerate((0.0, 0.0, 0.004, 0.05, 0.2)) for v in range(3) for s in range(2) for _ in range(150)]
    counts = info.joint_counts(spark.createDataFrame(data, "k int, v int, s int, y int"), ["k"]).persist()
    observed = info.mutual_information(counts, ["k"]).select("k", "i_joint")
    many = {r.k: r for r in resample.joint_gate(counts, ["k"], observed, 1000).collect()}
    few = {r.k: r for r in resample.sequential_gate(counts, ["k"], observed, 1000).collect()}
    draws = {}
    for r in resample.null_draws(counts, ["k"], draws=1000, measure=None).orderBy("draw").collect():
        draws.setdefault(r.k, []).append(r.i_joint)
    for k, r in few.items():
        over = np.cumsum(np.array(draws[k]) >= r.observed)
        if over[-1] >= 20:  # by the plain rule
            at = int(np.argmax(over == 20)) + 1
            assert (r.n_used, r.p) == (at, 20 / at)
        else:
            assert (r.n_used, r.p) == (1000, (over[-1] + 1) / 1001) and r.p == many[k].p
        assert r.gate_pass == many[k].gate_pass
    assert few[0].n_used < 300 and few[4].n_used == 1000
    again = {r.k: r for r in resample.sequential_gate(counts.repartition(7), ["k"], observed.repartition(3), 1000).collect()}
    assert {k: (r.p, r.n_used) for k, r in again.items()} == {k: (r.p, r.n_used) for k, r in few.items()}
    head = studies.with_gate(pid.decompose(counts, ["k"], "ccs"), counts, ["k"]).collect()
    assert {r.k: r.p for r in head} == {k: r.p for k, r in few.items()}
    with pytest.raises(ValueError, match="whole batch"):
        resample.null_draws(counts, ["k"], first=3)


@pytest.mark.parametrize("shape", [(2, 2, 2), (3, 2, 2)])
def test_broja_by_grid(shape):
    """Least joint information over all tables with the same (v, y) and (s, y) margins: for
    two s and two y levels they are a few free cells, which a grid covers."""
    rng = np.random.default_rng(sum(shape))
    for _ in range(3):
        p = rng.dirichlet(np.ones(math.prod(shape))).reshape(shape)
        best = math.inf
        nv = shape[0]
        vy, sy = p.sum(1), p.sum(0)
        grid = np.linspace(0, 1, 41 if nv == 2 else 21)
        cells = [np.array(np.meshgrid(*[grid] * (nv - 1))).reshape(nv - 1, -1) for _ in range(2)]
        per_y = []
        for y in range(2):  # q(v, 0, y) from the free cells; the rest follows
            first = cells[y] * vy[:-1, y][:, None]
            rest = sy[0, y] - first.sum(0)
            ok = (rest >= 0) & (rest <= vy[-1, y])
            q0 = np.vstack([first, rest])[:, ok]
            per_y.append(np.stack([q0, vy[:, y][:, None] - q0], 1))
        for a in np.moveaxis(per_y[0], -1, 0):
            q = np.stack([np.broadcast_to(a[..., None], per_y[1].shape), per_y[1]], 2)
            joint = q.sum(2)
            h = lambda x: -np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0)
            value = h(joint).sum((0, 1)) + h(p.sum((0, 1))).sum() - h(q).sum((0, 1, 2))
            best = min(best, float(value.min()))
        found = broja(p)
        iv, is_, ij = nodes(p)
        assert ij - found["syn"] <= best + 1e-9 and best - (ij - found["syn"]) < 5e-3


def test_degenerate(spark):
    data = [("ok", 0, 0, 0, 3), ("ok", 1, 1, 1, 2), ("one v", 0, 0, 0, 3), ("one v", 0, 1, 1, 3), ("empty", 0, 0, 0, 3), ("empty", 1, 1, 1, 0), (None, 0, 0, 1, 5)]
    counts = spark.createDataFrame(data, "k string, v int, s int, y int, n long")
    got = {r.k: (r.n_v, r.n_s, r.n_y) for r in pid.degenerate(counts, ["k"]).collect()}
    assert got == {"one v": (1, 2, 2), "empty": (1, 1, 1), None: (1, 1, 1)} and pid.degenerate(counts.where("false"), ["k"]).count() == 0


def test_unique_slug(spark):
    from channelweave.functions.columns import unique_slug

    names = spark.createDataFrame([(1, "Glucose"), (2, "glucose "), (3, "Na+ (whole)"), (4, "pH 7")], "id int, name string")
    got = {r.id: r.s for r in names.select("id", unique_slug("name", "id").alias("s")).collect()}
    assert got == {1: "glucose_1", 2: "glucose_2", 3: "na_whole", 4: "ph_7_4"} and len(set(got.values())) == 4


def test_across(spark):
    cells = spark.createDataFrame([("a", "t", 10.0, 20.0, 30.0, 40.0), ("b", "t", 15.0, 20.0, 50.0, 15.0), ("a", "u", None, None, None, None)], "db string, target string, red_pct double, u_val_pct double, u_str_pct double, syn_pct double")
    got = {r.target: r for r in studies.across(cells, "db", ["target"], "a", "b").collect()}
    assert (got["t"].gap_syn, got["t"].gap_u_str, got["t"].most_apart) == (25.0, -20.0, "syn") and got["u"].gap_syn is None and got["u"].most_apart is None


def test_p_value_drops_nan(spark):
    draws = spark.createDataFrame([("a", x) for x in (1.0, 2.0, float("nan"), None, 5.0)], "k string, x double")
    got = resample.p_value(draws, spark.createDataFrame([("a", 2.0)], "k string, o double"), ["k"], "x", "o").first()
    assert (got.n_used, got.n_dropped, got.p) == (3, 2, 0.75)


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(rng.normal() + 4 * (i % 2)), float(rng.normal()), i % 2, None if i % 9 == 0 else int(rng.random() < 0.5)) for i in range(300)]
    df = spark.createDataFrame(data, "key long, a double, b double, y int, other int")
    got = resample.bootstrap(df, "key", ["a"], ["b"], ["y", "other"], k=2, reps=12)
    assert got.count() == 12 * 2 * 2
    ci = {(r.target, r.measure): r for r in resample.interval(got, ["target", "measure"], ["u_val"]).collect()}
    assert ci["y", "broja"].u_val_low > 0.2 > ci["other", "broja"].u_val_high
    tables = lambda x: sorted(map(tuple, resample.bootstrap_tables(x, "key", ["a"], ["b"], ["y", "other"], 2, 5).collect()))
    once = tables(df)
    assert once == tables(df.repartition(7, "b"))
    for rep in range(5):  # each row as often as its key's draw says, and rows without the target nowhere
        h = np.array([r[0] for r in df.orderBy("key").select(F.xxhash64("key")).collect()])
        w = sums.poisson_counts(h, np.array([rep]), 0)[:, 0]
        n = {t: sum(r[-1] for r in once if r[0] == rep and r[1] == t) for t in ("y", "other")}
        assert n == {"y": w.sum(), "other": sum(x for x, row in zip(w, data, strict=True) if row[4] is not None)}
    with pytest.raises(ValueError, match="unique"):
        resample.bootstrap(df.unionByName(df), "key", ["a"], ["b"], ["y"], 2, 2)


def test_draws_beyond_numpys_limit():
    rng = np.random.default_rng(1)
    cells = np.array([3_000_000_000, 5, 2_000_000_000, 0])
    for n in (0, 4_999_999_990, 1_000_000, 2_500_000_000):
        got = resample.drawn_cells(cells, n, rng)
        assert got.sum() == n and (got >= 0).all() and (got <= cells).all()
        assert abs(got[0] - 0.6 * n) < 6 * (0.24 * max(n, 1)) ** 0.5 + 10
    table = np.array([[[2e9, 1e9], [5e8, 5e8]]])
    assert (resample.permuted_table(table, rng).sum(2) == table.sum(2)).all()


def test_quantize(spark):
    df = spark.createDataFrame([(i, float(x), -999.0 if i % 3 == 0 else float(i), 5.0, -999.0) for i, x in enumerate((1, 2, 3, 4, 100, 101))], "id long, a double, t double, c double, none double")
    z = {r.id: r for r in quantize.zscore(df, ["a", "c"]).collect()}
    assert abs(sum(r.a_z**2 for r in z.values()) / 6 - 1) < 1e-9 and z[0].c_z == 0.0
    t = {r.id: r for r in quantize.zscore(df, ["t", "none"], -999.0).collect()}
    assert t[0].t_z == 0.0 and t[0].t_real == 0.0 and t[1].t_real == 1.0 and t[1].none_z == 0.0
    levels, cost = quantize.kmeans_levels(df, ["a"], 2, n_init=2)
    assert {r.id: r.level for r in levels.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1} and abs(cost - 5.5) < 1e-9
    new = lambda counts, share: spark.createDataFrame(list(counts.items()), "u int, n long").agg(quantize.rare_levels("u", "n", share)).first()[0]
    assert new({0: 50, 1: 1, 2: 49}, 0.02) == {0: 0, 1: 0, 2: 1} and new({0: 1, 5: 1, 9: 1}, 0.9) == {0: 0, 5: 1, 9: 1}


def test_collapse_for_occupancy(spark):
    data = [(v, s, y) for v in range(4) for s in range(3) for y in (0, 1) for _ in range(30 if v < 3 else 2)]
    out, found = quantize.collapse_for_occupancy(spark.createDataFrame(data, "v int, s int, y int"), "v", "s", "y")
    assert found["min_cell"] >= 20 and found["levels"] == [3, 3] and out.count() == len(data)


def test_collapse_counts(spark):
    """Many tables at once, each as by itself."""
    rng = np.random.default_rng(4)
    data = [(t, int(min(rng.geometric(0.3) - 1, 7)), int(min(rng.geometric(0.4) - 1, 5)), int(rng.random() < 0.4)) for t in range(3) for _ in range(400 * (t + 1))]
    rows = spark.createDataFrame(data, "t int, v int, s int, y int")
    many = quantize.collapse_counts(rows.groupBy("t", "v", "s", "y").agg(F.count("*").alias("n")), ["t"])
    for t in range(3):
        one, found = quantize.collapse_for_occupancy(rows.where(F.col("t") == t), "v", "s", "y")
        want = sorted((r.v, r.s, r.y, r["count"]) for r in one.groupBy("v", "s", "y").count().collect())
        got = many.where(F.col("t") == t).collect()
        assert sorted((r.v, r.s, r.y, r.n) for r in got) == want and {r.min_share for r in got} == {found["min_share"]}


def test_gaussian(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 4000)
    x = rng.normal(size=(4000, 2)) + y[:, None] * np.array([1.5, 0.0])
    m = Moments(np.array([(y == c).sum() for c in (0, 1)], float), np.array([x[y == c].sum(0) for c in (0, 1)]), np.array([x[y == c].T @ x[y == c] for c in (0, 1)]))
    joint, one, none = information(m), information(m.take(np.array([0]))), information(m.take(np.array([1])))
    assert abs(joint - one) < 0.01 and one > 0.15 and none < 0.002
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "key long, a double, b double, y int")
    got = pid.gaussian_pid(df, "key", ["a"], ["b"], boots=20, cross_check=True)
    assert abs(got["i_val"] - one) < 0.02 and got["forced_zero"] == "u_str" and got["n_boot"] == 20 and got["floor_val"] < 0.01
    assert got["clears_threshold"] is False and abs(got["entropy_form_val"] - one) < 0.03


def plain_moments(x, y, w):
    return [(w[y == c].sum(), (x * w[:, None])[y == c].sum(0), (x * w[:, None])[y == c].T @ x[y == c]) for c in (0, 1)]


def test_moments_of_resamples(spark):
    """Every resample's moments are those of its rows; permutations keep class totals;
    nothing depends on partitions."""
    rng = np.random.default_rng(6)
    n, d = 700, 5
    x, y = rng.normal(size=(n, d)), (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "key long, x array<double>, y int")
    got = pid.moments(df, "key", d, 4, 6, 9)
    again = pid.moments(df.repartition(13, "y", "key"), "key", d, 4, 6, 9)
    h = np.array([r[0] for r in df.orderBy("key").select(F.xxhash64("key")).collect()])
    value, w = sums.mixed(h, np.arange(4), 9), sums.poisson_counts(h, np.arange(6), 10)
    for name, m in got.items():
        order = np.argsort(value[:, name[1]]) if name[0] == "floor" else None
        label = y if order is None else np.isin(np.arange(n), order[: y.sum()]).astype(int)
        for c, (size, total, outer) in enumerate(plain_moments(x, label, w[:, name[1]] if name[0] == "boot" else np.ones(n))):
            assert m.n[c] == size and m.total[c] == pytest.approx(total) and m.outer[c] == pytest.approx(outer)
        assert name[0] == "boot" or m.n.tolist() == [n - y.sum(), y.sum()]
        assert again[name].outer == pytest.approx(m.outer)
    assert len({tuple(m.total[1].round(9)) for m in got.values()}) == 11


@pytest.mark.parametrize("step", [3, 14])
def test_thresholds(spark, step):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    h = np.array([r[0] for r in rows.collect()])
    for n in (0, 1, 1234, 4999, 5000):
        bound = sums.thresholds(rows, "h", 3, n, 5, step)
        assert (sums.mixed(h, np.arange(3), 5) < bound.astype(np.uint64)).sum(0).tolist() == [n] * 3
    assert sums.thresholds(rows.where("false"), "h", 2, 0, 5).tolist() == [0, 0]
    twice = rows.unionByName(rows)  # equal keys go together
    assert ((sums.mixed(np.r_[h, h], np.arange(1), 5) < sums.thresholds(twice, "h", 1, 11, 5).astype(np.uint64)).sum(0) == 10).all()


def test_rows_of_a_task(spark):
    """At 52 columns and 400 draws a task leaves a few rows of sums."""
    d, x = 52, np.random.default_rng(1).normal(size=(40, 52))
    total = (np.ones((2 * 406, 40)) @ sums.packed(x)).ravel()
    assert sums.pieces(total).num_rows < 40
    m = pid.unpacked(sums.packed(x).sum(0)[None], d)
    assert m.outer[0] == pytest.approx(x.T @ x) and m.total[0] == pytest.approx(x.sum(0))


def test_studies(spark, rows):
    data = [(a, b, float(3 * (a == "p") + (b == "u") + 0.01 * r)) for a in "pq" for b in "uvw" for r in range(5)]
    df = spark.createDataFrame(data, "a string, b string, x double")
    got = {r.source: r for r in studies.two_way_anova(df, "a", "b", "x").collect()}
    assert (got["a"].df, got["b"].df, got["interaction"].df, got["residual"].df) == (1, 2, 2, 24) and got["a"].p < 1e-10 and got["interaction"].p > 0.9 and got["residual"].f is None
    assert abs(sum(r.pct for r in got.values()) - 100) < 1e-9 and abs(got["a"].ss - 30 * 1.5**2) < 1e-9 and all(r.balanced for r in got.values())
    line = spark.createDataFrame([("t", 2**i, 10.0 - i) for i in range(6)], "target string, m int, u double")
    fit = studies.trend(line, ["target"], "m", "u").first()
    assert abs(fit.slope + 1) < 1e-12 and fit.rho == -1.0 and fit.slope_p < 1e-6 and fit.pct_removed == 50.0
    cut = studies.truncated_trends(line, ["target"], "m", "u", [1, 4, 16])
    assert {r.start for r in cut.collect()} == {1, 4} and studies.trend_verdict(cut, ["target"]).first().verdict == "robust"
    within = studies.within_sites(rows.withColumn("site", F.col("key") % 3), "site", "key", 500, draws=2)
    assert within.count() == 3 and studies.pooling_effect(within.withColumn("t", F.lit("t")), ["t"], "site").first().n_sites == 3
    counts = info.joint_counts(rows.where("y IS NOT NULL").withColumn("site", F.col("key") % 4), ["site"])
    sets = {}
    for r in studies.dose_sets(counts, "site", [4], 600, 5).collect():
        sets.setdefault(r.draw, set()).add((r.site, r.v, r.s, r.y, r.n))
    again = {(r.draw, r.site, r.v, r.s, r.y, r.n) for r in studies.dose_sets(counts.repartition(5), "site", [4], 600, 5).collect()}
    assert len({frozenset(x) for x in sets.values()}) == 5 and again == {(k, *x) for k, v in sets.items() for x in v}
    dose = studies.dose_response(rows.where("y IS NOT NULL").withColumn("site", F.col("key") % 4), "site", "key", [1, 2, 4, 8], 600, 2).collect()
    assert {(r.m, r.draw): (r.n, r.n_sites) for r in dose} == {(m, d): (600 // m * m, m) for m in (1, 2, 4) for d in (0, 1)}


def test_calibration_and_page(spark, rows):
    from channelweave.plans import report
    from channelweave.plans.constants import Study

    counts = info.joint_counts(rows, ["k"])
    head = pid.decompose(counts, ["k"], "ccs")
    draws = resample.null_draws(counts, ["k"], "conditional", 20, "ccs")
    seen = head.select("k", "u_str", F.lit(0).alias("seed")).unionByName(head.select("k", "u_str", F.lit(1).alias("seed")))
    cal = resample.calibration(seen, draws, ["k"], "u_str")
    got = {r.k: r for r in cal.collect()}
    assert all(r.n_ok == 20 and r.n_dropped == 0 and r.obs_sd == 0.0 and r.null_mean <= r.null_max and abs(r.debiased - (r.obs_mean - r.null_mean)) < 1e-12 for r in got.values())
    gate = resample.joint_gate(counts, ["k"], head.select("k", "i_joint"), 50)
    ends = resample.interval(draws, ["k"], ["u_str"])
    sweep = spark.createDataFrame([(2, "fixed", 1.0)], "k int, arm string, syn_mean double")
    variance = studies.two_way_anova(spark.createDataFrame([(a, b, float(a + b + r)) for a in (0, 1) for b in (0, 1) for r in (0, 1)], "a int, b int, x double"), "a", "b", "x")
    page = report.study_page(["k"], head, gate, ends, cal, sweep, variance, spark.createDataFrame([(1, 0.5)], "m int, mean double"))
    assert page.count("## ") == 8 and "| 2 | fixed | 1 |" in page
    assert Study().k == 13 and len(Study().panel) == 12


def test_average_ranks_use_one_set_of_ranges(spark):
    """Approximate quantiles differ from run to run on a cluster; worked out twice in one
    plan, they gave ranks outside of 0 to 1."""
    rows = spark.range(3000).select(F.col("id").alias("k"), F.expr("id * 7919 % 997 * 1.0D").alias("a"), F.expr("id % 5 * 1.0D").alias("b"))
    found = info.average_ranks(rows, ["a", "b"], "k")
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    told, given = found.toPandas(), rows.toPandas()
    for c in ("a", "b"):
        u = told[told.column == c].set_index("k").u.sort_index().to_numpy()
        assert np.allclose(u, (given.sort_values("k")[c].rank() / 3001).to_numpy())
    assert info.average_ranks(rows.where("k < 0"), ["a", "b"], "k").count() == 0


def test_degenerate_cells_hold_each_row_once(spark):
    """Three counts of distinct levels expanded every row; nulls and cells of no rows are none."""
    rows = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 1, 1, 1, 2), (2, 0, 0, 0, 1), (2, 0, 1, 1, 1), (3, 0, 0, 0, 1), (3, 1, 1, 1, 0)], "k int, v int, s int, y int, n int")
    found = pid.degenerate(rows, ["k"])
    assert sorted(map(tuple, found.select("k", "n_v", "n_s", "n_y").collect())) == [(2, 1, 2, 2), (3, 1, 1, 1)]
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
