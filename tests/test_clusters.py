"""Shared-scan k-means against MLlib, against plain code, and under resampling."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from channelweave.functions import sums
from channelweave.operators import clusters, quantize
from channelweave.plans import studies

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(6, 3)) * 6
    data = [(i, *map(float, at[i % 6] + rng.normal(size=3)), float(rng.normal()) if i % 4 else -999.0, i % 2 if i % 7 else None) for i in range(3000)]
    return spark.createDataFrame(data, "key long, a double, b double, c double, t double, y int")


def specs(**more):
    return [clusters.Spec("v", k, seed, start, **more) for k in (3, 6, 9) for seed in (0, 1) for start in range(3)]


@pytest.fixture(scope="module")
def points(rows):
    return clusters.prepare(rows, ["key"], {"v": clusters.Block(COLUMNS), "s": clusters.Block(["t"], -999.0)}, ("y",))


def test_as_good_as_mllib(spark, rows, points):
    best = clusters.by_size(points, clusters.best_starts(clusters.fit_many(points, specs())))
    assert [(f.spec.k, f.spec.seed) for f in best] == [(k, s) for k in (3, 6, 9) for s in (0, 1)]
    z = quantize.zscore(rows, COLUMNS).select(array_to_vector(F.array(*(f"{c}_z" for c in COLUMNS))).alias("x")).persist()
    for fit in best:
        mllib = min(KMeans(k=fit.spec.k, featuresCol="x", seed=i, maxIter=300).fit(z).summary.trainingCost for i in range(3))
        assert fit.inertia <= 1.01 * mllib
        assert (np.diff(fit.sizes) <= 0).all() and fit.sizes.sum() == 3000


def test_sentinel(spark, rows, points):
    """Distances are those of the columns that ``zscore`` makes."""
    fit = clusters.by_size(points, clusters.fit_many(points, [clusters.Spec("s", 4, 0)]))[0]
    z = quantize.zscore(rows, ["t"], -999.0)
    x = np.array(z.select(*quantize.features(["t"])).collect())
    d = ((x[:, None] - fit.centres[None]) ** 2).sum(2)
    assert fit.inertia == pytest.approx(d.min(1).sum(), rel=1e-9)
    got = np.array([r.s for r in clusters.with_level(rows, points.blocks["s"], points.centre["s"], fit, "s").collect()])
    assert (d[np.arange(len(x)), got] <= d.min(1) + 1e-9).all() and (np.bincount(got) == fit.sizes).all()


def test_samples(spark, rows, points):
    """Passes over hashed samples end close to passes over all rows."""
    part = clusters.prepare(rows, ["key"], {"v": clusters.Block(COLUMNS)}, (), batch_rows=500)
    assert part.slots == 6 and part.rows.count() == 3000
    few, all_ = (clusters.by_size(p, clusters.best_starts(clusters.fit_many(p, specs()))) for p in (part, points))
    for a, b in zip(few, all_, strict=True):
        assert a.inertia <= 1.05 * b.inertia and a.sizes.sum() == 3000


def test_replicates(spark, rows, points):
    """A replicate is the fit of rows repeated as often as their weight, whatever else is
    fitted with it and however rows are dealt."""
    h = np.array([r.h for r in rows.orderBy("key").select(F.xxhash64("key").alias("h")).collect()])
    w = sums.poisson_counts(h, np.array([5]), 0)[:, 0]
    x = np.array(rows.orderBy("key").select(*COLUMNS).collect())
    x = np.repeat(x, w.astype(int), 0)
    one = clusters.fit_many(points, [clusters.Spec("v", 6, 0, 0, 5)])[0]
    assert one.mean + points.centre["v"] == pytest.approx(x.mean(0)) and one.scale == pytest.approx(x.std(0))
    z = (x - x.mean(0)) / x.std(0)
    own = ((z[:, None] - one.centres[None]) ** 2).sum(2).argmin(1)
    for k in range(6):  # settled: centres are means
        assert one.centres[k] == pytest.approx(z[own == k].mean(0), abs=1e-2)
    again = clusters.prepare(rows.repartition(7, "b"), ["key"], points.blocks, ("y",))
    many = clusters.fit_many(again, [clusters.Spec("v", 6, 0, 0, r) for r in (2, 5, 9)])[1]
    assert many.centres == pytest.approx(one.centres)


def test_weights_are_poisson():
    w = sums.poisson_counts(np.arange(20_000) * 7919, np.arange(5), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert np.abs(np.corrcoef(w.T) - np.eye(5)).max() < 0.03


def test_joint_tables(spark, rows, points):
    fits = clusters.by_size(points, clusters.fit_many(points, [clusters.Spec("v", 6, 0), clusters.Spec("s", 3, 0)]))
    got = {(r.target, r.v, r.s, r.y): r.n for r in clusters.joint_tables(points, [(fits[0], fits[1])]).collect()}
    both = rows
    for fit in fits:
        both = clusters.with_level(both, points.blocks[fit.spec.block], points.centre[fit.spec.block], fit, fit.spec.block)
    want = {("y", r.v, r.s, r.y): r["count"] for r in both.where("y IS NOT NULL").groupBy("v", "s", "y").count().collect()}
    assert got == want


def test_edge_cases(spark, rows):
    none = rows.where("false")
    with pytest.raises(ValueError, match="no rows"):
        clusters.fit_many(clusters.prepare(none, ["key"], {"v": clusters.Block(COLUMNS)}), [clusters.Spec("v", 2, 0)])
    with pytest.raises(ValueError, match="nulls"):
        clusters.prepare(rows.withColumn("a", F.when(F.col("key") > 5, F.col("a"))), ["key"], {"v": clusters.Block(COLUMNS)})
    same = spark.createDataFrame([(i, 1.0) for i in range(10)], "key long, a double")
    p = clusters.prepare(same, ["key"], {"v": clusters.Block(["a"])})
    fit = clusters.by_size(p, clusters.fit_many(p, [clusters.Spec("v", 3, 0)]))[0]
    assert fit.inertia == pytest.approx(0) and fit.sizes.tolist() == [10, 0, 0]


def test_sweep(spark, rows):
    sweep = studies.sweep_tables(rows.where("y IS NOT NULL"), "key", COLUMNS, ["t"], "y", [2, 5], [0, 1], n_init=2, sentinel=-999.0)
    n = {(r.k, r.seed, r.arm): r.n for r in sweep.groupBy("k", "seed", "arm").agg(F.sum("n").alias("n")).collect()}
    assert len(n) == 8 and len(set(n.values())) == 1


def test_few_passes_read_all_rows(spark, monkeypatch):
    """Models come near on parts of the rows, so few passes are left for all of them; they
    settle there, and equal distances go to the first centre."""
    rows = spark.range(60_000).select(F.col("id"), *(F.expr(f"randn({i}) + 4 * (id * {7 + i} % 5)").alias(f"x{i}") for i in range(3)))
    points, seen = clusters.prepare(rows, ["id"], {"x": clusters.Block(["x0", "x1", "x2"])}), []
    one_pass = clusters.one_pass
    monkeypatch.setattr(clusters, "one_pass", lambda p, r, f, s: seen.append((len(f), (found := one_pass(p, r, f, s)))) or found)
    fits = clusters.fit_many(points, [clusters.Spec("x", 8, i) for i in range(4)])
    read = [sum(s.reshape(-1)[:-1].reshape(8, -1)[:, -1].sum() for s in found.values()) / n for n, found in seen]
    assert read[-1] == 60_000 and max(read) == 60_000 and min(read) < 20_000
    monkeypatch.undo()
    assert all(f.inertia <= g.inertia * 1.001 for f, g in zip(fits, clusters.by_size(points, fits), strict=True))


def test_rounds_read_all_rows(spark, rows, monkeypatch):
    """However many parts the rows have, a round of parts is all rows, and models settle on all."""
    points, seen = clusters.prepare(rows, ["key"], {"v": clusters.Block(COLUMNS)}, (), batch_rows=500), []
    one_pass = clusters.one_pass
    monkeypatch.setattr(clusters, "one_pass", lambda p, r, f, s: seen.append(found := one_pass(p, r, f, s)) or found)
    fits = clusters.fit_many(points, [clusters.Spec("v", 6, i, 0, i - 1) for i in range(3)], tries=3)
    read = [found[0][:-1].reshape(6, -1)[:, -1].sum() for found in seen if 0 in found]
    parts = clusters.ROUNDS * points.slots
    assert [sum(read[i : i + points.slots]) for i in range(0, parts, points.slots)] == [3000] * clusters.ROUNDS
    assert len(read) > parts and set(read[parts:]) == {3000}
    monkeypatch.undo()
    for fit, all_ in zip(fits, clusters.by_size(points, fits), strict=True):
        assert fit.sizes.sum() == all_.sizes.sum() and all_.inertia <= fit.inertia <= all_.inertia * 1.001


def test_starts_from_all_rows(spark):
    """Single rows far from 60,000 others are found by the starts, wherever they lie."""
    far = F.when(F.col("id") % 10_000 == 17, 1000 + F.col("id")).otherwise(F.rand(1))
    points = clusters.prepare(spark.range(60_000).select("id", far.alias("x")), ["id"], {"x": clusters.Block(["x"])})
    fits = clusters.by_size(points, clusters.fit_many(points, [clusters.Spec("x", 7, i) for i in range(3)]))
    assert all(f.sizes.tolist() == [59_994, 1, 1, 1, 1, 1, 1] for f in fits)


def test_sums_of_equal_distances():
    """A row as near to two centres goes to the first of them."""
    points = clusters.Points(None, 0, 1, {"x": clusters.Block(["x"])}, {"x": np.zeros(1)}, [], 1)
    fit = lambda *at: clusters.Fit(clusters.Spec("x", 3, 0), np.array(at)[:, None], np.zeros(1), np.ones(1), np.zeros(3), 0.0)
    x = np.array([[0.0], [1.0], [2.0], [5.0]])
    got = clusters.Stack(points, "x", {0: fit(0.0, 2.0, 2.0), 1: fit(9.0, 3.0, 1.0)}).sums(x, np.ones_like(x), np.array([[1.0, 2.0], [3.0, 1.0], [1.0, 1.0], [1.0, 4.0]]))
    assert got[:, :-1].reshape(2, 3, 3)[:, :, -1].tolist() == [[4, 2, 0], [0, 5, 3]] and got[:, -1].tolist() == [12, 19]


def test_sweep_counts_far_rows(spark):
    """Levels of a sweep are those of all rows: each of a few far ones has its own."""
    far = F.when(F.col("id") % 10_000 == 17, 1000 + F.col("id")).otherwise(F.rand(1))
    rows = spark.range(60_000).select("id", far.alias("x"), F.rand(2).alias("t"), (F.col("id") % 2).alias("y"))
    got = studies.sweep_tables(rows, "id", ["x"], ["t"], "y", [7], [0, 1], n_init=2).where("arm = 'fixed'").groupBy("seed", "v").agg(F.sum("n").alias("n"))
    assert sorted((r.seed, r.v, r.n) for r in got.collect()) == [(s, v, 1 if v else 59_994) for s in (0, 1) for v in range(7)]
