"""Chained equations against the plain loop, run until nothing changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelweave.functions import sums
from channelweave.operators import imputation

COLUMNS = ["a", "b", "c", "e"]


def plain_ridge(x, y):
    """Bayesian ridge on the rows themselves: fixed point of the two precisions."""
    x, y = x - x.mean(0), y - y.mean()
    noise, weight = 1 / y.var(), 1.0
    for _ in range(300):
        beta = np.linalg.solve(x.T @ x + weight / noise * np.eye(x.shape[1]), x.T @ y)
        eig = noise * np.linalg.eigvalsh(x.T @ x)
        free = (eig / (weight + eig)).sum()
        weight, noise = free / (beta @ beta), (len(y) - free) / ((y - x @ beta) ** 2).sum()
    return beta


def plain_chained(x, rounds=50):
    """One column after the other, each on the others' newest answers."""
    missing = np.isnan(x)
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    z = np.where(missing, 0, (x - mean) / sd)
    for _ in range(rounds):
        for i in np.argsort(missing.sum(0), kind="stable"):
            if missing[:, i].any():
                at, others = ~missing[:, i], np.delete(np.arange(x.shape[1]), i)
                beta = plain_ridge(z[at][:, others], z[at, i])
                z[~at, i] = z[at, i].mean() + (z[~at][:, others] - z[at][:, others].mean(0)) @ beta
    return z * sd + mean


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 4)) * np.array([1, 5, 0.3, 2]) + rng.normal(size=(400, 4)) * 0.3 + np.array([0, 100, 3, -7])
    x[rng.random(x.shape) < 0.12] = np.nan
    x[:, 2] = np.where(np.arange(400) % 9 == 0, np.nan, x[:, 2])
    return x


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r), "k") for i, r in enumerate(data)], "id long, a double, b double, c double, e double, x string")


def test_brute_force(rows, data):
    got = np.array([[r[c] for c in COLUMNS] for r in imputation.chained(rows, COLUMNS, 1e-5, 60).orderBy("id").collect()])
    want = plain_chained(data)
    known = ~np.isnan(data)
    assert (got[known] == data[known]).all()
    assert np.abs((got - want) / np.nanstd(data, 0)).max() < 5e-3


def test_stops_by_tolerance(rows, data):
    """Passes are rounds and one that sees that nothing changes; fewer for less."""
    slim = rows.select(F.array(*COLUMNS).alias("x"))
    mean, sd = np.nanmean(data, 0), np.nanstd(data, 0)
    passes, real = [], imputation.summed
    imputation.summed = lambda *a: passes.append(1) or real(*a)
    try:
        found = imputation.chained_rounds(slim, "x", mean, sd, [0, 1, 2, 3], 1e-3, 50)
        assert 2 < len(found) < 50 and len(passes) == len(found) + 1
        passes.clear()
        assert len(imputation.chained_rounds(slim, "x", mean, sd, [0, 1, 2, 3], 0.1, 50)) < len(found)
    finally:
        imputation.summed = real


def test_is_a_regression(spark):
    rows = [(i, float(i), 2.0 * i + 1 if i % 5 else None, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: r.b for r in imputation.chained(df, ["a", "b", "c"]).collect()}
    assert all(abs(got[i] - (2 * i + 1)) < 0.05 for i in range(200))


def test_edge_cases(spark, rows):
    odd = [(1, 1.0, None, float("nan")), (2, None, None, 2.0), (3, 3.0, None, float("inf")), (4, None, None, None), (4, None, None, None)]
    df = spark.createDataFrame(odd, "id long, a double, none double, c double")
    got = imputation.chained(df, ["a", "none", "c"]).collect()
    assert len(got) == 5 and all(r.none == 0.0 and np.isfinite([r.a, r.c]).all() for r in got) and {r.id: r.a for r in got}[3] == 3.0
    assert {r.id: r.a for r in imputation.chained(df, ["a"]).collect()} == {1: 1.0, 2: 2.0, 3: 3.0, 4: 2.0}
    assert imputation.chained(rows.where("false"), COLUMNS).count() == 0
    assert imputation.chained(rows, COLUMNS).columns == rows.columns
    again = sorted((r.id, round(r.b, 6)) for r in imputation.chained(rows.repartition(9, "b"), COLUMNS).collect())
    assert again == sorted((r.id, round(r.b, 6)) for r in imputation.chained(rows, COLUMNS).collect())


def test_symmetric():
    x = np.random.default_rng(0).normal(size=(30, 4))
    total = sums.packed(x).sum(0)
    assert total[0] == 30 and sums.symmetric(total[5:], 4) == pytest.approx(x.T @ x)
