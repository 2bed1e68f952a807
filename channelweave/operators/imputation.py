"""Chained equations to convergence, by second moments.

Every column with missing numbers is a linear regression on all the others, on the rows
where it is known; where it is not, it is what the regression says, and these answers
go into the others' regressions, until nothing changes any more. A round is one pass for
all columns: a task fills its rows by the rounds so far and adds up, for each column, the
second moments of the rows where that column is known, which is one matrix product of
known-flags with packed rows. The regressions are then solved from a few numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.functions.columns import finite
from channelweave.functions.sums import packed, summed, symmetric

#: The answers have settled when no column's change, root mean square over its missing
#: cells, is over this share of its deviation.
TOLERANCE, MAX_ROUNDS = 1e-3, 50
#: Rows of a matrix product.
SLICE = 2048


def shrunken(gram: np.ndarray, cross: np.ndarray, square: float, n: float, rounds: int = 1000, tolerance: float = 1e-8, prior: float = 1e-6) -> np.ndarray:
    """Coefficients of a ridge regression of centred data whose penalty is the one of most
    evidence (MacKay, 1992): the precisions of noise and coefficients are estimated in
    turn. Only products of the data are needed."""
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0)
    along, noise, weight, old = vectors.T @ cross, n / square if square > 0 else 1.0, 1.0, None
    for _ in range(rounds):
        part = along / (values + weight / noise)
        told = max(square - 2 * part @ along + (values * part**2).sum(), 0)
        free = (noise * values / (weight + noise * values)).sum()
        weight, noise = (free + 2 * prior) / ((part**2).sum() + 2 * prior), (n - free + 2 * prior) / (told + 2 * prior)
        if old is not None and np.abs(old - part).sum() < tolerance:
            break
        old = part
    return vectors @ (along / (values + weight / noise))


def regression(sums: np.ndarray, d: int, i: int) -> np.ndarray:
    """Intercept and coefficients (0 for the column itself) of column i on the others,
    from sums of packed rows."""
    n, total, outer = sums[0], sums[1 : 1 + d], symmetric(sums[1 + d :], d)
    mean = total / n
    centred = outer - n * np.outer(mean, mean)
    others = np.delete(np.arange(d), i)
    beta = np.zeros(d)
    beta[others] = shrunken(centred[np.ix_(others, others)], centred[others, i], centred[i, i], n)
    return np.r_[mean[i] - beta @ mean, beta]


def after_round(z: np.ndarray, missing: np.ndarray, steps: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Filled rows after one more round; a column's answers are in use at once."""
    z = z.copy()
    for i, beta in steps:
        at = missing[:, i]
        z[at, i] = beta[0] + z[at] @ beta[1:]
    return z


def filled(z: np.ndarray, missing: np.ndarray, rounds: list[list[tuple[int, np.ndarray]]]) -> np.ndarray:
    """Rows after these rounds; missing cells begin at 0, the mean."""
    return reduce(lambda x, steps: after_round(x, missing, steps), rounds, np.where(missing, 0.0, z))


def chained_rounds(rows: DataFrame, column: str, mean: np.ndarray, scale: np.ndarray, todo: list[int], tolerance: float, most: int) -> list[list[tuple[int, np.ndarray]]]:
    """The regressions of each round, of standardised columns; one pass each, and one that
    sees that nothing changes."""
    d, rounds = len(mean), []
    wide = 1 + d + d * (d + 1) // 2
    while todo and len(rounds) < most:

        def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total, change = np.zeros((len(todo), wide)), np.zeros((2, len(todo)))
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    x = batch.column(0).slice(at, SLICE)
                    x = x.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(x), -1)
                    missing = np.isnan(x)
                    before = filled((x - mean) / scale, missing, rounds[:-1])  # noqa: B023
                    now = after_round(before, missing, rounds[-1]) if rounds else before  # noqa: B023
                    total += (~missing[:, todo]).T.astype(float) @ packed(now)
                    change += np.stack([((now - before) ** 2 * missing)[:, todo].sum(0), missing[:, todo].sum(0)])
            return np.r_[total.ravel(), change.ravel()]

        found = summed(rows.select(column), add)
        change, missing = found[len(todo) * wide :].reshape(2, -1)
        if rounds and np.sqrt(change / np.maximum(missing, 1)).max() <= tolerance:
            break
        total = found[: len(todo) * wide].reshape(len(todo), wide)
        rounds.append([(i, regression(total[k], d, i)) for k, i in enumerate(todo)])
    return rounds


def chained(rows: DataFrame, columns: list[str], tolerance: float = TOLERANCE, most: int = MAX_ROUNDS) -> DataFrame:
    """rows with missing numbers of the columns (null, NaN, infinite) replaced by what the
    chained equations settle on. Columns are taken by how few numbers they lack.

    A column without numbers gets 0, a single column its mean. Rows are kept as they
    are, and a task applies the rounds: nothing but the regressions is carried along."""
    d = len(columns)
    known = [finite(F.col(c)) for c in columns]
    stats = rows.agg(*(f(k).alias(f"{n}{i}") for i, k in enumerate(known) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count))), F.count("*").alias("n")).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(d)])
    todo = sorted((i for i in range(d) if 0 < stats[f"n{i}"] < stats["n"] and d > 1), key=lambda i: (-stats[f"n{i}"], i))
    numbers = F.array(*(k.cast("double") for k in known))
    slim = rows.select(numbers.alias("x")).persist()
    rounds = chained_rounds(slim, "x", mean, scale, todo, tolerance, most)
    slim.unpersist()

    @F.pandas_udf("array<double>")
    def fill(x: pd.Series) -> pd.Series:
        if x.empty:
            return x
        given = np.array(x.tolist(), float)
        missing = np.isnan(given)
        return pd.Series(list(np.where(missing, filled((given - mean) / scale, missing, rounds) * scale + mean, given)))

    packed_rows = rows.select(F.struct(*rows.columns).alias("row"), fill(numbers).alias("x"))
    return packed_rows.select(*(F.col("x")[columns.index(c)].alias(c) if c in columns else F.col("row")[c].alias(c) for c in rows.columns))
