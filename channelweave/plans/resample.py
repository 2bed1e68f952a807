"""Nulls and bootstraps. Draws are made from count tables wherever they can be: a
permutation of n labels is a multivariate hypergeometric draw of a few hundred counts.
A task is a (cell, batch) row with its own seed, so results don't depend on partitions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from channelweave.functions.decompose import ATOMS, atoms, nodes, tensor
from channelweave.operators import clusters
from channelweave.operators.information import dense
from channelweave.plans import pid

BATCH = 25
DRAW = "draw int, red double, u_val double, u_str double, syn double, i_joint double, converged boolean"


def drawn_cells(cells: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each cell are among n rows drawn without replacement.

    numpy's draw ends at 1e9 rows. Beyond it every row is taken by chance n / total, and
    what is too much or missing, about the root of n, is drawn evenly from the rows
    taken or left: given their number, rows taken by chance are an even draw too."""
    cells, total = cells.astype(np.int64), int(cells.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(cells, n, method="marginals")
    got = rng.binomial(cells, n / total)
    over = int(got.sum()) - n
    pool = got if over > 0 else cells - got
    places = np.zeros(0, np.int64)
    while len(places) < abs(over):
        places = np.unique(np.r_[places, rng.integers(0, int(pool.sum()), abs(over) - len(places))])
    shift = np.bincount(np.searchsorted(np.cumsum(pool), places, "right"), minlength=len(cells))
    return got - shift if over > 0 else got + shift


def permuted_table(table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Labels permuted over all rows: (v,s) counts and the labels' totals stay."""
    cells = table.sum(2).astype(np.int64).ravel()
    out, left = np.zeros((len(cells), table.shape[2])), cells.copy()
    for c in range(table.shape[2] - 1):
        out[:, c] = drawn_cells(left, int(table[..., c].sum()), rng)
        left = left - out[:, c].astype(np.int64)
    out[:, -1] = left
    return out.reshape(table.shape)


def conditional_table(table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """s permuted within each v: (v,s) and (v,y) counts stay, so u_str and syn are null."""
    return np.stack([permuted_table(layer[None], rng)[0] for layer in table])


KINDS = {"permutation": permuted_table, "conditional": conditional_table}


def cell_tables(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its dense count table as an array, sorted by v, s, y."""
    cells = F.sort_array(F.collect_list(F.struct("v", "s", "y", "n")))  # levels are few
    return dense(counts, keys).groupBy(*keys).agg(cells.alias("cells"))


def null_draws(
    counts: DataFrame, keys: list[str], kind: str = "permutation", draws: int = 200, measure: str | None = "broja", seed: int = 0, batch: int = BATCH, first: int = 0
) -> DataFrame:
    """keys, draw and the atoms of each null table. With ``measure`` None only i_joint
    is computed, which needs no solver: the atoms always add up to it. Draws before
    ``first``, a multiple of ``batch``, are left out; the others stay the same."""
    if first % batch:
        raise ValueError("draws begin with a whole batch")
    make = KINDS[kind]
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    tasks = cell_tables(counts, keys).withColumn("batch", F.explode(F.sequence(F.lit(first // batch), F.lit(max(first // batch, math.ceil(draws / batch) - 1)))))
    tasks = tasks.withColumn("seed", F.xxhash64(F.lit(seed), *keys, "batch"))

    def run(frames):
        for frame in frames:
            for task in frame.itertuples(index=False):
                cells = pd.DataFrame([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in task.cells], columns=["v", "s", "y", "n"])
                table, rng = tensor(cells.v, cells.s, cells.y, cells.n), np.random.default_rng(task.seed & (2**63 - 1))
                rows = []
                for i in range(task.batch * batch, min(draws, (task.batch + 1) * batch)):
                    drawn = make(table, rng)
                    found = atoms(drawn, measure) if measure else {**dict.fromkeys(ATOMS, math.nan), "converged": True}
                    rows.append((*(getattr(task, k) for k in keys), i, *(found[a] for a in ATOMS), nodes(drawn / drawn.sum())[2], found["converged"]))
                yield pd.DataFrame(rows, columns=[*keys, *(c.split()[0] for c in DRAW.split(", "))])

    spread = max(1, min(4 * counts.sparkSession.sparkContext.defaultParallelism, draws))
    return tasks.select(*keys, "cells", "batch", "seed").repartition(spread, *keys, "batch").mapInPandas(run, f"{kinds}, {DRAW}" if keys else DRAW)


def null_tables(counts: DataFrame, keys: list[str], kind: str, draws: int, seed: int = 0) -> DataFrame:
    """The null count tables themselves: keys, draw, v, s, y, n."""
    make = KINDS[kind]
    kinds = "".join(f"`{k}` {counts.schema[k].dataType.simpleString()}, " for k in keys)
    levels = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in ("v", "s", "y"))
    tasks = cell_tables(counts, keys).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("seed", F.xxhash64(F.lit(seed), *keys, "draw"))

    def run(frames):
        for frame in frames:
            for task in frame.itertuples(index=False):
                cells = pd.DataFrame([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in task.cells], columns=["v", "s", "y", "n"])
                drawn = make(tensor(cells.v, cells.s, cells.y, cells.n), np.random.default_rng(task.seed & (2**63 - 1)))
                out = cells.sort_values(["v", "s", "y"])
                yield out.assign(n=drawn.ravel().astype(np.int64), draw=task.draw, **{k: getattr(task, k) for k in keys})[[*keys, "draw", "v", "s", "y", "n"]]

    return tasks.mapInPandas(run, f"{kinds}draw int, {levels}, n long")


def p_value(draws: DataFrame, observed: DataFrame, keys: list[str], draw: str, value: str, level: float = 0.05) -> DataFrame:
    """keys, observed, null_mean, null_p95, null_p975, debiased, p, gate_pass, n_used and
    n_dropped. Draws that are NaN or null are dropped and counted; p counts the
    observation itself as one draw."""
    x = F.when(~F.isnan(draw), F.col(draw))
    rows = draws.join(observed.select(*keys, F.col(value).alias("_obs")), keys) if keys else draws.crossJoin(observed.select(F.col(value).alias("_obs")))
    # one row of ``observed`` per key
    out = rows.groupBy(*keys).agg(
        F.first("_obs").alias("observed"), F.avg(x).alias("null_mean"), F.percentile(x, F.array(F.lit(0.95), F.lit(0.975))).alias("q"),
        F.count_if(x >= F.col("_obs")).alias("over"), F.count(x).alias("n_used"), F.count_if(x.isNull()).alias("n_dropped"),
    )
    p = (F.col("over") + 1) / (F.col("n_used") + 1)
    return out.select(
        *keys, "observed", "null_mean", F.col("q")[0].alias("null_p95"), F.col("q")[1].alias("null_p975"), (F.col("observed") - F.col("null_mean")).alias("debiased"),
        p.alias("p"), (p <= level).alias("gate_pass"), "n_used", "n_dropped",
    )


def joint_gate(counts: DataFrame, keys: list[str], observed: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Is the joint information more than chance? ``observed`` has keys and i_joint."""
    return p_value(null_draws(counts, keys, "permutation", draws, None, seed), observed, keys, "i_joint", "i_joint")


def sequential_gate(counts: DataFrame, keys: list[str], observed: DataFrame, most: int = 1000, over: int = 20, seed: int = 0, level: float = 0.05, batch: int = BATCH) -> DataFrame:
    """``joint_gate`` with draws until it is settled (Besag and Clifford, 1991): keys,
    observed, p, gate_pass, n_used.

    Draws are taken in their order until ``over`` of them are not below the observation;
    with the last of these, the l-th draw, p is over / l. A key that does not get there
    has all ``most`` draws, and p counts the observation itself. Rounds of doubling size
    go to the keys that are still open, so where there is nothing, a few dozen draws
    are made and not a thousand. The draws are those of ``joint_gate``; no result
    depends on the rounds or on partitions. ``observed`` has keys and i_joint; the state
    of a round, one row a key, is with the driver, the draws' tables are not."""
    spark = counts.sparkSession
    rows = observed.select(*keys, F.col("i_joint").alias("observed"))
    names = StructType([*rows.schema.fields, StructField("found", LongType())])
    still = {tuple(r[k] for k in keys): (r["observed"], 0) for r in rows.collect()}
    settled: list[tuple] = []
    counts, first, size = counts.persist(), 0, 2 * batch
    while still and first < most:
        last = min(most, first + size)
        asked = F.broadcast(spark.createDataFrame([(*k, *v) for k, v in still.items()], names))  # a row for each key
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
        left = counts.alias("c").join(asked.alias("a"), same, "left_semi").select("c.*")
        draws = null_draws(left, keys, "permutation", last, None, seed, batch, first).alias("c").join(asked.alias("a"), same)
        over_it = draws.where("i_joint >= observed").select("c.*").groupBy(*keys).agg(F.sort_array(F.collect_list("draw")).alias("hit"))  # of a round's draws
        hits = {tuple(r[k] for k in keys): r["hit"] for r in over_it.collect()}
        for k, (seen, found) in list(still.items()):
            hit = hits.get(k, [])
            if found + len(hit) >= over:
                used = hit[over - found - 1] + 1
                settled.append((*k, seen, over / used, used))
                del still[k]
            else:
                still[k] = seen, found + len(hit)
        first, size = last, 2 * size
    counts.unpersist()
    settled += [(*k, seen, (found + 1) / (most + 1), most) for k, (seen, found) in still.items()]
    done = spark.createDataFrame(settled, StructType([*rows.schema.fields, StructField("p", DoubleType()), StructField("n_used", LongType())]))
    return done.select(*keys, "observed", "p", (F.col("p") <= level).alias("gate_pass"), "n_used")


def calibration(observed: DataFrame, draws: DataFrame, keys: list[str], value: str, seed: str = "seed") -> DataFrame:
    """Per key: mean and sample deviation of the observed value over seeds, the first
    seed's, the null's mean, 95th percentile and largest, what is left above the null,
    and how many draws were used and dropped."""
    x, o = F.when(~F.isnan(value), F.col(value)), F.when(~F.isnan(value), F.col(value))
    null = draws.groupBy(*keys).agg(F.avg(x).alias("null_mean"), F.percentile(x, F.lit(0.95)).alias("null_p95"), F.max(x).alias("null_max"), F.count(x).alias("n_ok"), F.count_if(x.isNull()).alias("n_dropped"))
    seen = observed.groupBy(*keys).agg(F.avg(o).alias("obs_mean"), F.stddev_samp(o).alias("obs_sd"), F.min_by(o, F.col(seed)).alias("obs_first"))
    return seen.join(null, keys).withColumn("debiased", F.col("obs_mean") - F.col("null_mean"))


def interval(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, population deviation, median and the 2.5 and 97.5 percentiles by key."""
    parts = []
    for c in columns:
        x = F.when(~F.isnan(c), F.col(c))
        q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
        parts += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_sd"), q[0].alias(f"{c}_low"), q[1].alias(f"{c}_median"), q[2].alias(f"{c}_high")]
    return rows.groupBy(*keys).agg(*parts, F.count("*").alias("n_draws"))


def bootstrap_tables(
    rows: DataFrame, key: str, values: list[str], times: list[str], targets: list[str], k: int, reps: int, seed: int = 0, sentinel: float | None = None, tries: int = 10
) -> DataFrame:
    """rep, target, v, s, y, n: the count tables of a nested bootstrap. A replicate weighs
    each row by a Poisson count of its key, standardises and fits both codebooks anew on
    all rows, and then every target's rows are counted.

    All replicates share their passes: no job belongs to one of them, and no row moves."""
    repeated = rows.groupBy(key).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("keys are not unique")
    points = clusters.prepare(rows, [key], {"v": clusters.Block(values), "s": clusters.Block(times, sentinel)}, tuple(targets))
    fits = clusters.fit_many(points, [clusters.Spec(b, k, r, 0, r) for b in ("v", "s") for r in range(reps)], tries, seed=seed)
    pairs = clusters.pairs_of(clusters.by_size(points, fits, seed), "v", "s")
    names = rows.sparkSession.createDataFrame([(m, v.spec.replicate) for m, (v, _) in enumerate(pairs)], "model int, rep int")
    return clusters.joint_tables(points, pairs, seed).join(names, "model").select("rep", "target", "v", "s", "y", "n")


def bootstrap(
    rows: DataFrame, key: str, values: list[str], times: list[str], targets: list[str], k: int, reps: int, measures: tuple[str, ...] = ("broja", "ccs"), seed: int = 0, sentinel: float | None = None
) -> DataFrame:
    """Nested bootstrap: (rep, target, measure, atoms, i_joint, converged) for each table
    of ``bootstrap_tables`` and each measure. A draw with one class has null atoms."""
    # tables are small and solves are not: a fixed number of tasks is not merged by size
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism
    counts = bootstrap_tables(rows, key, values, times, targets, k, reps, seed, sentinel).repartition(spread, "rep", "target").persist()
    parts = [pid.decompose(counts, ["rep", "target"], m).select("rep", "target", F.lit(m).alias("measure"), *ATOMS, "i_joint", "converged") for m in measures]
    return reduce(DataFrame.unionByName, parts)


def sampled_counts(counts: DataFrame, keys: list[str], n: str, seed: str) -> DataFrame:
    """keys, v, s, y, n of rows drawn without replacement from each key's count table
    (keys, v, s, y, count): exactly as many as column ``n`` says, or all there are.

    Drawn in count space: no row moves. Column ``seed`` (long) seeds the key's draw, so
    draws of different seeds are independent and reruns agree."""
    levels = [*((k, counts.schema[k].dataType.simpleString()) for k in keys), *((c, counts.schema[c].dataType.simpleString()) for c in ("v", "s", "y"))]

    def draw(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["v", "s", "y"])
        have = cell["count"].to_numpy(np.int64)
        got = drawn_cells(have, min(int(cell[n].iloc[0]), int(have.sum())), np.random.default_rng(int(cell[seed].iloc[0]) & (2**63 - 1)))
        return cell[[c for c, _ in levels]].assign(n=got)[got > 0]

    return counts.groupBy(*keys).applyInPandas(draw, ", ".join(f"`{c}` {t}" for c, t in levels) + ", n long")


def resample_without_replacement(rows: DataFrame, keys: list[str], n: Column | int, seed: Column | int, by: str) -> DataFrame:
    """n rows of each key: those with the smallest seeded hashes of ``by``. Spark keeps
    only each task's n smallest before the shuffle, where n is a number. Keys that are to
    be drawn anew need another ``seed`` each: a column that tells the draws apart."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(seed if isinstance(seed, Column) else F.lit(seed), by), by))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
