"""Decompositions of all cells of a study at once: rows become count tables by one
aggregation, and each table, a few hundred numbers, goes to a kernel."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.functions.decompose import ATOMS, atoms, nodes, tensor
from channelweave.functions.special import inverse_normal
from channelweave.functions.sums import mixed, packed, poisson_counts, summed, symmetric, thresholds
from channelweave.functions.gaussian import Moments, information, information_by_entropies, mmi
from channelweave.operators.information import average_ranks

#: Rows of a matrix product.
SLICE = 2048
RECORD = (
    "n long, n_v int, n_s int, n_y int, red double, u_val double, u_str double, syn double, red_pct double, u_val_pct double, "
    "u_str_pct double, syn_pct double, i_val double, i_str double, i_joint double, i_joint_mm double, min_cell long, n_cells int, n_empty_cells int, converged boolean, gap double"
)


def record(table: np.ndarray, measure: str) -> dict:
    """One cell's result. Percentages are null where there is no joint information."""
    p = table / max(table.sum(), 1)
    found = atoms(table, measure)
    iv, is_, ij = nodes(p) if table.sum() else (math.nan,) * 3
    k = lambda axis: int((table.sum(axis) > 0).sum())
    # (m_vs - 1) + (m_y - 1) - (m_vsy - 1) over 2 N
    mm = ij + (k(2) + k((0, 1)) - k(()) - 1) / (2 * max(table.sum(), 1))
    share = {f"{a}_pct": 100 * found[a] / ij if ij > 0 else None for a in ATOMS}
    return {
        "n": int(table.sum()), "n_v": table.shape[0], "n_s": table.shape[1], "n_y": table.shape[2], **found, **share, "i_val": iv, "i_str": is_, "i_joint": ij, "i_joint_mm": mm,
        "min_cell": int(table.min()) if table.size else 0, "n_cells": int(table.size), "n_empty_cells": int((table == 0).sum()),
    }


def decompose(counts: DataFrame, keys: list[str], measure: str = "broja") -> DataFrame:
    """One row per key: level counts, atoms in nats and percent, plug-in and corrected
    information, occupancy, and whether the kernel's result is certified.

    A key with fewer than two levels of v, s or y has null atoms. Keys may be null."""
    atoms(np.ones((2, 2, 2)), measure)  # an unknown measure is an error now, not in a task
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.split()[0] for c in RECORD.split(", ")]

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        got = record(tensor(cell.v, cell.s, cell.y, cell.n), measure)
        return pd.DataFrame([{**{k: cell[k].iloc[0] for k in keys}, **{c: got[c] for c in names}}], columns=[*keys, *names])

    return counts.groupBy(*keys).applyInPandas(solve, f"{kinds}, {RECORD}" if keys else RECORD)


def degenerate(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that have fewer than two levels of v, s or y; a key may have a level in several
    rows. Levels are few, so a key's are sets, which are sorted in and out of memory: counts
    of distinct levels would hold every row three times, and once more for each of them."""
    sizes = counts.where("n > 0").groupBy(*keys).agg(*(F.size(F.collect_set(c)).cast("long").alias(f"n_{c}") for c in ("v", "s", "y")))
    return sizes.where("n_v < 2 OR n_s < 2 OR n_y < 2")


def copula_rows(rows: DataFrame, key: str, columns: list[str], y: str) -> DataFrame:
    """key, y, x: each column's ranks as standard normal quantiles, in an array."""

    @F.pandas_udf("double")
    def quantile(u: pd.Series) -> pd.Series:
        return pd.Series(inverse_normal(u.to_numpy()))

    rows = rows.select(key, y, *columns).persist()
    ranked = average_ranks(rows, columns, key).withColumn("z", quantile("u"))
    number = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
    wide = ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(number.alias("i"), "z"))), lambda s: s["z"]).alias("x"))
    return wide.where(F.size("x") == len(columns)).join(rows.select(key, F.col(y).cast("int").alias("y")), key).where("y IN (0, 1)").select(key, "y", "x")


def unpacked(sums: np.ndarray, d: int) -> Moments:
    """Moments of classes from sums of ``packed`` rows (classes x numbers)."""
    return Moments(sums[:, 0], sums[:, 1 : 1 + d], symmetric(sums[:, 1 + d :], d))


def moments(rows: DataFrame, key: str, d: int, floors: int, boots: int, seed: int) -> dict[tuple[str, int], Moments]:
    """Class moments of the rows, of ``floors`` copies with permuted labels, and of
    ``boots`` Poisson resamples, by one pass over the rows (and a few more for the
    permutations' bounds).

    A batch adds weights x packed rows, one matrix product for all resamples and both
    classes; a task leaves one array. A permutation gives label 1 to the rows with the
    smallest hashes, exactly as many as there are, so class totals stay; draws come from
    the keys and don't depend on partitions."""
    rows = rows.select("x", "y", F.xxhash64(key).alias("h"))
    ones = int(rows.agg(F.sum("y")).first()[0] or 0) if floors else 0
    bounds = thresholds(rows, "h", floors, ones, seed)
    wide = 1 + d + d * (d + 1) // 2
    names = [("all", 0), *(("floor", i) for i in range(floors)), *(("boot", i) for i in range(boots))]

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2 * len(names), wide))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                y, h = part["y"].to_numpy(zero_copy_only=False).astype(float), part["h"].to_numpy()
                drawn = (mixed(h, np.arange(floors), seed) < bounds.astype(np.uint64)).astype(float)
                one = np.hstack([y[:, None], drawn, y[:, None] * (w := poisson_counts(h, np.arange(boots), seed + 1))])
                total += np.hstack([one, np.hstack([np.ones((len(h), 1 + floors)), w]) - one]).T @ packed(x)
        return total.ravel()

    found = summed(rows, add)
    if found is None:
        return {}
    ones_, zeros = found.reshape(2, len(names), wide)
    return {name: unpacked(np.stack([zeros[k], ones_[k]]), d) for k, name in enumerate(names)}


def gaussian_pid(rows: DataFrame, key: str, values: list[str], times: list[str], y: str = "y", floors: int = 5, boots: int = 400, seed: int = 0, cross_check: bool = False) -> dict:
    """Copula decomposition of a binary outcome: nodes, atoms, chance floors, the
    bootstrap interval of the synergy, and whether it clears the floors' sum."""
    d = len(values) + len(times)
    parts = {"val": np.arange(len(values)), "str": np.arange(len(values), d), "joint": np.arange(d)}
    normal = copula_rows(rows, key, [*values, *times], y).persist()
    got = moments(normal, key, d, floors, boots, seed)
    normal.unpersist()
    if ("all", 0) not in got or min(got["all", 0].n) <= 0:
        raise ValueError("the outcome has to have two classes")
    info = {k: {part: information(m.take(at)) for part, at in parts.items()} for k, m in got.items()}
    node = info["all", 0]
    floor = {part: max((abs(info[k][part]) for k in info if k[0] == "floor" and not math.isnan(info[k][part])), default=0.0) for part in parts}
    syn = np.array([i["joint"] - max(i["val"], i["str"]) for k, i in info.items() if k[0] == "boot"])
    syn = syn[np.isfinite(syn)]
    low, high = np.percentile(syn, [2.5, 97.5]) if len(syn) else (math.nan, math.nan)
    n = got["all", 0].n
    p = float(n[1] / n.sum())
    hy = -(p * math.log(p) + (1 - p) * math.log(1 - p))
    found = mmi(node["val"], node["str"], node["joint"])
    out = {
        "n": int(n.sum()), "prevalence": p, "h_y": hy, "dim_v": len(values), "dim_s": len(times), "i_val": node["val"], "i_str": node["str"], "i_joint": node["joint"],
        "i_joint_pct_of_h": 100 * node["joint"] / hy, **found, **{f"floor_{k}": v for k, v in floor.items()}, "threshold": sum(floor.values()), "syn_low": float(low), "syn_high": float(high),
        "clears_threshold": bool(low > sum(floor.values())), "monotone": bool(node["joint"] >= max(node["val"], node["str"]) - 1e-12),
        "forced_zero": "u_str" if node["str"] <= node["val"] else "u_val", "n_boot": len(syn),
    }
    if cross_check:
        out |= {f"entropy_form_{part}": information_by_entropies(got["all", 0].take(at)) for part, at in parts.items()}
    return out
