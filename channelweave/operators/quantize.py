"""Discretisation: z-scores, k-means levels by size, and merging of rare levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelweave.functions.columns import SENTINEL
from channelweave.operators import clusters

SHARES = (0.02, 0.05, 0.10, 0.20)


def zscore(rows: DataFrame, columns: list[str], sentinel: float | None = None, suffix: str = "_z") -> DataFrame:
    """rows with each column's z-score (population deviation; a constant column is only
    centred). With a sentinel, mean and deviation are those of real values, sentinels
    get 0, and ``<column>_real`` says which were real. One pass for all statistics."""
    real = {c: F.col(c) if sentinel is None else F.when(F.col(c) != sentinel, F.col(c)) for c in columns}
    stats = rows.agg(*(f(real[c]).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    out = {}
    for i, c in enumerate(columns):
        mean, sd = stats[f"m_{i}"] or 0.0, stats[f"s_{i}"]
        sd = sd if sd is not None and sd > 0 else 1.0
        out[c + suffix] = F.coalesce((real[c] - F.lit(float(mean))) / F.lit(float(sd)), F.lit(0.0)) if sentinel is not None else (F.col(c) - F.lit(float(mean))) / F.lit(float(sd))
        if sentinel is not None:
            out[f"{c}_real"] = F.when(F.col(c) != sentinel, 1.0).otherwise(0.0)
    return rows.withColumns(out)


def features(columns: list[str], sentinel: float | None = SENTINEL, suffix: str = "_z") -> list[str]:
    """Names of the columns that k-means reads after ``zscore``."""
    return [c + suffix for c in columns] + ([f"{c}_real" for c in columns] if sentinel is not None else [])


def squared_distance(x: Column, centre: list[float]) -> Column:
    at = F.array(*(F.lit(float(v)) for v in centre))
    return F.aggregate(F.zip_with(x, at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def nearest_centroid(rows: DataFrame, vector: str, centres: list[list[float]], into: str = "cluster") -> DataFrame:
    """The number of the nearest centre; the least of equals."""
    options = [F.struct(squared_distance(F.col(vector).cast("array<double>"), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return rows.withColumn(into, F.array_min(F.array(*options))["i"])


def relabel_by_size(rows: DataFrame, cluster: str, into: str = "level") -> DataFrame:
    """Levels 0, 1, ... by falling number of rows, then by cluster: one row per cluster
    is ranked, and joined back."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("_n"))
    ranked = sizes.withColumn(into, (F.row_number().over(Window.orderBy(F.desc("_n"), F.asc(cluster))) - 1).cast("int"))
    return rows.join(ranked.drop("_n"), cluster, "left")


def kmeans_levels(rows: DataFrame, columns: list[str], k: int, seed: int = 0, n_init: int = 10, into: str = "level") -> tuple[DataFrame, float]:
    """Levels of the best of ``n_init`` fits of the columns as they are, by falling size,
    and its inertia; all fits share their passes over the rows."""
    block = clusters.Block(columns)
    points = clusters.prepare(rows, columns, {"x": block})
    fits = clusters.fit_many(points, [clusters.Spec("x", k, seed, i) for i in range(n_init)], standardise=False)
    best = clusters.by_size(points, clusters.best_starts(fits))[0]
    return clusters.with_level(rows, block, points.centre["x"], best, into), best.inertia


def rare_levels(level: str, n: str, share: float) -> Column:
    """An aggregate over a table of counts: a map from each level to its new one.

    Levels with at least this share stay, or else the two most frequent; the others join
    the nearest that stays, the lower of two. What stays is numbered by its order."""
    cells = F.collect_list(F.struct(F.col(level).alias("at"), F.col(n).alias("n")))
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c["n"])
    frequent = F.filter(cells, lambda c: c["n"] >= total * F.lit(share))
    first_two = F.slice(F.array_sort(cells, lambda x, y: F.when(x["n"] != y["n"], F.sign(y["n"] - x["n"])).otherwise(F.sign(x["at"] - y["at"])).cast("int")), 1, 2)
    stays = F.array_sort(F.transform(F.when(F.size(frequent) < F.least(F.lit(2), F.size(cells)), first_two).otherwise(frequent), lambda c: c["at"]))
    nearest = lambda c: F.array_min(F.transform(stays, lambda u: F.struct(F.abs(u - c["at"]).alias("d"), u.alias("u"))))["u"]
    return F.map_from_entries(F.transform(cells, lambda c: F.struct(c["at"], (F.array_position(stays, nearest(c)) - 1).cast("int"))))


def mapped(level: str, mapping: dict[int, int]) -> Column:
    """The new level; null stays null."""
    return reduce(lambda c, kv: c.when(F.col(level) == kv[0], kv[1]), sorted(mapping.items()), F.when(F.lit(False), F.lit(0)))


def collapse_rare(rows: DataFrame, level: str, least: float = 0.02, into: str | None = None) -> DataFrame:
    """rows with rare levels merged into their neighbours. One count of the rows."""
    counts = rows.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("n"))
    return rows.withColumn(into or level, mapped(level, counts.agg(rare_levels(level, "n", least)).first()[0]))


def collapse_counts(counts: DataFrame, keys: list[str], min_cell: int = 20, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """``collapse_for_occupancy`` of many count tables (keys, v, s, y, n) at once: the same
    columns with the new levels, and the share that was taken. All of it is one plan."""
    each = counts.select(*keys, "v", "s", "y", "n")
    for side in ("v", "s"):
        sizes = counts.groupBy(*keys, side).agg(F.sum("n").alias("n"))
        maps = sizes.groupBy(*keys).agg(F.array(*(rare_levels(side, "n", x) for x in shares)).alias(f"{side}_maps"))
        each = each.join(maps, keys)
    tried = each.select(*keys, "v", "s", "y", "n", "v_maps", "s_maps", F.explode(F.array(*map(F.lit, range(len(shares))))).alias("step"))
    new = lambda side: F.element_at(F.element_at(f"{side}_maps", F.col("step") + 1), F.col(side)).alias(side)
    merged = tried.select(*keys, "step", new("v"), new("s"), "y", "n").groupBy(*keys, "step", "v", "s", "y").agg(F.sum("n").alias("n"))
    told = merged.groupBy(*keys, "step").agg(*(F.count_distinct(c).alias(f"n_{c}") for c in ("v", "s", "y")), F.count("*").alias("cells"), F.min("n").alias("least"))
    full = (F.col("cells") == F.col("n_v") * F.col("n_s") * F.col("n_y")) & (F.col("least") >= min_cell)
    enough = full | (F.greatest("n_v", "n_s") <= 2)
    best = told.groupBy(*keys).agg(F.coalesce(F.min(F.when(enough, F.col("step"))), F.lit(len(shares) - 1)).alias("step"))
    taken = F.element_at(F.array(*map(F.lit, shares)), F.col("step") + 1).alias("min_share")
    return merged.join(best, [*keys, "step"]).select(*keys, "v", "s", "y", "n", taken)


def collapse_for_occupancy(rows: DataFrame, v: str, s: str, y: str, min_cell: int = 20, shares: tuple[float, ...] = SHARES) -> tuple[DataFrame, dict]:
    """Merge rare levels of v and s by the first of the shares under which every cell of
    the table v x s x y has ``min_cell`` rows or two levels of each are left, else the last.

    Rows are counted once; all shares are tried on the counts, in one aggregation."""
    known = rows.where(F.col(v).isNotNull() & F.col(s).isNotNull() & F.col(y).isNotNull())
    cells = known.groupBy(F.col(v).alias("v"), F.col(s).alias("s"), F.col(y).alias("y")).agg(F.count("*").alias("n")).persist()
    maps = {}
    for side in ("v", "s"):
        found = cells.groupBy(side).agg(F.sum("n").alias("n")).agg(*(rare_levels(side, "n", x).alias(f"m{i}") for i, x in enumerate(shares))).first()
        maps[side] = [dict(m or {}) for m in found]
    tried = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), mapped("v", maps["v"][i]).alias("v"), mapped("s", maps["s"][i]).alias("s")) for i in range(len(shares)))))
    merged = cells.select(tried.alias("t"), "y", "n").groupBy("t.step", "t.v", "t.s", "y").agg(F.sum("n").alias("n"))
    told = merged.groupBy("step").agg(*(F.count_distinct(c).alias(f"n_{c}") for c in ("v", "s", "y")), F.count("*").alias("cells"), F.min("n").alias("least"))
    least = F.when(F.col("cells") == F.col("n_v") * F.col("n_s") * F.col("n_y"), F.col("least")).otherwise(0)
    enough = (least >= min_cell) | (F.greatest("n_v", "n_s") <= 2)
    best = told.select("step", "n_v", "n_s", least.alias("least"), enough.alias("enough")).orderBy(F.desc("enough"), F.when(F.col("enough"), F.col("step")).otherwise(-F.col("step"))).first()
    cells.unpersist()
    i, shape, smallest = (best["step"], [best["n_v"], best["n_s"]], best["least"]) if best else (len(shares) - 1, [0, 0], 0)
    out = rows.withColumn(v, mapped(v, maps["v"][i])).withColumn(s, mapped(s, maps["s"][i]))
    return out, {"min_share": shares[i], "min_cell": smallest, "v_map": maps["v"][i], "s_map": maps["s"][i], "levels": shape}
