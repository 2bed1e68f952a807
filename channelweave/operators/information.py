"""Information measures on count tables: one aggregation of the rows, then sums of it.

A table of counts has key columns (the cells of a study), v, s, y and n. Every measure
groups by the keys, so all cells of a study are one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelweave.functions.columns import binary_entropy, xlnx


def joint_counts(rows: DataFrame, keys: list[str], v: str = "v", s: str = "s", y: str = "y") -> DataFrame:
    """keys, v, s, y, n of the observed cells; rows with a null in v, s or y are left out."""
    known = rows.where(F.col(v).isNotNull() & F.col(s).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*keys, F.col(v).alias("v"), F.col(s).alias("s"), F.col(y).alias("y")).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, keys: list[str]) -> DataFrame:
    """With a row also for each combination of observed levels that does not occur.

    The grid is built from arrays of levels per key: levels are few, rows are not read."""
    sets = counts.groupBy(*keys).agg(*(F.collect_set(c).alias(f"_{c}") for c in ("v", "s", "y")))
    grid = sets.select(*keys, F.explode("_v").alias("v"), "_s", "_y").select(*keys, "v", F.explode("_s").alias("s"), "_y").select(*keys, "v", "s", F.explode("_y").alias("y"))
    return grid.join(counts, [*keys, "v", "s", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def marginal(counts: DataFrame, keys: list[str], over: list[str]) -> DataFrame:
    return counts.groupBy(*keys, *over).agg(F.sum("n").alias("n"))


def occupancy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """min_cell, n_cells, n_empty_cells of the dense table, and n."""
    return dense(counts, keys).groupBy(*keys).agg(F.min("n").alias("min_cell"), F.count("*").alias("n_cells"), F.count_if(F.col("n") == 0).alias("n_empty_cells"), F.sum("n").alias("n"))


def mutual_information(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, in nats: i_val = I(v;y), i_str = I(s;y), i_joint = I(v,s;y), h_y and n,
    and the same with the Miller-Madow correction (``_mm``).

    One grouping-sets aggregation gives all margins; entropies are sums over each."""
    sets = {"v": ["v"], "s": ["s"], "y": ["y"], "vs": ["v", "s"], "vy": ["v", "y"], "sy": ["s", "y"], "vsy": ["v", "s", "y"]}
    at = F.array(*(F.struct(F.lit(name).alias("m"), F.concat_ws("|", *(F.col(c).cast("string") if c in cols else F.lit("") for c in ("v", "s", "y"))).alias("c")) for name, cols in sets.items()))
    margins = counts.where("n > 0").select(*keys, F.explode(at).alias("x"), "n").groupBy(*keys, "x").agg(F.sum("n").alias("n"))
    parts = []
    for name in sets:
        own = F.when(F.col("x.m") == name, F.col("n"))
        # H = ln N - sum n ln n / N
        parts += [F.sum(xlnx(own.cast("double"))).alias(f"t_{name}"), F.count(own).alias(f"k_{name}")]
    sums = margins.groupBy(*keys).agg(F.sum(F.when(F.col("x.m") == "y", F.col("n"))).alias("n"), *parts)
    h = lambda name: F.ln("n") - F.col(f"t_{name}") / F.col("n")
    mm = lambda name: (F.col(f"k_{name}") - 1) / (F.lit(2.0) * F.col("n"))
    out = {}
    for into, x, xy in (("i_val", "v", "vy"), ("i_str", "s", "sy"), ("i_joint", "vs", "vsy")):
        out[into] = h(x) + h("y") - h(xy)
        out[f"{into}_mm"] = out[into] + mm(x) + mm("y") - mm(xy)
    return sums.select(*keys, "n", h("y").alias("h_y"), *(c.alias(name) for name, c in out.items()))


def entropy_share(mi: Column, prevalence: Column) -> Column:
    """Information as percent of the outcome's entropy; null if that is 0."""
    return F.try_divide(mi * 100, binary_entropy(prevalence))


def mmi_atoms(i_val: Column, i_str: Column, i_joint: Column) -> dict[str, Column]:
    """Atoms with the smaller node as redundancy; its unique atom is 0 by definition."""
    red = F.least(i_val, i_str)
    return {"red": red, "u_val": i_val - red, "u_str": i_str - red, "syn": i_joint - i_val - i_str + red}


def average_ranks(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, column, value, u): u is the average rank over n + 1.

    Ranks come from counts by value: a sum over sorted values is taken by ranges of
    quantiles first, so no column's rows pass through one task. The ranges' ends (63 numbers
    a column) are found by a job of their own: approximate quantiles depend on the order in
    which parts arrive, and both sums have to be by the same ranges."""
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(key, "x.*").where("value IS NOT NULL")
    by_value = long.groupBy("column", "value").agg(F.count("*").alias("c"))
    found = by_value.groupBy("column").agg(F.percentile_approx("value", F.array(*(F.lit(i / 64) for i in range(1, 64))), F.lit(1000)).alias("cuts")).collect()
    cuts = rows.sparkSession.createDataFrame(found, "column string, cuts array<double>")
    placed = by_value.join(F.broadcast(cuts), "column").withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("value")))).drop("cuts")  # a row for each column
    sums = placed.groupBy("column", "part").agg(F.sum("c").alias("m"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("column", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy("column")).alias("total"))
    before = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("less", F.coalesce(F.sum("c").over(before), F.lit(0))).join(base, ["column", "part"])
    u = (F.col("base") + F.col("less") + (F.col("c") + 1) / F.lit(2.0)) / (F.col("total") + 1)
    return long.join(ranked.select("column", "value", u.alias("u")), ["column", "value"]).select(key, "column", "value", "u")
