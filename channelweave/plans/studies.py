"""Study designs: sweeps, sites, pooling, trends, variance; all as plans over a table of
tasks or of results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.functions.decompose import ATOMS
from channelweave.functions.special import f_survival, t_two_sided
from channelweave.operators import clusters, quantize
from channelweave.operators.information import joint_counts, mutual_information
from channelweave.plans.pid import decompose


def codebook(rows: DataFrame, key: str, values: list[str], times: list[str], k: int, seed: int, n_init: int = 10, targets: tuple[str, ...] = (), sentinel: float | None = None) -> DataFrame:
    """key, v, s and the targets: levels fitted once on all rows, and used by every target."""
    blocks = {"v": clusters.Block(values), "s": clusters.Block(times, sentinel)}
    points = clusters.prepare(rows, [key], blocks)
    fits = clusters.fit_many(points, [clusters.Spec(b, k, seed, i) for b in blocks for i in range(n_init)])
    for fit in clusters.by_size(points, clusters.best_starts(fits)):
        rows = clusters.with_level(rows, blocks[fit.spec.block], points.centre[fit.spec.block], fit, fit.spec.block)
    return rows.select(key, "v", "s", *targets)


def by_target(levels: DataFrame, targets: list[str], keys: list[str]) -> DataFrame:
    """Long form: keys, target, v, s, y with a row for each known target."""
    each = F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y")) for t in targets))
    return levels.select(*keys, "v", "s", F.explode(each).alias("t")).select(*keys, "v", "s", "t.*").where("y IS NOT NULL")


def headline(levels: DataFrame, targets: list[str], keys: list[str], measures: tuple[str, ...] = ("broja", "ccs")) -> DataFrame:
    """Every cell (keys, target) by every measure."""
    counts = joint_counts(by_target(levels, targets, keys), [*keys, "target"])
    parts = [decompose(counts, [*keys, "target"], m).withColumn("measure", F.lit(m)) for m in measures]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_gate(cells: DataFrame, counts: DataFrame, keys: list[str], most: int = 1000, seed: int = 0, level: float = 0.05) -> DataFrame:
    """A headline with each cell's gate: p, gate_pass and n_used of its joint information,
    which is the same for every measure. ``counts`` are the headline's tables."""
    from channelweave.plans.resample import sequential_gate

    observed = mutual_information(counts, keys).select(*keys, "i_joint")
    return cells.join(sequential_gate(counts, keys, observed, most, seed=seed, level=level).select(*keys, "p", "gate_pass", "n_used"), keys, "left")


def across(cells: DataFrame, database: str, by: list[str], first: str, second: str) -> DataFrame:
    """Two databases of a headline side by side: each atom's percentage in both, the gap
    (first less second) of each, and the atom whose gap is largest; a row for each cell
    that either has. A cell without joint information has nulls."""
    shares = [F.first(f"{a}_pct").alias(a) for a in ATOMS]
    wide = cells.groupBy(*by).pivot(database, [first, second]).agg(*shares)
    gaps = {f"gap_{a}": F.col(f"{first}_{a}") - F.col(f"{second}_{a}") for a in ATOMS}
    out = wide.select(*by, *(F.col(f"{x}_{a}").alias(f"{n}_{a}") for n, x in (("first", first), ("second", second)) for a in ATOMS), *(c.alias(n) for n, c in gaps.items()))
    largest = F.array_max(F.array(*(F.struct(F.abs(f"gap_{a}").alias("d"), F.lit(a).alias("a")) for a in ATOMS)))
    return out.withColumn("most_apart", F.when(largest["d"].isNotNull(), largest["a"]))


def sweep_tables(rows: DataFrame, key: str, values: list[str], times: list[str], y: str, ks: list[int], seeds: list[int], n_init: int = 10, sentinel: float | None = None) -> DataFrame:
    """k, seed, arm, v, s, y, n: count tables over numbers of levels and seeds, with levels
    as fitted and with rare ones collapsed. All models share their passes over the rows;
    nothing after the count tables depends on the number of rows."""
    points = clusters.prepare(rows, [key], {"v": clusters.Block(values), "s": clusters.Block(times, sentinel)}, (y,))
    specs = [clusters.Spec(b, k, seed, i) for b in ("v", "s") for k in ks for seed in seeds for i in range(n_init)]
    pairs = clusters.pairs_of(clusters.by_size(points, clusters.best_starts(clusters.fit_many(points, specs))), "v", "s")
    names = rows.sparkSession.createDataFrame([(m, v.spec.k, v.spec.seed) for m, (v, _) in enumerate(pairs)], "model int, k int, seed int")
    fixed = clusters.joint_tables(points, pairs).join(names, "model").select("k", "seed", "v", "s", "y", "n").persist()
    collapsed = quantize.collapse_counts(fixed, ["k", "seed"]).drop("min_share")
    arms = fixed.withColumn("arm", F.lit("fixed")).unionByName(collapsed.withColumn("arm", F.lit("collapse")))
    return arms.select("k", "seed", "arm", "v", "s", "y", "n")


def k_sweep(rows: DataFrame, key: str, values: list[str], times: list[str], y: str, ks: list[int], seeds: list[int], n_init: int = 10, measure: str = "broja", sentinel: float | None = None) -> DataFrame:
    """Decompositions of ``sweep_tables``; one solve for each, all in one plan."""
    # tables are small and solves are not: a fixed number of tasks is not merged by size
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return decompose(sweep_tables(rows, key, values, times, y, ks, seeds, n_init, sentinel).repartition(spread, "k", "seed", "arm"), ["k", "seed", "arm"], measure)


def sweep_spread(sweep: DataFrame) -> DataFrame:
    """Per k and arm: mean and population deviation of each atom's percentage over
    seeds, the largest deviation, and how many solves failed."""
    shares = [F.when(~F.isnan(f"{a}_pct"), F.col(f"{a}_pct")) for a in ATOMS]
    out = sweep.groupBy("k", "arm").agg(
        *(F.avg(x).alias(f"{a}_mean") for a, x in zip(ATOMS, shares, strict=True)), *(F.stddev_pop(x).alias(f"{a}_sd") for a, x in zip(ATOMS, shares, strict=True)), F.count_if(~F.col("converged")).alias("n_failed")
    )
    return out.withColumn("worst_sd", F.greatest(*(f"{a}_sd" for a in ATOMS)))


def collapse_verdict(spread: DataFrame) -> DataFrame:
    """Fixed against collapsed levels by k: shift of synergy (over 1 counts), which spreads
    more, the first k that shifts, and the k at which the fixed levels spread least."""
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(0))  # a row for each k
    wide = spread.groupBy("k").pivot("arm", ["fixed", "collapse"]).agg(F.first("syn_mean").alias("syn"), F.first("worst_sd").alias("sd"))
    shift = F.col("collapse_syn") - F.col("fixed_syn")
    wide = wide.select("k", "fixed_syn", "collapse_syn", "fixed_sd", shift.alias("shift"), (F.abs(shift) > 1).alias("shifted"), (F.col("collapse_sd") > F.col("fixed_sd")).alias("spreads_more"))
    first = F.min(F.when(F.col("shifted"), F.col("k"))).over(every)
    least = F.min(F.struct("fixed_sd", "k")).over(every)["k"]
    return wide.withColumns({"first_shift": F.coalesce(F.col("k") == first, F.lit(False)), "least_spread": F.col("k") == least}).drop("fixed_sd")


def eligible_sites(rows: DataFrame, site: str, ms: list[int], total: int, by: list[str]) -> DataFrame:
    """by, m: how many sites have at least total // m rows, and whether that is m or more."""
    sizes = rows.groupBy(*by, site).count()
    out = sizes.select(*by, "count", F.explode(F.array(*map(F.lit, ms))).alias("m"))
    out = out.groupBy(*by, "m").agg(F.count_if(F.col("count") >= F.floor(F.lit(total) / F.col("m"))).alias("n_eligible"))
    return out.withColumn("enough", F.col("n_eligible") >= F.col("m"))


def within_sites(levels: DataFrame, site: str, key: str, least: int, draws: int = 5, seed: int = 0, measure: str = "broja") -> DataFrame:
    """Each large site's decomposition, and the mean of ``draws`` random sets of exactly
    as many rows of all sites: site, n, in_<atom>, rand_<atom> (percent of the joint).

    The rows are counted once; sets are drawn from the table of counts, each with its
    own seed, so sets of a site and a draw are independent of all others. ``key`` is
    not needed for it and kept for callers."""
    from channelweave.plans.resample import sampled_counts

    counts = joint_counts(levels, [site]).persist()
    sizes = counts.groupBy(site).agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    own = decompose(counts.join(sizes.select(site), site), [site], measure).select(site, "n", *(F.col(f"{a}_pct").alias(f"in_{a}") for a in ATOMS))
    pooled = counts.groupBy("v", "s", "y").agg(F.sum("n").alias("count"))
    design = sizes.select(site, "size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("_seed", F.xxhash64(F.lit(seed), F.col(site), "draw"))
    # every set is drawn from the same few cells: sites x draws x cells rows, whatever the data
    random = sampled_counts(design.crossJoin(pooled), [site, "draw"], "size", "_seed")
    drawn = decompose(random, [site, "draw"], measure)
    mean = drawn.groupBy(site).agg(*(F.avg(F.when(~F.isnan(f"{a}_pct"), F.col(f"{a}_pct"))).alias(f"rand_{a}") for a in ATOMS))
    return own.join(mean, site, "left")


def pooling_effect(within: DataFrame, by: list[str], site: str) -> DataFrame:
    """Atoms within sites and in random sets, averaged by site size; their difference,
    the complement of u_val, and the median size."""
    both = within.where(" AND ".join(f"in_{a} IS NOT NULL AND rand_{a} IS NOT NULL" for a in ATOMS))
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n"))
    parts = []
    for a in ATOMS:
        parts += [mean(f"in_{a}").alias(f"within_{a}"), mean(f"rand_{a}").alias(f"random_{a}"), (mean(f"in_{a}") - mean(f"rand_{a}")).alias(f"delta_{a}")]
    out = both.groupBy(*by).agg(F.count(site).alias("n_sites"), F.median("n").cast("int").alias("median_n"), *parts)
    return out.withColumn("within_non_value", 100 - F.col("within_u_val")).withColumn("random_non_value", 100 - F.col("random_u_val"))


def gap_closed(pooled: DataFrame, within: DataFrame, other: DataFrame, by: list[str], column: str, least: float = 2.0) -> DataFrame:
    """How much of the gap between two databases conditioning on sites closes; null where
    the gap is under ``least``."""
    a = pooled.select(*by, F.col(column).alias("pooled")).join(within.select(*by, F.col(column).alias("within")), by).join(other.select(*by, F.col(column).alias("other")), by)
    gap = F.col("other") - F.col("pooled")
    return a.withColumn("gap", gap).withColumn("closed", F.when(F.abs(gap) >= least, (F.col("within") - F.col("pooled")) / gap))


def dose_sets(counts: DataFrame, site: str, ms: list[int], total: int, draws: int, seed: int = 0, target: str = "y") -> DataFrame:
    """m, draw, site, v, s, y, n: for each m and draw, m large enough sites and of each
    exactly total // m rows, drawn from ``counts`` (site, v, s, y, n). A m without m such
    sites is skipped.

    Sites are ranked by a hash of target, m, draw and site, and rows drawn in count
    space with a seed from the same, so no two draws share either."""
    from pyspark.sql import Window

    from channelweave.plans.resample import sampled_counts

    sizes = counts.groupBy(site).agg(F.sum("n").alias("size")).where(F.col(site).isNotNull())
    grid = [F.struct(F.lit(m).alias("m"), F.lit(d).alias("draw"), F.lit(total // m).alias("take")) for m in ms for d in range(draws)]
    able = sizes.select(site, "size", F.explode(F.array(*grid)).alias("g")).select(site, "size", "g.*").where("size >= take AND take > 0")
    mark = F.xxhash64(F.lit(f"{seed}|{target}"), "m", "draw", F.col(site))
    each = Window.partitionBy("m", "draw")
    able = able.withColumns({"_seed": mark, "_n": F.count("*").over(each), "_rank": F.row_number().over(each.orderBy(mark, F.col(site)))})
    design = able.where("_n >= m AND _rank <= m").select(site, "m", "draw", "take", "_seed")
    return sampled_counts(counts.withColumnRenamed("n", "count").join(design, site), ["m", "draw", site], "take", "_seed")


def dose_response(levels: DataFrame, site: str, key: str, ms: list[int], total: int, draws: int, seed: int = 0, target: str = "y", measure: str = "broja") -> DataFrame:
    """m sites with total // m rows each, drawn anew ``draws`` times: target, m, draw, n,
    n_sites, atoms in percent. Rows are counted once (see ``dose_sets``); ``key`` is not
    needed for it and kept for callers."""
    picked = dose_sets(joint_counts(levels, [site]), site, ms, total, draws, seed, target)
    sites = picked.groupBy("m", "draw").agg(F.count_distinct(site).alias("n_sites"))
    counts = picked.groupBy("m", "draw", "v", "s", "y").agg(F.sum("n").alias("n"))
    found = decompose(counts, ["m", "draw"], measure)
    return found.join(sites, ["m", "draw"]).select(F.lit(target).alias("target"), "m", "draw", "n", "n_sites", *(F.col(f"{a}_pct").alias(a) for a in ATOMS))


def trend(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope of y on log2(x) with its p-value, Spearman's rho with its p-value, the first
    and last mean, and the percentage removed (null if the first mean is 0)."""
    from pyspark.sql import Window

    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y)).withColumn("_x", F.log2(x))
    avg_rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)
    ranked = known.withColumn("_rx", avg_rank("_x")).withColumn("_ry", avg_rank(y))
    fit = ranked.groupBy(*by).agg(
        F.count("*").alias("n_points"), F.regr_slope(y, "_x").alias("slope"), F.corr(y, "_x").alias("_r"), F.corr("_rx", "_ry").alias("rho"), F.count_distinct(x).alias("n_x")
    )
    means = known.groupBy(*by, x).agg(F.avg(y).alias("_m"))
    ends = means.groupBy(*by).agg(F.min_by("_m", x).alias("first_mean"), F.max_by("_m", x).alias("last_mean"))

    @F.pandas_udf("double")
    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        def one(r, n):
            if n < 3 or r is None or math.isnan(r):
                return math.nan
            return t_two_sided(math.inf if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

        return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)])

    out = (fit.join(ends, by) if by else fit.crossJoin(ends)).withColumn("slope_p", p_of("_r", "n_points")).withColumn("rho_p", p_of("rho", "n_points"))
    removed = F.when(F.col("first_mean") != 0, (F.col("first_mean") - F.col("last_mean")) / F.col("first_mean") * 100)
    return out.withColumn("pct_removed", removed).drop("_r")


def truncated_trends(rows: DataFrame, by: list[str], x: str, y: str, starts: list[int], least: int = 3) -> DataFrame:
    """The trend over x >= start, for several starts that leave ``least`` distinct x."""
    cut = rows.select("*", F.explode(F.array(*map(F.lit, starts))).alias("start")).where(F.col(x) >= F.col("start"))
    return trend(cut, [*by, "start"], x, y).where(F.col("n_x") >= least).withColumn("falling", F.col("slope") < 0)


def trend_verdict(trends: DataFrame, by: list[str], level: float = 0.05) -> DataFrame:
    """Falls for every start, for some, or for none; significant everywhere or not."""
    out = trends.groupBy(*by).agg(F.bool_and("falling").alias("all_falling"), F.bool_or("falling").alias("any_falling"), F.bool_and(F.col("slope_p") < level).alias("all_significant"))
    return out.withColumn("verdict", F.when(F.col("all_falling") & F.col("all_significant"), "robust").when(F.col("any_falling"), "sensitive").otherwise("absent"))


def two_way_anova(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Balanced two-way analysis with replication: source, ss, df, pct, f, p.

    Two aggregations of the rows. Unbalanced data are computed with the smallest cell's
    count as the design's, and ``balanced`` says so."""
    cells = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(a, b).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    side = lambda c: cells.groupBy(c).agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias(f"m_{c}"))
    grand = cells.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"), F.count_distinct(a).alias("na"), F.count_distinct(b).alias("nb"), F.min("n").alias("r"), F.max("n").alias("most"))
    full = cells.join(side(a), a).join(side(b), b).crossJoin(F.broadcast(grand))  # one row
    sq = lambda c: F.sum(c * c * F.col("n"))
    both = F.col("m") - F.col(f"m_{a}") - F.col(f"m_{b}") + F.col("g")
    one = full.agg(
        sq(F.col(f"m_{a}") - F.col("g")).alias("s0"), sq(F.col(f"m_{b}") - F.col("g")).alias("s1"), sq(both).alias("s2"), F.sum(F.col("v") * F.col("n")).alias("s3"),
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("n").alias("n"), (F.first("r") == F.first("most")).alias("balanced"),
    )
    df = [F.col("na") - 1, F.col("nb") - 1, (F.col("na") - 1) * (F.col("nb") - 1), F.col("n") - F.col("na") * F.col("nb")]
    rows_ = F.array(*(F.struct(F.lit(name).alias("source"), F.col(f"s{i}").alias("ss"), df[i].cast("long").alias("df")) for i, name in enumerate((a, b, "interaction", "residual"))))
    total = sum((F.col(f"s{i}") for i in range(4)), F.lit(0.0))
    out = one.select(F.explode(rows_).alias("x"), total.alias("total"), F.try_divide(F.col("s3"), df[3]).alias("ms"), df[3].cast("long").alias("dr"), "balanced").select("x.*", "total", "ms", "dr", "balanced")
    f = F.when(F.col("source") != "residual", F.try_divide(F.try_divide(F.col("ss"), F.col("df")), F.col("ms")))

    @F.pandas_udf("double")
    def survival(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else f_survival(x, i, j) for x, i, j in zip(f, d1, d2, strict=True)], dtype=float)

    return out.select("source", "ss", "df", F.try_divide(F.col("ss") * 100, F.col("total")).alias("pct"), f.alias("f"), "balanced", "dr").withColumn("p", survival("f", "df", "dr")).drop("dr")


def main_effects(rows: DataFrame, a: str, b: str, value: str, first, second) -> DataFrame:
    """Per b: the means of the two a's, their gap, and how far seeds spread."""
    cells = rows.groupBy(a, b).agg(F.avg(value).alias("m"), (F.max(value) - F.min(value)).alias("span"))
    pick = lambda v, c: F.max(F.when(F.col(a) == v, F.col(c)))
    out = cells.groupBy(b).agg(pick(first, "m").alias("first_mean"), pick(second, "m").alias("second_mean"), F.max("span").alias("seed_span"))
    return out.withColumn("gap", F.col("first_mean") - F.col("second_mean"))


def most_and_least(rows: DataFrame, label: str, value: str) -> DataFrame:
    """The labels of the smallest and the largest value; the first of equals by label."""
    return rows.agg(F.min_by(label, F.struct(F.col(value), F.col(label))).alias("least"), F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("most"))


def site_information(rows: DataFrame, site: str, v: str = "v", s: str = "s", y: str = "y") -> DataFrame:
    """Plug-in and corrected information of each site, in one plan and without a kernel."""
    return mutual_information(joint_counts(rows, [site], v, s, y), [site])
