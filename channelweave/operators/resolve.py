"""Which kinds of measurements to use: completeness, roles, shared labels, the config."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE, FLOOR, RANGED = 0.95, 0.02, 0.90


def completeness(rows: DataFrame, entity: str, kind: list[str], base: DataFrame | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """Per kind: n_subj, completeness, n_obs, most complete first; with ``low`` and
    ``high`` also frac_refrange and n_distinct_ranges (pairs with a null don't count).

    The denominator is the number of distinct entities of ``base``'s rows (by default of
    ``rows`` themselves), or for a base with one row per entity its number of rows."""
    total = (rows if base is None else base).agg(F.count_distinct(entity).alias("base_n"))
    extra = []
    if low and high:
        ranged = F.col(low).isNotNull() & F.col(high).isNotNull()
        extra = [(F.count_if(ranged) / F.count("*")).alias("frac_refrange"), F.count_distinct(low, high).alias("n_distinct_ranges")]
    out = rows.groupBy(*kind).agg(F.count_distinct(entity).alias("n_subj"), F.count("*").alias("n_obs"), *extra)
    out = out.crossJoin(F.broadcast(total))  # one row
    cols = [*kind, "n_subj", (F.col("n_subj") / F.col("base_n")).alias("completeness"), "n_obs", *(["frac_refrange", "n_distinct_ranges"] if extra else [])]
    return out.select(*cols).orderBy(F.desc("completeness"), *kind)


def roles(scan: DataFrame, non_analyte: Column, derived: Column, fluid: Column | None = None, blood: str = "Blood", ranged: Column | None = None, core: float = CORE, floor: float = FLOOR) -> DataFrame:
    """``excluded`` (non_analyte before derived before non_blood, null if none; an unknown
    fluid isn't blood) and ``role``: core, discretionary, or null."""
    known = F.coalesce(non_analyte, F.lit(False)), F.coalesce(derived, F.lit(False))
    excluded = F.when(known[0], "non_analyte").when(known[1], "derived")
    if fluid is not None:
        excluded = excluded.when(~fluid.eqNullSafe(blood), "non_blood")
    out = scan.withColumn("excluded", excluded)
    usable = F.col("excluded").isNull()
    is_core = usable & (F.col("completeness") >= core)
    if ranged is not None:
        is_core &= F.coalesce(ranged >= RANGED, F.lit(False))
    return out.withColumn("role", F.when(is_core, "core").when(usable & (F.col("completeness") >= floor), "discretionary"))


def duplicate_labels(dimension: DataFrame, key: str, label: str) -> DataFrame:
    """Labels (lower case, trimmed) that several ids share, with the sorted ids."""
    rows = dimension.where(F.col(label).isNotNull()).groupBy(F.lower(F.trim(label)).alias("label"))
    return rows.agg(F.sort_array(F.collect_set(key)).alias("ids")).where(F.size("ids") > 1)


def excluded_labels(classified: DataFrame, label: str, floor: float = FLOOR) -> DataFrame:
    """Per reason the sorted labels that it leaves out, of those above the floor."""
    rows = classified.where(F.col("excluded").isNotNull() & (F.col("completeness") >= floor))
    return rows.groupBy("excluded").agg(F.sort_array(F.collect_set(label)).alias("labels"))


def resolved_config(classified: DataFrame, key: str, label: str, source: str, duplicates: DataFrame | None = None, core: float = CORE, floor: float = FLOOR) -> dict:
    """The config document: a row for each kind of measurement, so it fits the driver."""
    rows = [r.asDict() for r in classified.orderBy(F.desc("completeness"), key).collect()]
    pick = lambda role: [{key: r[key], label: r[label], "completeness": round(r["completeness"], 4), "n_subj": r["n_subj"]} for r in rows if r["role"] == role]
    return {
        "source": source, "core_threshold": core, "discretionary_floor": floor,
        "n_cohort_with_window_labs": max((r["n_subj"] for r in rows), default=0),
        "core": pick("core"), "discretionary": pick("discretionary"),
        "excluded": {r["excluded"]: r["labels"] for r in excluded_labels(classified, label, floor).collect()},
        "duplicate_label_itemids": {r["label"]: r["ids"] for r in duplicates.collect()} if duplicates is not None else {},
        "enough_core": len(pick("core")) >= 5,
    }
