"""The value channel and the structure (time) channel: long to wide, complete cases,
imputation, and swapping the outcome."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.functions.columns import SENTINEL, finite, present
from channelweave.operators.imputation import chained
from channelweave.sources.tables import stored

VALUES, TIMES = ("value_first", "value_last"), ("time_first", "time_last")


@dataclass(frozen=True)
class Channels:
    """Rows with a key, value columns, structure columns and the outcome ``y``."""

    rows: DataFrame
    key: str
    values: tuple[str, ...]
    times: tuple[str, ...]
    meta: dict = field(default_factory=dict)


def audit(values: list[str], times: list[str]) -> None:
    """Value columns hold values, structure columns times, and none is in both."""
    if bad := [c for c in values if not c.endswith(VALUES)]:
        raise ValueError(f"not value columns: {bad}")
    if bad := [c for c in times if not c.endswith(TIMES)]:
        raise ValueError(f"not time columns: {bad}")
    if both := set(values) & set(times):
        raise ValueError(f"in both channels: {sorted(both)}")


def build_wide(paired: DataFrame, cohort: DataFrame, key: str, kind: str, names: dict) -> DataFrame:
    """One row per cohort row with four columns for each kind in ``names`` (kind ->
    column name), null where it was never measured. One shuffle: pivot with given
    values, then a left join on the same key."""
    kinds = sorted(names)
    picks = [F.first(c).alias(c) for c in (*VALUES, *TIMES)]
    wide = paired.where(F.col(kind).isin(kinds)).groupBy(key).pivot(kind, kinds).agg(*picks)
    wide = wide.select(key, *(F.col(f"`{k}_{c}`").alias(f"{names[k]}_{c}") for k in kinds for c in (*VALUES, *TIMES)))
    return cohort.join(wide, key, "left")


def channel_columns(names: dict) -> tuple[list[str], list[str]]:
    values = [f"{names[k]}_{c}" for k in sorted(names) for c in VALUES]
    times = [f"{names[k]}_{c}" for k in sorted(names) for c in TIMES]
    audit(values, times)
    return values, times


def complete_case(wide: DataFrame, key: str, names: dict, target: str) -> Channels:
    """Rows with every value and time (infinities count) and a known target."""
    values, times = channel_columns(names)
    whole = [present(F.col(c)).isNotNull() for c in (*values, *times)]
    rows = wide.where(F.col(target).isNotNull()).where(F.array_min(F.array(*whole)))
    rows = rows.select(key, *values, *times, F.col(target).cast("int").alias("y"))
    return Channels(rows, key, tuple(values), tuple(times), {"arm": "complete_case", "scope": sorted(names), "target": target})


def arm_meta(arm: Channels, wide: DataFrame) -> DataFrame:
    """n, n_dropped, drop_rate and prevalence, in one row."""
    kept = arm.rows.agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"))
    out = wide.agg(F.count("*").alias("total")).crossJoin(kept)  # one row each
    return out.select("n", (F.col("total") - F.col("n")).alias("n_dropped"), (F.lit(1.0) - F.try_divide("n", "total")).alias("drop_rate"), "prevalence")


def impute(wide: DataFrame, key: str, names: dict, target: str, method: str = "mean") -> Channels:
    """Every row with a known target. A missing time is the sentinel; a missing value is
    its column's mean ("mean"; taken over all but NaN), or a regression on the other
    values ("mice"). Structure never predicts values. The rows are written first, so their
    plan runs once."""
    values, times = channel_columns(names)
    if method not in ("mean", "mice"):
        raise ValueError(f"unknown method: {method!r}")
    rows = wide.where(F.col(target).isNotNull()).select(
        key, *values, *(F.coalesce(finite(F.col(c)), F.lit(SENTINEL)).alias(c) for c in times), F.col(target).cast("int").alias("y")
    )
    rows = stored(rows, "impute")  # read for the statistics and again for the result
    rows = mean_filled(rows, values) if method == "mean" else chained(rows, values)
    return Channels(rows, key, tuple(values), tuple(times), {"arm": f"impute_{method}", "scope": sorted(names), "target": target})


def mean_filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers by column means; a column without numbers gets 0."""
    means = rows.agg(*(F.avg(present(F.col(c))).alias(c) for c in columns)).first()
    return rows.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(0.0 if means[c] is None else float(means[c]))) for c in columns})


def retarget(arm: Channels, outcome: DataFrame, target: str) -> Channels:
    """The same rows and channels with another outcome (key, target); rows without one
    are dropped. Keys of the outcome must be unique."""
    y = outcome.select(arm.key, F.col(target).cast("int").alias("y"))
    twice = y.groupBy(arm.key).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("the outcome's keys are not unique")
    rows = arm.rows.drop("y").join(y.where("y IS NOT NULL"), arm.key)
    return Channels(rows, arm.key, arm.values, arm.times, {**arm.meta, "base_arm": arm.meta.get("arm"), "target": target})
