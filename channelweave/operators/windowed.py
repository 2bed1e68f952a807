"""Measurements within a window around each entity's anchor, and the first and last of
each kind. Both are single passes: an equi-join with the range as its residual, and one
aggregation with partial results instead of two opposite sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelweave.functions.columns import hours_between, present


def window_join(
    events: DataFrame, cohort: DataFrame, on: str, time: str, start: Column | str = "t_win_start", end: Column | str = "t_win_end", closed: bool = False, tolerant: tuple[str, str] | None = None
) -> DataFrame:
    """events with the cohort's columns, where time is in [start, end), or [start, end]
    if ``closed``. Bounds are columns of the cohort by name, or expressions of those ("c.x"),
    which are worked out at the join and not shuffled. ``tolerant`` names an event's and a
    cohort's column that must agree where the event's is known."""
    e, c = events.alias("e"), cohort.alias("c")
    t = F.col(f"e.{time}")
    low, high = (x if isinstance(x, Column) else F.col(f"c.{x}") for x in (start, end))
    inside = (F.col(f"e.{on}") == F.col(f"c.{on}")) & (t >= low)
    inside &= (t <= high) if closed else (t < high)
    if tolerant:
        inside &= F.col(f"e.{tolerant[0]}").isNull() | (F.col(f"e.{tolerant[0]}") == F.col(f"c.{tolerant[1]}"))
    own = [x for x in cohort.columns if x not in events.columns]
    return e.join(c, inside).select("e.*", *(f"c.{x}" for x in own))


def offset_window(events: DataFrame, cohort: DataFrame | None, on: str, offset: str, minutes: int = 1440) -> DataFrame:
    """events of cohort entities whose offset in minutes is within plus or minus
    ``minutes``, both included, with the offset in hours. Without a cohort all events
    are of its entities already."""
    inside = events.where(F.col(offset).between(-minutes, minutes))
    return (inside if cohort is None else inside.join(cohort.select(on), on)).withColumn("hours_from_t0", F.col(offset) / F.lit(60.0))


def labs_window(labevents: DataFrame, cohort: DataFrame) -> DataFrame:
    """Lab results of cohort patients in [t_win_start, t_win_end); a result with another
    admission's id is left out."""
    keys = cohort.select("subject_id", F.col("hadm_id").alias("_hadm"), "stay_id", "t0", "t_win_start", "t_win_end")
    rows = window_join(labevents, keys, "subject_id", "charttime", tolerant=("hadm_id", "_hadm"))
    return rows.select(
        "subject_id", F.col("_hadm").alias("hadm_id"), "stay_id", "t0", "specimen_id", "itemid", "charttime", "valuenum", "ref_range_lower", "ref_range_upper", "flag", "priority", "order_provider_id",
        hours_between("t0", "charttime").alias("hours_from_t0"),
    )


def first_last(events: DataFrame, keys: list[str], value: str, time: str, tie: Column | str) -> DataFrame:
    """value_first, time_first, value_last, time_last of each key by (time, tie).

    Rows without a value (null or NaN) don't count; the value itself is never looked at
    to choose. One row is first and last. Keys without rows have none."""
    rows = events.where(present(F.col(value)).isNotNull())
    order = F.struct(F.col(time), tie if isinstance(tie, Column) else F.col(tie))
    picked = F.struct(F.col(value).alias("v"), F.col(time).alias("t"))
    out = rows.groupBy(*keys).agg(F.min_by(picked, order).alias("a"), F.max_by(picked, order).alias("z"))
    return out.select(*keys, F.col("a.v").alias("value_first"), F.col("a.t").alias("time_first"), F.col("z.v").alias("value_last"), F.col("z.t").alias("time_last"))
