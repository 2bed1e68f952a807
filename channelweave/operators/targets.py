"""Binary outcomes per entity: two-way flags, three-way classes, and bucket contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.functions.columns import contrast, finite, flag


def age_target(age: str = "anchor_age", least: float = 65) -> F.Column:
    """1 from the age on, else 0, also where it is unknown."""
    return flag(finite(F.col(age).cast("double")) >= least)


def two_way(column: str, value) -> F.Column:
    """1 for the value, else 0; there is no unknown class."""
    return flag(F.col(column) == value)


def three_way(column: str, one, zero) -> F.Column:
    """1 and 0 for two values, null for all others."""
    return contrast(F.col(column), zero, one)


def bucket_contrast(rows: DataFrame, raw: str, buckets: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """rows with the bucket of a raw category (``buckets``: raw, bucket; unmapped is
    null) and 0 for bucket a, 1 for b, null for any other."""
    dim = buckets.select(F.col(buckets.columns[0]).alias("_raw"), F.col(buckets.columns[1]).alias("bucket"))
    out = rows.join(dim, F.col(raw) == F.col("_raw"), "left").drop("_raw")
    return out.withColumn(into, contrast(F.col("bucket"), a, b))


def excluded_counts(rows: DataFrame, raw: str, target: str) -> DataFrame:
    """How many rows of each raw category have no target, most first."""
    return rows.where(F.col(target).isNull()).groupBy(raw).agg(F.count("*").alias("n")).orderBy(F.desc("n"), raw)


def demographic_targets(cohort: DataFrame, key: str, buckets: DataFrame, contrast_of: tuple[str, str], single_site: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, gender_female, age_ge65, race_binary) and the raw categories left out.

    The single-site gender is two-way (unknown is 0), the multi-site one three-way."""
    raw = "race" if single_site else "ethnicity"
    female = two_way("gender", "F") if single_site else three_way("gender", "Female", "Male")
    rows = bucket_contrast(cohort, raw, buckets, *contrast_of, "race_binary")
    rows = rows.withColumn("gender_female", female).withColumn("age_ge65", age_target("anchor_age" if single_site else "age"))
    return rows.select(key, "gender_female", "age_ge65", "race_binary"), excluded_counts(rows, raw, "race_binary")
