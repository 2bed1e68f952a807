"""Cohorts: the first episode of each entity, in both orders of ranking and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelweave.functions.columns import topcoded_number


def first_episode(episodes: DataFrame, entity: str, order: list[str], eligible: Column | None = None) -> DataFrame:
    """The first row of each entity among those that are ``eligible`` (all without one),
    nulls first. A later filter of the result drops entities whose first row fails it:
    that is the other order."""
    rows = episodes if eligible is None else episodes.where(eligible)
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def anchored(cohort: DataFrame, anchor: str, before: str = "24 HOURS", after: str = "24 HOURS") -> DataFrame:
    """t_win_start and t_win_end around each row's anchor."""
    return cohort.withColumn("t_win_start", F.expr(f"{anchor} - INTERVAL {before}")).withColumn("t_win_end", F.expr(f"{anchor} + INTERVAL {after}"))


def single_site_cohort(icustays: DataFrame, patients: DataFrame, admissions: DataFrame, least_age: int = 18) -> DataFrame:
    """First stay of each patient, then the age gate: a patient whose first stay has no
    admission, or who was too young, has none."""
    first = first_episode(icustays, "subject_id", ["intime", "stay_id"])
    first = first.select("subject_id", "hadm_id", "stay_id", F.col("intime").alias("t0"), "outtime", F.col("los").alias("icu_los_days"))
    rows = first.join(patients.select("subject_id", "anchor_age", "gender", "dod"), "subject_id")
    rows = rows.join(admissions.select("hadm_id", "hospital_expire_flag", "admission_type", "race"), "hadm_id").where(F.col("anchor_age") >= least_age)
    return anchored(rows, "t0").select(
        "subject_id", "hadm_id", "stay_id", "t0", "t_win_start", "t_win_end", "outtime", "icu_los_days", "anchor_age", "gender", "dod", "hospital_expire_flag", "admission_type", "race"
    )


def multi_site_cohort(patient: DataFrame, least_age: float = 18.0) -> DataFrame:
    """First eligible stay of each person: adults (age is text, top-coded) whose outcome
    is known. Eligibility comes before the rank."""
    rows = patient.withColumn("age", topcoded_number(F.col("age")))
    eligible = (F.col("age") >= least_age) & F.col("hospitaldischargestatus").isin("Alive", "Expired")
    first = first_episode(rows, "uniquepid", ["hospitaldischargeyear", "unitvisitnumber", "patientunitstayid"], eligible)
    expired = F.when(F.col("hospitaldischargestatus") == "Expired", 1).otherwise(0)
    return first.select("patientunitstayid", "patienthealthsystemstayid", "uniquepid", "hospitalid", "age", "gender", "ethnicity", expired.alias("hospital_expire_flag"))
