"""Checks of tables that ride on the job which writes them: no scan is made for a check.

Metrics are observed behind the last shuffle, in the tasks that write. Such a task counts
once, however often it runs; one before a shuffle counts again where a lost executor has
it run again."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from channelweave.functions.columns import present
from channelweave.operators.channels import channel_columns
from channelweave.sources.tables import scratch


class BrokenTable(ValueError):
    """A table that is not what it has to be; ``found`` has the metrics."""

    def __init__(self, message: str, found: dict):
        super().__init__(f"{message}: {found}")
        self.found = found


def written(rows: DataFrame, name: str, /, keep: Column | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """rows, written to the shared folder and read back, and the metrics over all of them.
    Only rows that ``keep`` is true for are written. Counts over no rows are 0 or null."""
    spark, seen = rows.sparkSession, Observation()
    out = rows.observe(seen, *(c.alias(m) for m, c in metrics.items()))
    path = scratch(spark, name)
    (out if keep is None else out.where(keep)).write.parquet(path)
    found = seen.get
    return spark.read.schema(rows.schema).parquet(path), {m: found.get(m) for m in metrics}


def checked_left_join(rows: DataFrame, dimension: DataFrame, on: str, required: list[str]) -> DataFrame:
    """rows with the columns of ``dimension``, one row for each of theirs.

    BrokenTable if a key of rows has several rows in the dimension, or if one of the
    ``required`` columns is null in the result, be it that the dimension lacks the key.
    Rows with a null key have none. Repeated keys that no row asks for do no harm. Columns
    of the same name must not be in both but for the key. Empty in, empty out."""
    new = [c for c in dimension.columns if c != on]
    # the aggregation has the partitioning that the join needs
    once = dimension.groupBy(on).agg(F.first(F.struct(*new)).alias("_found"), F.count("*").alias("_times"))
    out = rows.join(once, on, "left")
    missing = {f"missing_{i}": F.count_if(F.col(f"_found.`{c}`").isNull()) for i, c in enumerate(required)}
    out, found = written(out, "checked-join", repeated=F.count_if(F.col("_times") > 1), **missing)
    told = {"repeated": found["repeated"] or 0} | {c: found[f"missing_{i}"] or 0 for i, c in enumerate(required)}
    if told["repeated"]:
        raise BrokenTable(f"rows whose {on} is not unique in the dimension", told)
    if any(told.values()):
        raise BrokenTable("rows without a required value", told)
    return out.select(*rows.columns, *(F.col(f"_found.`{c}`").alias(c) for c in new))


def complete_arm(wide: DataFrame, key: str, names: dict, target: str) -> tuple[DataFrame, dict]:
    """The rows of ``channels.complete_case``, written, with n_cohort, n, n_dropped,
    drop_rate, prevalence, and target_missing from the same job. Of no rows the rates are
    null."""
    values, times = channel_columns(names)
    whole = F.array_min(F.array(*(present(F.col(c)).isNotNull() for c in (*values, *times)))) & F.col("y").isNotNull()
    rows = wide.select(key, *values, *times, F.col(target).cast("int").alias("y"))
    rows, found = written(
        rows, "complete-arm", whole, n_cohort=F.count("*"), n=F.count_if(whole), prevalence=F.avg(F.when(whole, F.col("y"))), target_missing=F.count_if(F.col("y").isNull())
    )
    total, n = found["n_cohort"] or 0, found["n"] or 0
    rates = {"drop_rate": 1 - n / total if total else None, "prevalence": found["prevalence"]}
    return rows, {"n_cohort": total, "n": n, "n_dropped": total - n, **rates, "target_missing": found["target_missing"] or 0}


def overlaps(rows: DataFrame, key: str, sets: dict[str, Column]) -> DataFrame:
    """For every two of up to 62 sets of keys, given by conditions on rows: a, b, n_a,
    n_b, n_both, disjoint, equal.

    A key is in a set if one of its rows is; null conditions are false, null keys are in
    none. One scan: a key's sets are a word of bits, and keys are counted by word. No keys,
    no rows."""
    if not 2 <= len(sets) <= 62:
        raise ValueError(f"2 to 62 sets, not {len(sets)}")
    bits = reduce(Column.bitwiseOR, (F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(sets.values())))
    words = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or(bits).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pair = lambda i, j: F.struct(F.lit(list(sets)[i]).alias("a"), F.lit(list(sets)[j]).alias("b"), F.lit(1 << i).cast("long").alias("i"), F.lit(1 << j).cast("long").alias("j"))
    pairs = words.select("word", "n", F.explode(F.array(*(pair(i, j) for i, j in combinations(range(len(sets)), 2)))).alias("p")).select("word", "n", "p.*")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    a, b = F.col("word").bitwiseAND(F.col("i")) != 0, F.col("word").bitwiseAND(F.col("j")) != 0
    out = pairs.groupBy("a", "b").agg(of(a).alias("n_a"), of(b).alias("n_b"), of(a & b).alias("n_both"))
    return out.withColumns({"disjoint": F.col("n_both") == 0, "equal": (F.col("n_both") == F.col("n_a")) & (F.col("n_both") == F.col("n_b"))})


def assert_disjoint(rows: DataFrame, key: str, sets: dict[str, Column]) -> None:
    """BrokenTable if two of the sets share a key."""
    shared = {f"{r.a}, {r.b}": r.n_both for r in overlaps(rows, key, sets).where(~F.col("disjoint")).collect()}
    if shared:
        raise BrokenTable("sets share keys", shared)
