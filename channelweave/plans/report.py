"""The report: result tables joined by cell, and a Markdown page of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = {"red": "redundant", "u_val": "unique to value", "u_str": "unique to structure", "syn": "synergistic"}


def join_results(keys: list[str], headline: DataFrame, **others: DataFrame) -> DataFrame:
    """The headline's cells with the other results' columns, prefixed with their names."""
    out = headline
    for name, df in others.items():
        renamed = df.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys))
        out = out.join(renamed, keys, "left")
    return out


def labelled(df: DataFrame, column: str, labels: dict[str, str] | None = None) -> DataFrame:
    """The column's names for readers; unknown ones stay."""
    pairs = F.create_map(*(F.lit(x) for kv in (labels or LABELS).items() for x in kv))
    return df.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)))


def plus_minus(mean: str, sd: str, digits: int = 1):
    return F.concat(F.format_number(mean, digits), F.lit(" ± "), F.format_number(sd, digits))


def markdown(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    """Small result tables as a page; a table of more than ``most`` rows is an error."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(f"{x:.4g}" if isinstance(x, float) else "" if x is None else str(x) for x in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)


def study_page(keys: list[str], headline: DataFrame, gate: DataFrame, intervals: DataFrame, calibration: DataFrame, sweep: DataFrame, variance: DataFrame, pooling: DataFrame) -> str:
    """The canonical numbers in seven sections, from result tables of a few rows each.

    ``headline`` and the tables joined to it have a row for each of ``keys``; an atom's
    net value is its estimate less the null's mean (all in nats; the share of the joint
    information stands beside them in percent), and it is clear of the null if its
    interval's lower end lies above the null's 95th percentile."""
    cells = join_results(keys, headline, boot=intervals, null=calibration)
    net = [F.round("u_str", 6).alias("estimate"), F.round("u_str_pct", 2).alias("percent"), "boot_u_str_low", "boot_u_str_high", "null_null_mean", F.round(F.col("u_str") - F.col("null_null_mean"), 6).alias("net"), (F.col("boot_u_str_low") > F.col("null_null_p95")).alias("clear")]
    verdict = cells.select(*keys, *net)
    summary = verdict.agg(F.count("*").alias("cells"), F.count_if("clear").alias("clear"), F.bool_and("clear").alias("all_clear"), F.bool_or("clear").alias("any_clear"))
    return markdown(
        "Numbers",
        {
            "1. Cohorts": headline.select(*keys, "n").distinct().orderBy(*keys),
            "2. Gate on the joint information": gate.select(*keys, "observed", "null_mean", "debiased", "p", "gate_pass").orderBy(*keys),
            "3. Composition": verdict.orderBy(*keys),
            "4. Calibration": calibration.orderBy(*keys),
            "5. Resolution": sweep.orderBy(*[c for c in ("k", "arm") if c in sweep.columns]),
            "6. Variance": variance.orderBy(F.desc("pct")),
            "7. Pooling": pooling,
            "Verdict": summary,
        },
    )
