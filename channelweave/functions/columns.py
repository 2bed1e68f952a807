"""Column expressions: safe casts, outcome flags and contrasts, names, missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: "Never ordered", for times of imputed arms only.
SENTINEL = -999.0


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def present(c: Column) -> Column:
    """The number, or null if it is NaN; infinities count as present."""
    return F.when(~F.isnan(c), c)


def topcoded_number(c: Column, top: str = "> 89", value: float = 90.0) -> Column:
    """A number written as text: the top code's value, null for blanks and other text."""
    return F.when(c == top, F.lit(value)).when(F.trim(c) == "", None).otherwise(c.try_cast("double"))


def flag(c: Column) -> Column:
    """1 where true, else 0 (also where unknown)."""
    return F.when(c, 1).otherwise(0)


def contrast(c: Column, first, second) -> Column:
    """0 and 1 for two values, null for any other."""
    return F.when(c == first, 0).when(c == second, 1)


def hours_between(start: str, end: str) -> Column:
    """Whole seconds from start to end, in hours."""
    return F.expr(f"timestampdiff(SECOND, {start}, {end}) / 3600.0D")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def unique_slug(name: str, key: str) -> Column:
    """The slug of a label, with the id behind it where several ids share the slug or a
    suffixed name would equal another label's: a window over a table of labels."""
    from pyspark.sql import Window

    plain = slug(F.col(name))
    shared = F.count("*").over(Window.partitionBy(plain)) > 1
    return F.when(shared | plain.rlike("_[0-9]+$"), F.concat(plain, F.lit("_"), F.col(key).cast("string"))).otherwise(plain)


def xlnx(p: Column) -> Column:
    """p ln p, 0 at 0."""
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)


def binary_entropy(p: Column) -> Column:
    """Entropy in nats of an event of probability p."""
    return -(xlnx(p) + xlnx(1 - p))


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def seed_of(*parts) -> Column:
    """A seed from text: CRC-32 of the parts, joined by bars."""
    return F.crc32(F.concat_ws("|", *parts).cast("binary"))
