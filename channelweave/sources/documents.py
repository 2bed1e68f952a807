"""Small results out and in: JSON documents, JSON lines, CSV, and config maps."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def plain(value):
    """Values that JSON has: rows as dicts, NaN and infinities as null."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, bool | int | str) or value is None:
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return number if math.isfinite(number) else None


def write_result(path: str, protocol: dict, cells: DataFrame, most: int = 100_000, **more) -> None:
    """One JSON document: the protocol, and a small result's rows as ``cells``."""
    rows = cells.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no document; use write_records")
    Path(path).write_text(json.dumps({"protocol": plain(protocol), "cells": [plain(r) for r in rows], **plain(more)}, indent=2, ensure_ascii=False))


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The cells of JSON documents, one row each."""
    return spark.read.option("multiLine", True).json(paths).selectExpr("inline(cells)")


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_config(path: str) -> dict:
    """A config document (analyte sets, bucket maps) on the driver."""
    return json.loads(Path(path).read_text())


def mapping(spark: SparkSession, pairs: dict, key: str, value: str) -> DataFrame:
    """A dictionary as a dimension table."""
    return spark.createDataFrame(list(pairs.items()), f"{key} string, {value} string")
