"""Tables in and out: Parquet scans, templated SQL, a read-through cache, full replaces,
and the partitioned and clustered write."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; filters and columns are pushed to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """The tables as temporary views, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, ds: str | None = None, **params) -> DataFrame:
    """A lazy frame of templated SQL: ``{ds}`` is the schema's name, ``:name`` a value.

    Values are bound, never pasted into the text; names are checked."""
    if ds is not None:
        if not re.fullmatch(r"[\w.`]+", ds):
            raise ValueError(f"not a schema's name: {ds!r}")
        sql = sql.replace("{ds}", ds)
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def execute(spark: SparkSession, sql: str, ds: str | None = None, **params) -> None:
    """A statement without a result (DDL or DML)."""
    query(spark, sql, ds, **params)


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a managed table with the frame's rows and schema."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def fingerprint_of(df: DataFrame) -> str:
    """A digest of what a frame computes (its canonical plan and schema) and of the files
    that it reads (path, length and time of each)."""
    files = df.inputFiles()
    read = []
    if files:
        about = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", F.col("modificationTime").cast("double").alias("time"))
        read = sorted(map(tuple, about.toLocalIterator()))
    return hashlib.sha256(repr((df.semanticHash(), df.schema.json(), sorted(files), read)).encode()).hexdigest()[:16]


def cached(df: DataFrame, folder: str, name: str, refresh: bool = False) -> DataFrame:
    """The frame from Parquet if it was written before, else written now.

    Plan and input files are part of the key: another query, another table of the same
    schema, or files that have changed are not mistaken for it. Changes in sources that
    are not files need ``refresh``."""
    path = f"{folder}/{name}-{fingerprint_of(df)}"
    spark = df.sparkSession
    if not refresh:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # any store's way to say that there is none
            if "PATH_NOT_FOUND" not in str(e):
                raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str = "points") -> str:
    """A new folder where all executors can write: in ``spark.checkpoint.dir``, or else in
    the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(found or spark.conf.get('spark.sql.warehouse.dir') + '/_scratch').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to a new folder and read back: what reads them several times does not
    join and shuffle for them again."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def range_bucket(column: str, low: int, high: int, step: int) -> Column:
    """The range that an id falls into: its lower end, -1 below and the upper end above
    (so no id is lost), null for null."""
    c = F.col(column)
    inside = F.lit(low) + F.floor((c - low) / step) * step
    return F.when(c < low, -1).when(c >= high, high).when(c.isNotNull(), inside).cast("long")


def write_ranged(df: DataFrame, path: str, column: str, cluster: str, low: int, high: int, step: int) -> None:
    """Parquet partitioned by range of ``column``, rows of a file sorted by ``cluster``.

    Rows are dealt by range and cluster hash, so a large range has several files."""
    rows = df.withColumn("bucket", range_bucket(column, low, high, step)).withColumn("_part", F.pmod(F.xxhash64(cluster), F.lit(16)))
    rows.repartition("bucket", "_part").drop("_part").sortWithinPartitions("bucket", cluster).write.mode("overwrite").partitionBy("bucket").parquet(path)
