"""What the training-data operators share: tables written to the cluster's shared
folder, slices of Arrow batches, and connected components of a link table."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slice of texts that a worker takes apart at a time.
SLICE_ROWS = 512
#: Rounds of star contraction after which an endless loop is assumed.
MAX_ROUNDS = 60


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``, or, where
    the session has none, one in the warehouse. The session's settings stay as they are."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that arrays made of their texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read that back.

    Survives the loss of executors, unlike a local checkpoint."""
    spark = df.sparkSession
    path = path or table_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver's collectors find finished shuffles, so that Spark's cleaner drops
    their files now and not at some later time. Costs a fraction of a second."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected links (a, b), both long: one row (node, component) for
    each node that has a link; component is the smallest node reached.

    Alternates large-star and small-star contraction (Kiveris et al., 2014). Every
    round is two aggregations with partial sums and two equi-joins whose hot keys AQE
    can split; links stay in Spark and are written to the shared folder each round,
    where those of the round before are deleted. Nulls and self-links are ignored; an
    empty table gives an empty result."""
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = write_table(pairs, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, links = links, write_table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_table(old)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        if now == state or not now[0]:
            roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = now
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
