"""Sharding by extendible hashing, with DataFrame operations only.

A row's key hash is a string of bits. The directory maps bit prefixes to shards: a
bucket stays whole while its bytes fit the limit, and only an oversized bucket is split
on another bit. The byte counts of fine cells (prefixes a few bits deeper than the
expected depth) give those of all their ancestors, so one aggregation serves many
splits; cells that are still too large go to another round with more bits."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelweave.llm.shared import write_table

#: Bytes of text in a shard at most.
LIMIT = 16 << 20
#: Bits of the key hash; a positive long holds them.
BITS = 60
#: Bits beyond the expected depth that the first round looks at, and those of a later
#: round, which only sees what lies in cells that are too large.
AHEAD, DEEPER = 4, 14
#: Cells up to which their table is broadcast (about 40 bytes each).
BROADCAST_CELLS = 1 << 16


def key_hash(*columns: str) -> Column:
    """The first 60 bits of the MD5 of the columns as text; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in columns))), 1, BITS // 4), 16, 10).cast("long")


def assign_shards(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "text"), text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with ``shard`` (the bucket's bits, empty for the whole table), ``bytes`` of
    the row's text and ``shard_bytes``. Every shard has at most ``limit`` bytes.

    Exception: rows whose keys are the same in every bit cannot be told apart; if they
    alone exceed the limit (a text longer than it, say), they are one shard of 60 bits.
    Null texts have 0 bytes; null keys are left out of the hash. Columns of these names
    are replaced. An empty table gives an empty result."""
    h, size = "_hash", "bytes"
    rows = docs.withColumn(h, key_hash(*keys)).withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    depth, done = min(BITS, ceil(log2(max(1, total / limit))) + AHEAD), None
    start, pending = 0, rows.select(F.col(h), F.col(size))
    while True:
        cells = pending.groupBy(F.shiftrightunsigned(h, BITS - depth).alias("cell")).agg(F.sum(size).alias("n"))
        up = cells.select("cell", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d"), "n")
        up = up.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
        sums = up.groupBy("d", "prefix").agg(F.sum("n").alias("shard_bytes"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("d") == BITS)
        leaf = up.join(sums, ["d", "prefix"]).groupBy("cell").agg(F.min(F.when(fits, F.struct("d", "prefix", "shard_bytes"))).alias("leaf"))
        # cells of one round never meet those of another: a cell is given with its depth
        leaf = write_table(leaf.select(F.lit(depth).alias("depth"), "cell", "leaf.*"), "shards")
        placed, left = leaf.where("d IS NOT NULL"), leaf.where("d IS NULL").select("cell")
        done = placed if done is None else done.unionByName(placed)
        if left.isEmpty():
            break
        pending = write_table(pending.withColumn("cell", F.shiftrightunsigned(h, BITS - depth)).join(left, "cell", "left_semi").drop("cell"), "oversized")
        start, depth = depth, min(BITS, depth + DEEPER)
    depths = [r[0] for r in done.select("depth").distinct().collect()] or [depth]
    tagged = rows
    for d in sorted(depths):
        part = done.where(F.col("depth") == d).select(F.col("cell").alias(f"_c{d}"), F.struct("d", "prefix", "shard_bytes").alias(f"_l{d}"))
        if d <= log2(BROADCAST_CELLS):
            part = F.broadcast(part)
        tagged = tagged.withColumn(f"_c{d}", F.shiftrightunsigned(h, BITS - d)).join(part, f"_c{d}", "left")
    leaf = F.coalesce(*(F.col(f"_l{d}") for d in sorted(depths)))
    bits = F.when(leaf["d"] == 0, "").otherwise(F.lpad(F.bin(leaf["prefix"]), leaf["d"], "0"))
    return tagged.withColumn("shard", bits).withColumn("shard_bytes", leaf["shard_bytes"]).drop(h, *(f"_{x}{d}" for d in depths for x in "cl"))


def op10_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard, its bytes and those of the shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "shard", "bytes", "shard_bytes")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, CAST(('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15)) AS BIGINT) AS h,
                  CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes FROM documents),
p AS (SELECT h, bytes, unnest(range(0, {BITS + 1})) AS d FROM d),
s AS (SELECT d, h >> CAST({BITS} - d AS INTEGER) AS prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes FROM p GROUP BY 1, 2),
f AS (SELECT * FROM s WHERE shard_bytes <= {LIMIT} OR d = {BITS}),
best AS (SELECT doc_id, h, bytes, min(f.d) AS depth FROM d JOIN f ON f.prefix = d.h >> CAST({BITS} - f.d AS INTEGER) GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(to_base(h, 2), {BITS}, '0')[1:depth], depth) END AS shard, bytes, shard_bytes
FROM best JOIN s ON s.d = best.depth AND s.prefix = best.h >> CAST({BITS} - best.depth AS INTEGER)
"""
