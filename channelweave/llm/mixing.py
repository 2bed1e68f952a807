"""Mixing sources to target weights: every source's documents are one stream of words
packed into blocks of a fixed length; output shards draw how many blocks of each source
they get, slots are mapped to blocks by a pseudorandom permutation, and joined to them.

Shards draw from multinomials whose weights are what is left of each source's quota, so
the sums over all shards are the quotas. A source that is used more than once goes
through a new permutation each time: no block is used twice more than another."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelweave.llm.shared import write_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2
#: Words of a block, blocks of a shard at least, and shards at most (their table of
#: draws is made on the driver: one row for each shard and source).
BLOCK, SHARD_BLOCKS, SHARDS = 256, 4096, 10_000
#: Documents that are laid out by one task.
BUCKET_ROWS = 50_000
ROUNDS, SEED = 24, 17


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words to take of each source: ``share`` of all sizes by weight (repeating), but
    no more than ``cap`` times a source; what is over goes to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, full = [0.0] * len(sizes), set()
    while True:
        left = share * sum(sizes) - sum(cap * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        total = sum(w[i] for i in free)
        for i in range(len(sizes)):
            out[i] = float(cap * sizes[i]) if i in full else left * w[i] / total
        over = {i for i in free if out[i] > cap * sizes[i]}
        if not over:
            return out
        full |= over


def draws(quotas: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first, count): which of a source's slots a shard has."""
    rng, left, rows, shard = np.random.default_rng(seed), quotas.astype(np.int64).copy(), [], 0
    size = max(SHARD_BLOCKS, -(-int(left.sum()) // SHARDS))
    while left.sum():
        got, want = np.zeros_like(left), min(size, int(left.sum()))
        while got.sum() < want:
            rest = left - got
            got += np.minimum(rng.multinomial(want - got.sum(), rest / rest.sum()), rest)
        done = quotas - left
        rows += [(shard, int(i), int(done[i]), int(got[i])) for i in np.flatnonzero(got)]
        left -= got
        shard += 1
    return rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 takes x: the swap-or-not shuffle
    (Hoang, Morris and Rogaway, 2012), which needs no table and any n."""
    x, n, seed = x.astype(np.uint64), n.astype(np.uint64), mixed(seed.astype(np.uint64))
    for r in range(ROUNDS):
        key = mixed(seed + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64)))
        partner = (key % n + n - x) % n
        high = np.maximum(x, partner)
        x = np.where(mixed(key ^ mixed(high)) & np.uint64(1), partner, x)
    return x.astype(np.int64)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lay_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every document's place in its source's stream of words, and the sources.

    The first table has id, size, skey, at (the place; with skey unique among rows that
    have words) and, if ``whole``, the row itself as a struct ``doc``. Streams are in an
    order of hashes; sums are taken by bucket first, so that no source has to pass one
    task."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))
    doc = [F.struct(*docs.columns).alias("doc")] if whole else []
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), skey.alias("skey"), word_count(text).alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), *doc)
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = write_table(rows.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("n")), "mix-buckets")
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("skey", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("skey", "bucket").orderBy("h", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(before), F.lit(0))).join(base, ["skey", "bucket"])
    placed = rows.withColumn("at", F.col("base") + F.col("inner")).select("id", "size", "skey", "at", *(["doc"] if whole else []))
    return write_table(placed, "mix-places"), sums.groupBy("skey", "source").agg(F.sum("n").alias("source_size"))


def plan(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> list[dict]:
    """One dict per source (in code point order, null last): skey, source_size, target,
    blocks and quota (blocks to take). Sources are few: a row each goes to the driver."""
    found = sorted(((r["source"] is None, r["source"] or "", r["skey"], r["source_size"]) for r in sources.toLocalIterator()))
    sizes = [s[3] for s in found]
    out = []
    for (_, _, skey, size), target in zip(found, targets(sizes, weights, share), strict=True):
        blocks = -(-size // BLOCK)
        out.append({"skey": skey, "source_size": size, "target": target, "blocks": blocks, "quota": min(CAP * blocks, round(target * blocks / size)) if size else 0})
    return out


def slots(spark, sources: list[dict], seed: int = SEED) -> DataFrame:
    """One row per block of the mix: shard, slot, skey, block, pass (0 for the first use)."""
    rows = draws(np.array([s["quota"] for s in sources], np.int64), seed) if sources else []
    cols = list(zip(*rows, strict=True)) or [()] * 4
    table = pa.table({
        "shard": pa.array(cols[0], pa.int64()), "skey": pa.array([sources[i]["skey"] for i in cols[1]], pa.string()), "number": pa.array(cols[1], pa.int64()),
        "first": pa.array(cols[2], pa.int64()), "n": pa.array(cols[3], pa.int64()), "blocks": pa.array([sources[i]["blocks"] for i in cols[1]], pa.int64()),
    })
    drawn = spark.createDataFrame(table).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))

    @F.pandas_udf("long")
    def place(x: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n.to_numpy(), key.to_numpy()))

    t = F.col("first") + F.col("i")
    drawn = drawn.withColumn("pass", F.floor(t / F.col("blocks")).cast("long")).withColumn("t", t)
    key = F.xxhash64(F.lit(seed), "number", "pass").bitwiseAND((1 << 62) - 1)
    block = place(F.col("t") - F.col("pass") * F.col("blocks"), F.col("blocks"), key)
    return drawn.select("shard", F.xxhash64("number", "t").alias("slot"), "skey", block.alias("block"), "pass")


def pieces(places: DataFrame, sources: list[dict], seed: int = SEED) -> DataFrame:
    """The mix: shard, slot, pass, and for each document in the slot's block which of
    its words (skip, n) the block has. A shard's slots are read in the order of ``slot``."""
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    cut = places.where("size > 0").select("skey", "id", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest("at", F.col("block") * BLOCK)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    cut = cut.select("skey", "id", "at", "size", "block", (start - F.col("at")).alias("skip"), (end - start).alias("n"))
    # the draws' table is small, but not what comes of it: never broadcast the slots
    return slots(places.sparkSession, sources, seed).hint("merge").join(cut, ["skey", "block"])


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns of docs: a document is given once for each
    pass that takes words of it, its text cut to those words (joined by a space) unless
    all are taken. Documents without words are in no block and so not in the mix; a null
    source is a source of its own, the last. Repeated rows are documents of their own."""
    places, found = lay_out(docs, doc_id, text, source, whole=True)
    took = pieces(places.drop("doc"), plan(found), seed)
    took = took.groupBy("skey", "at", "pass").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("skip", "n"))).alias("spans"))
    rows = places.where("size > 0").join(took, ["skey", "at"])
    words = F.regexp_extract_all(F.col("doc")[text], F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["skip"] + 1).cast("int"), s["n"].cast("int")))), " ")
    mixed_text = F.when(F.col("taken") == F.col("size"), F.col("doc")[text]).otherwise(cut)
    return rows.select(*(mixed_text.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document: its words, those of its source, the source's target, words taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    places, found = lay_out(docs)
    sources = plan(found)
    taken = pieces(places, sources).groupBy("skey", "at").agg(F.sum("n").alias("taken"))
    table = pa.table({
        "skey": pa.array([s["skey"] for s in sources], pa.string()), "source_size": pa.array([s["source_size"] for s in sources], pa.int64()), "target": pa.array([s["target"] for s in sources], pa.float64()),
    })
    rows = places.where("size > 0").join(taken, ["skey", "at"], "left").unionByName(places.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    rows = rows.join(spark.createDataFrame(table), "skey", "left")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
