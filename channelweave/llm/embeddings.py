"""Near-duplicate vectors by a forest of random-projection trees with spill overlap:
vectors are compared within leaves, verified by cosine, and united by their links.

A node splits at random: at the median of the projections on a random direction, with
those near the median going both ways. The trees' upper levels are fitted on a bounded
sample; every vector goes down every tree. Leaves that come out too large are split
further on their own quantiles, level by level, in Spark; a leaf that cannot be split
(equal projections), or whose vectors nearly all link, is salted, and every two salts are
compared.

Linked pairs are never written: a leaf gives each vector's number of links and one link
to the first of its component. A pair counts in the first leaf that both lie in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.llm.shared import connected_components, slices, write_table

TREES, SPILL, SEED = 8, 0.06, 11
#: Rows of a leaf, about, and rows up to which one task compares a leaf.
LEAF_ROWS, GROUP_ROWS = 1024, 4096
#: The sample that the trees are fitted on: rows, and numbers in all.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 1 << 22
#: Sample rows below which a node isn't split: its quantiles would be noise.
LEAST_SAMPLE = 32
#: Levels by which oversized leaves are split further before they are salted.
LEVELS = 12
#: Groups whose mean cosine falls short of 1 by no more than this times (1 - threshold) are
#: not split: most of their pairs link, so all have to be compared.
TIGHT = 1.5
BLOCK = 512
#: Pairs whose leaves are compared at a time.
BITS_ROWS = 1 << 16
#: Projections this close are equal: rounding of single precision never parts vectors.
TIE = 1e-6


class Tree:
    """Nodes as arrays; a leaf's left child is -1. Directions are drawn for each node."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int, cosine: float = 0.9) -> None:
        rng = np.random.default_rng(seed)
        self.direction, self.low, self.high, self.left, self.right = [], [], [], [], []
        todo = [(self.add(), np.arange(len(sample)))]
        while todo:
            node, at = todo.pop()
            if len(at) < 2 * LEAST_SAMPLE or len(at) * rows <= LEAF_ROWS * len(sample):
                continue
            if 1 - np.square(sample[at].mean(0)).sum() / np.square(sample[at]).sum(1).mean() <= TIGHT * (1 - cosine):
                continue
            d = rng.normal(size=sample.shape[1])
            p = sample[at] @ d
            low, high = np.quantile(p, (0.5 - SPILL, 0.5 + SPILL))
            low, high = low - TIE, high + TIE
            if not (p < low).any() or not (p > high).any():
                continue
            self.direction[node], self.low[node], self.high[node] = d, low, high
            self.left[node], self.right[node] = self.add(), self.add()
            todo += [(self.left[node], at[p <= high]), (self.right[node], at[p >= low])]

    def add(self) -> int:
        for a, v in ((self.direction, None), (self.low, 0.0), (self.high, 0.0), (self.left, -1), (self.right, -1)):
            a.append(v)
        return len(self.left) - 1

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows that reach it), over all leaves reached."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if self.left[node] < 0:
                yield node, at
                continue
            p = x[at] @ self.direction[node]
            for child, goes in ((self.left[node], p <= self.high[node]), (self.right[node], p >= self.low[node])):
                if goes.any():
                    todo.append((child, at[goes]))


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of unit length in double precision, short ones filled up with zeros."""
    out = np.zeros((len(column), dim))
    for row, v in zip(out, column, strict=True):
        values = v.values.to_numpy(zero_copy_only=False)
        row[: len(values)] = values
    # scaled first, so that squares neither overflow nor vanish
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the components that u and v link: larger labels hang below smaller ones."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def earlier_leaves(lists: pa.ListArray, g: int) -> np.ndarray:
    """A row of bits for each vector: which of the leaves before g, shared by any two, hold it."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    leaf = lists.flatten().to_numpy()
    row, leaf = row[leaf < g], leaf[leaf < g]
    _, code, times = np.unique(leaf, return_inverse=True, return_counts=True)
    shared = times > 1
    row, code = row[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
    bits = np.zeros((len(lists), -(-int(shared.sum()) // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    return bits


def leaf_links(group: pa.Table, dim: int, cosine: float) -> pa.RecordBatch:
    """For each vector of a leaf that links with another there: its class, the rows that it
    links with, and the first class of its component in this leaf.

    A pair that meets in several leaves is counted in the first of them alone, and one of
    equal salts in one pair of salts alone; all links unite."""
    group = group.combine_chunks()
    x, rows = unit_rows(group.column("v").chunk(0), dim), group.num_rows
    cls, n, own = (group.column(c).to_numpy() for c in ("cls", "n", "own"))
    g, i, j = (group.column(c)[0].as_py() for c in ("g", "i", "j"))
    seen = earlier_leaves(group.column("gs").chunk(0), g)
    here = (i == 0) & ((own == j) | ((own == 0) & (j == 1))) if i != j else np.ones(rows, bool)
    label, more = np.arange(rows), np.zeros(rows)
    for at in range(0, rows, BLOCK):
        u, v = np.nonzero(x[at : at + BLOCK] @ x[at:].T >= cosine)
        u, v = u[u < v] + at, v[u < v] + at
        unite(label, u, v)
        counts = (own[u] != own[v]) | here[u]
        for k in range(0, len(u), BITS_ROWS):
            part = slice(k, k + BITS_ROWS)
            counts[part] &= ~(seen[u[part]] & seen[v[part]]).any(1)
        u, v = u[counts], v[counts]
        more += np.bincount(u, n[v], rows) + np.bincount(v, n[u], rows)
    told = np.flatnonzero((more > 0) | (label != np.arange(rows)))
    return pa.RecordBatch.from_arrays([pa.array(cls[told]), pa.array(more[told].astype(np.int64)), pa.array(cls[label[told]])], ["cls", "more", "root"])


def distinct_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v, null where the vector can link with nothing."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).alias("id"), F.when(usable, F.col(vector)).alias("v"))


def split_level(rows: DataFrame, dim: int, level: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(g, cls, v) with every group split once more, at its own quantiles, and (g, cls, count)
    of the tight groups, which are not: unit vectors' projections vary by 1 - mean cosine."""

    @F.pandas_udf("double")
    def project(group: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(group))
        for g, at in group.groupby(group).indices.items():
            d = np.random.default_rng([SEED, level, g & 0xFFFFFFFF, (g >> 32) & 0xFFFFFFFF]).normal(size=dim)
            out[at] = unit_rows(pa.array(v.iloc[at].tolist()), dim) @ d
        return pd.Series(out)

    rows = write_table(rows.withColumn("p", project("g", "v")), "forest-level")
    cut = rows.groupBy("g").agg(F.percentile_approx("p", F.array(F.lit(0.5 - SPILL), F.lit(0.5 + SPILL)), F.lit(1000)).alias("q"), F.var_pop("p").alias("spread"), F.count("*").alias("count"))
    cut = cut.withColumn("tight", F.col("spread") <= TIGHT * (1 - cosine))
    low, high = F.col("q")[0] - TIE, F.col("q")[1] + TIE
    sides = F.array_compact(F.array(F.when(F.col("p") <= high, F.xxhash64("g", F.lit(0))), F.when(F.col("p") >= low, F.xxhash64("g", F.lit(1)))))
    met = rows.join(cut, "g")
    return met.where("NOT tight").select(F.explode(sides).alias("g"), "cls", "v"), met.where("tight").select("g", "cls", "count")


def linked(classes: DataFrame, cosine: float, trees: int, seed: int) -> DataFrame:
    """cls, more, root for every leaf of the forest and class (cls, n, v) with links in it:
    ``leaf_links``. At most a row for each leaf that a class lies in, whatever it links with."""
    spark = classes.sparkSession
    rows, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    take = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim))
    found = classes.orderBy(F.xxhash64("v")).limit(take).select("v").toArrow()
    sample = unit_rows(found.column("v").combine_chunks(), dim) if found.num_rows else np.zeros((0, dim))
    forest = spark.sparkContext.broadcast([Tree(sample, rows, seed + t, cosine) for t in range(trees)])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            x = unit_rows(batch.column("v"), dim)
            for t, tree in enumerate(forest.value):
                reached = list(tree.leaves(x))
                at = np.concatenate([a for _, a in reached])
                g = np.repeat([(t << 32) + leaf for leaf, _ in reached], [len(a) for _, a in reached])
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), batch.column("cls").take(pa.array(at))], ["g", "cls"])

    leaves = write_table(classes.select("cls", "v").mapInArrow(descend, "g long, cls long"), "forest")
    one, many = F.lit(1).alias("salts"), F.ceil(2 * F.col("count") / GROUP_ROWS).cast("int").alias("salts")
    placed, large, most = [], leaves, None
    for level in range(LEVELS + 1):
        sizes = large.groupBy("g").count()
        over = write_table(sizes.where(F.col("count") > GROUP_ROWS), "forest-over")
        worst = over.agg(F.max("count")).first()[0]
        if not worst:
            placed.append(large.select("g", "cls", one))
            break
        placed.append(large.join(over, "g", "left_anti").select("g", "cls", one))
        large = large.join(over, "g")
        if level == LEVELS or (most and worst > 0.9 * most):
            placed.append(large.select("g", "cls", many))
            break
        large = large.drop("count") if "v" in large.columns else large.drop("count").join(classes.select("cls", "v"), "cls")
        split, tight = split_level(large, dim, level, cosine)
        placed.append(tight.select("g", "cls", many))
        large, most = write_table(split, "forest-split"), worst
    every = placed[0]
    for part in placed[1:]:
        every = every.unionByName(part)

    # every vector with the list of its leaves: a few for each tree
    lists = every.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("g", "salts"))).alias("leaves"))
    each = classes.select("cls", "n", "v").join(lists, "cls").select("cls", "n", "v", F.col("leaves.g").alias("gs"), F.explode("leaves").alias("leaf"))
    # what cannot be split: every two salts meet in a task
    salts = F.col("leaf.salts")
    each = each.withColumn("own", F.pmod(F.xxhash64("v"), salts).cast("int"))
    others = F.when(salts > 1, F.array_remove(F.sequence(F.lit(0), salts - 1), F.col("own"))).otherwise(F.array(F.lit(0)))
    each = each.withColumn("other", F.explode(others))
    each = each.select("cls", "n", "v", "gs", "own", F.col("leaf.g").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield leaf_links(pa.Table.from_batches(list(batches)), dim, cosine)

    return each.groupBy("g", "i", "j").applyInArrow(compare, "cls long, more long, root long")


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """One row per row of vectors: its id, ``n_links`` (rows that it links with directly),
    ``component_id`` (the smallest id reachable) and ``kept`` (it is that one).

    Equal vectors link; they are one class before any comparison, so a group of copies
    costs a row. Vectors that are null, empty or zero or hold a null or non-finite
    number link with nothing. Vectors of different lengths are compared as if the
    shorter were filled up with zeros. Rows may repeat an id; a null id is larger than
    none and reached last. Other columns are not read. Empty in, empty out."""
    rows = distinct_vectors(vectors, vec_id, vector)
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    classes = write_table(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    found = write_table(linked(classes, cosine, trees, seed), "vector-links")
    parts = write_table(connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))), "vector-parts")
    degree = found.groupBy("cls").agg(F.sum("more").alias("more"))
    told = classes.join(degree, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    told = told.select("v", "n", "low", "more", F.coalesce("component", "cls").alias("component"))
    lows = told.groupBy("component").agg(F.min("low").alias("component_id"))
    told = told.join(lows, "component").select("v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    some = rows.where("v IS NOT NULL").join(told, "v").select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = some.unionByName(alone)
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's links, component and whether it stays."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
