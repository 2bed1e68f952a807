"""Ranked lexical search over a clustered index.

Documents are put in an order in which similar ones are neighbours: recursive graph
bisection (Dhulipala et al., 2016) of the graph of documents and terms halves a sample
again and again, moving documents where the estimated cost of the two halves' posting
lists falls; every other document follows the tree by the same costs. Runs of the order,
cut at a number of documents, are shards, each with its posting lists and the largest
impact of every term. A query's bound for a shard is the sum of its terms' largest
impacts. Shards are visited by falling bounds, in waves: a wave's k-th best score is the
floor of the next, and the last one visits every shard whose bound reaches the floor, so
that what is left out can't be in the result. Scores are integers; equal scores go by
doc_id, by which a shard's documents are numbered."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructField, StructType

from channelweave.llm.shared import drop_table, slices, write_table

TOP = 10
#: Bytes of queries that are held at a time; a larger set goes in blocks.
BLOCK_BYTES = 1 << 19
#: The bisection is fitted on so many documents with at most so many query terms each.
SAMPLE, SAMPLE_TERMS, DEPTH, PASSES = 4096, 1024, 6, 20
#: Documents of a shard at most.
SHARD_DOCS = 4096
#: Shards of the first waves, for each query; the last wave has no such number.
WAVES = (2, 16)
#: Factors of the score.
IDF_SCALE, TF_SCALE, TF_ONE, LENGTH_WEIGHT, LENGTH_SHARE = 1000, 10**9, 1000, 8, 75
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and all beyond ASCII, with A-Z lower-cased."""
    return text.encode().translate(TERM_BYTES).split()


class Queries(NamedTuple):
    """A block of items: ids, and all their (term, times) with each item's first."""

    ids: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    def of(self, q: int) -> slice:
        return slice(self.starts[q], self.starts[q + 1])


def query_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[Queries]:
    """Items dealt into blocks by hash; the driver holds one at a time. Items without a
    term are left out, rows that repeat are queries of their own."""
    rows = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        ids, known, starts, found, times = [], {}, [0], [], []
        for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toLocalIterator():
            if count := Counter(terms(r["text"])):
                ids.append(r["id"])
                found += [known.setdefault(t, len(known)) for t in count]
                times += count.values()
                starts.append(len(found))
        if ids:
            yield Queries(ids, known, np.array(starts), np.array(found), np.array(times, np.int64))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def forward(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, times): a text's number of terms, and those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, found, times = [], [], []
            for x in part.column(1).to_pylist():
                words = terms(x)
                ids = np.fromiter(map(shared.value.get, words, repeat(-1)), np.int32, len(words))
                a, b = np.unique(ids[ids >= 0], return_counts=True)
                sizes.append(len(words))
                found.append(a)
                times.append(b.astype(np.int32))
            arrays = [part.column(0), pa.array(sizes, pa.int64()), lists(found, pa.int32()), lists(times, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    out = [rows.schema["doc_id"], *StructType.fromDDL("n long, terms array<int>, times array<int>").fields]
    return rows.mapInArrow(read, StructType(out))


def list_cost(degree: np.ndarray, docs: int) -> np.ndarray:
    """Estimated bits of posting lists with these lengths among so many documents."""
    return degree * np.log2(max(docs, 1) / (degree + 1))


def halve(starts: np.ndarray, found: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which documents (posting slices of ``found``) go left, and of every term the cost
    of one more document on the left less that on the right."""
    docs = len(starts) - 1
    owner = np.repeat(np.arange(docs), np.diff(starts))
    left = np.arange(docs) % 2 == 0
    n = int(left.sum()), docs - int(left.sum())
    for _ in range(PASSES):
        d = np.bincount(found[left[owner]], minlength=size), np.bincount(found[~left[owner]], minlength=size)
        out = [list_cost(d[s], n[s]) - list_cost(np.maximum(d[s] - 1, 0), n[s]) for s in (0, 1)]
        into = [list_cost(d[s] + 1, n[s]) - list_cost(d[s], n[s]) for s in (0, 1)]
        gain = np.bincount(owner, np.where(left[owner], (out[0] - into[1])[found], (out[1] - into[0])[found]), docs)
        a, b = (side[np.argsort(-gain[side], kind="stable")] for side in (np.flatnonzero(left), np.flatnonzero(~left)))
        pairs = min(len(a), len(b))
        swap = int(np.count_nonzero(gain[a[:pairs]] + gain[b[:pairs]] > 0))
        if not swap:
            break
        left[a[:swap]], left[b[:swap]] = False, True
    return left, into[0] - into[1]


def bisection(sample: list[np.ndarray], size: int, depth: int = DEPTH) -> np.ndarray:
    """The tree as a matrix: for each inner node, in heap order, costs of every term."""
    tree = np.zeros((2**depth - 1, size), np.float32)
    members = {0: np.arange(len(sample))}
    for node in range(2**depth - 1):
        mine = members.pop(node)
        left = np.zeros(len(mine), bool)
        if len(mine) > 1:
            starts = np.cumsum([0, *(len(sample[k]) for k in mine)])
            left, tree[node] = halve(starts, np.concatenate([sample[k] for k in mine]), size)
        members |= {2 * node + 1: mine[left], 2 * node + 2: mine[~left]}
    return tree


def leaves(tree: np.ndarray, starts: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The leaf of each document, from left to right: the cheaper side at every node."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    node, leaf = np.zeros(len(starts) - 1, np.int64), np.zeros(len(starts) - 1, np.int64)
    for _ in range(int(math.log2(len(tree) + 1))):
        right = np.bincount(owner, tree[node[owner], found], len(node)) > 0
        node, leaf = 2 * node + 1 + right, 2 * leaf + right
    return leaf


def ordered(found: DataFrame, tree: np.ndarray, docs: int, total: int) -> DataFrame:
    """(leaf, doc_id, terms, impacts) of documents with a query term, in their order."""
    shared = found.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            starts = part.column(2).offsets.to_numpy() - part.column(2).offsets[0].as_py()
            ids, times = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
            m = [100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // total for n in part.column(1).to_pylist()]
            impact = TF_SCALE * times // (TF_ONE * times + LENGTH_WEIGHT * np.repeat(np.array(m, np.int64), np.diff(starts)))
            impacts = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(impact, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(leaves(shared.value, starts, ids), pa.int32()), part.column(0), part.column(2), impacts], ["leaf", "doc_id", "terms", "impacts"])

    schema = StructType([*StructType.fromDDL("leaf int").fields, found.schema["doc_id"], *StructType.fromDDL("terms array<int>, impacts array<int>").fields])
    placed = found.where(F.size("terms") > 0).mapInArrow(place, schema)
    order = ["leaf", F.asc_nulls_last("doc_id"), F.xxhash64("terms", "impacts")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


SHARDS = "shard long, leaf int, terms array<int>, best array<int>, starts array<int>, docs array<int>, impacts array<int>"


def into_shards(rows: DataFrame, size: int) -> DataFrame:
    """Runs of one leaf's documents as posting lists: term ids, their largest impacts and
    first postings; positions and impacts; and the doc_id of every position."""
    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def shard(name: int, leaf: int, ids: list, found: list, impacts: list) -> pa.RecordBatch:
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in found])
        t, v = np.concatenate(found), np.concatenate(impacts)
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        parts = [t[first], np.maximum.reduceat(v, first), np.r_[first, len(t)], docs[order], v]
        columns = [pa.array([name], pa.int64()), pa.array([leaf], pa.int32()), *(lists([x], pa.int32()) for x in parts), pa.array([ids], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(columns, [*(x.split()[0] for x in SHARDS.split(", ")), "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, leaf, ids, found, impacts = TaskContext.get().partitionId() << 32, -1, [], [], []
        for part in slices(batches):
            at = part.column(2).offsets.to_numpy() - part.column(2).offsets[0].as_py()
            t, v = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            for k, (now, doc) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if ids and (now != leaf or len(ids) == size):
                    yield shard(made, leaf, ids, found, impacts)
                    made, ids, found, impacts = made + 1, [], [], []
                leaf = now
                ids.append(doc)
                found.append(t[at[k] : at[k + 1]])
                impacts.append(v[at[k] : at[k + 1]])
        if ids:
            yield shard(made, leaf, ids, found, impacts)

    schema = StructType([*StructType.fromDDL(SHARDS).fields, *StructType.fromDDL(f"ids array<{rows.schema['doc_id'].dataType.simpleString()}>").fields])
    return rows.mapInArrow(pack, schema)


class Scorer:
    """A block's queries with their terms' weights."""

    def __init__(self, queries: Queries, weights: np.ndarray, top: int):
        self.queries, self.top, self.size = queries, top, len(weights)
        self.times_weight = queries.times * weights[queries.terms]

    def bounds(self, found: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The greatest score that a document of a shard may have, for each query."""
        most = np.zeros(self.size, np.int64)
        most[found] = best
        return np.add.reduceat(self.times_weight * most[self.queries.terms], self.queries.starts[:-1])

    def scores(self, q: int, shard: dict[str, np.ndarray], docs: int) -> np.ndarray:
        total, of = np.zeros(docs, np.int64), self.queries.of(q)
        at = np.searchsorted(shard["terms"], self.queries.terms[of])
        at[at == len(shard["terms"])] = 0
        for k in np.flatnonzero(shard["terms"][at] == self.queries.terms[of]):
            run = slice(shard["starts"][at[k]], shard["starts"][at[k] + 1])
            total[shard["docs"][run]] += self.times_weight[of][k] * shard["impacts"][run]
        return total

    def best(self, total: np.ndarray, floor: int) -> np.ndarray:
        """Positions of the highest scores from the floor on; of equal ones the first."""
        at = np.flatnonzero(total >= max(floor, 1))
        if len(at) > self.top:
            least = np.partition(total[at], -self.top)[-self.top]
            at = at[total[at] >= least]
        return at[np.argsort(-total[at], kind="stable")][: self.top]


def shard_bounds(shards: DataFrame, scorer) -> DataFrame:
    """(q, shard, bound) wherever the bound is above 0."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            for k, name in enumerate(part.column(0).to_pylist()):
                b = scorer.value.bounds(part.column(1)[k].values.to_numpy(), part.column(2)[k].values.to_numpy())
                q = np.flatnonzero(b > 0)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(np.full(len(q), name), pa.int64()), pa.array(b[q], pa.int64())], ["q", "shard", "bound"])

    return shards.select("shard", "terms", "best").mapInArrow(bound, "q int, shard long, bound long")


def visit(shards: DataFrame, pairs: DataFrame, scorer, floors: np.ndarray, doc_type: DataType) -> DataFrame:
    """(q, doc_id, score): the best documents of each (q, shard), from the floors on. A
    task raises its floors as it goes and passes by shards whose bounds fall short."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, floor, seen = scorer.value, floors.copy(), {}
        for part in slices(batches, 16):
            for row in range(part.num_rows):
                shard = {c: part[c][row].values.to_numpy() for c in ("terms", "best", "starts", "docs", "impacts", "queries")}
                ids, bound = part["ids"][row].values, use.bounds(shard["terms"], shard["best"])
                found, at, values = [], [], []
                for q in np.sort(shard["queries"]).tolist():
                    if bound[q] < floor[q]:
                        continue
                    total = use.scores(q, shard, len(ids))
                    best = use.best(total, int(floor[q]))
                    found += [q] * len(best)
                    at += best.tolist()
                    values += total[best].tolist()
                    seen[q] = sorted([*seen.get(q, ()), *total[best].tolist()])[-use.top :]
                    if len(seen[q]) == use.top:
                        floor[q] = max(floor[q], seen[q][0])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), ids.take(pa.array(at, pa.int64())), pa.array(values, pa.int64())], ["q", "doc_id", "score"])

    asked = pairs.groupBy("shard").agg(F.collect_list("q").alias("queries"))
    schema = StructType([*StructType.fromDDL("q int").fields, StructField("doc_id", doc_type), *StructType.fromDDL("score long").fields])
    return shards.join(asked, "shard").mapInArrow(score, schema)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(shards: DataFrame, scorer, doc_type: DataType, waves: tuple[int, ...] = WAVES) -> DataFrame:
    """(q, rank, doc_id, score), exact, in waves of shards by falling bounds."""
    spark, top, n = shards.sparkSession, scorer.value.top, len(scorer.value.queries.ids)
    bounds = write_table(shard_bounds(shards, scorer), "bounds")
    floors = np.ones(n, np.int64)
    first = Window.partitionBy("q").orderBy(F.desc("bound"), "shard")

    def open_pairs() -> DataFrame:
        known = spark.createDataFrame(list(enumerate(floors.tolist())), "q int, floor long")
        return bounds.join(known, "q").where("bound >= floor").select("q", "shard", "bound")

    for wave in waves:
        pairs = open_pairs().withColumn("k", F.row_number().over(first)).where(F.col("k") <= wave)
        best = ranked(visit(shards, pairs, scorer, floors, doc_type), top)
        for r in best.groupBy("q").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") == top).toLocalIterator():
            floors[r["q"]] = max(floors[r["q"]], r["least"])
    out = write_table(ranked(visit(shards, open_pairs(), scorer, floors, doc_type), top), "ranked")
    drop_table(bounds)
    return out


def rank_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's highest-scoring documents, at most
    ``top``, all with a score above 0; of equal scores the smaller doc_id goes first.

    Null and empty texts have no terms: such documents count nowhere, such items have no
    rows. Null doc_ids go last among equals. Rows that repeat are documents, or queries,
    of their own. Texts are read whole, other columns are left out. Without documents
    or items the result is empty. A large set of items goes in blocks, each of which
    reads the texts once; what it writes to the shared folder besides its result is
    deleted when that is there."""
    spark, out = docs.sparkSession, None
    for queries in query_blocks(items, item_id, item_text, block_bytes):
        found = write_table(forward(docs, queries.vocabulary, doc_id, text), "forward")
        n, total = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n:
            drop_table(found)
            continue
        weights = np.zeros(len(queries.vocabulary), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            weights[r["t"]] = math.floor(IDF_SCALE * math.log((2 * n + 2) / (2 * r["count"] + 1)))
        few = found.where(F.size("terms").between(1, SAMPLE_TERMS)).select("terms", F.xxhash64("doc_id", "n", "terms").alias("h"))
        # thinned by hash first: each task sends its smallest to the driver, so few may be left of it
        thinned = F.pmod(F.xxhash64(F.lit("sample"), "h"), F.lit(1 << 30)) <= int(min(1, 2 * SAMPLE / n) * (1 << 30))
        few = few.where(thinned).orderBy("h").limit(SAMPLE)
        sample = [np.array(r["terms"]) for r in few.toLocalIterator()]
        shards = write_table(into_shards(ordered(found, bisection(sample, len(weights)), n, total), shard_docs), "shards")
        scorer = spark.sparkContext.broadcast(Scorer(queries, weights, top))
        doc_type = found.schema["doc_id"].dataType
        best = search(shards, scorer, doc_type)
        names = spark.createDataFrame(list(enumerate(queries.ids)), StructType([StructField("q", LongType()), StructField("item_id", items.schema[item_id].dataType)]))
        part = best.join(names, "q").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
        drop_table(found)
        drop_table(shards)
    if out is None:
        schema = [StructField("item_id", items.schema[item_id].dataType), StructField("doc_id", docs.schema[doc_id].dataType)]
        out = spark.createDataFrame([], StructType([schema[0], *StructType.fromDDL("rank int").fields, schema[1], *StructType.fromDDL("score long").fields]))
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rank_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term"
OP11_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY 1, 2),
m AS (SELECT doc_id, 100 - 75 + (75 * n * n_docs) // total AS m FROM d, c),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
