"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small
Hamming distance by self-joins of binary tries.

A pair within ``max_bits`` differing bits has, among ``max_bits + 1`` equal blocks of
bits, one block without a difference. Each fingerprint is therefore put into one trie
for each block, with that block's bits first. In such a trie only pairs below the same
node at the block's end matter, so the subtrees below can be dealt to tasks. A subtree
too large for a task becomes several tries, with a further block in front. A task
walks pairs of nodes downwards together, adds up differing bits, and drops a pair once
the error budget is spent; pairs of leaves are links.

Equal fingerprints are merged before any comparison, so a group of copies of any size
is one leaf. A task reports links as stars (each fingerprint with the smallest one of
its local component), so a dense group costs a row per fingerprint, not per pair.

Texts whose shingle sets overlap by 0.8 differ in about a seventh of their bits, too
many for a budget on 64. ``similar_documents`` therefore takes fingerprints of 384 bits,
as ``WORDS`` words with a trie each: a pair is proposed where it differs in at most
``WORD_BUDGET`` of a word's 24 bits and in no more bits of the whole than the similarity
allows. Within what such pairs unite, links are verified on the shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.llm.shared import connected_components, slices, write_table

BITS = 64
#: Fingerprints that one task's tries hold, about.
TRIE_ROWS = 8192
#: Fingerprints with the same block of bits up to which one task takes them all; beyond
#: it they are told apart by further blocks, at most so many levels deep, or salted, and
#: every two salts meet in a task.
CELL_ROWS, LEVELS = 2 * TRIE_ROWS, 2
#: Blocks of a path are digits to this base. Other words by whose bytes a crowded cell of
#: a wide fingerprint is split at a level. Crowded cells that are broadcast at most.
PATH_BASE, OTHERS, BROADCAST_CELLS = 64, 7, 1 << 18
#: Node pairs walked at a time: bounds a task's memory whatever the data.
FRONTIER = 1 << 17
#: XXH64 seed, as in Spark's xxhash64.
SEED = 42
#: Words of a wide fingerprint, bits of a word, and a word's budget of differing bits.
WORDS, WORD_BITS, WORD_BUDGET = 16, 24, 2
#: Deviations by which a pair's differing bits may exceed what is expected at the least
#: similarity, and share of those bits up to which a chain of neighbours is followed.
SIGMAS, CLOSE = 2.5, 0.5
#: Texts and shingles up to which one task verifies a group; larger ones are salted.
GROUP_TEXTS, GROUP_SHINGLES = 2048, 1 << 22
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)]
    grams = map(b" ".join, zip(*parts, strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "simhash", shingle: int = 3) -> DataFrame:
    """docs with a long column of fingerprint bits. Null and empty texts get 0."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(into, bits(F.col(text)))


def trie_links(values: np.ndarray, first: int, max_bits: int, bits: int = BITS, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions u < v in ``values`` (sorted, distinct, uint64, of ``bits`` bits)
    that share their first ``first`` bits and differ in at most ``max_bits`` of the others.

    The trie is kept as one table of nodes a depth: a node is a run of sorted values.
    With ``group`` (a number for each value, negative for none) two nodes all of whose
    values are of one and the same group are not walked."""
    n = len(values)
    if n < 2:
        return
    runs = lambda depth: np.cumsum(np.r_[False, np.diff(values >> np.uint64(bits - depth)) != 0]).astype(np.int32) if depth else np.zeros(n, np.int32)

    def groups(node: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.diff(node, prepend=-1))
        low, high = np.minimum.reduceat(group, at), np.maximum.reduceat(group, at)
        return np.where(low == high, low, -1)

    node = runs(first)
    starts, levels, known = node, [], []
    for depth in range(first, bits):
        if group is not None:
            known.append(groups(node))
        below = runs(depth + 1)
        child = np.full((int(node[-1]) + 1, 2), -1, np.int32)
        child[node, ((values >> np.uint64(bits - depth - 1)) & np.uint64(1)).astype(np.int8)] = below
        levels.append(child)
        node = below
    roots = np.unique(starts)
    stack = [(0, roots[i : i + FRONTIER], roots[i : i + FRONTIER], np.zeros(len(roots[i : i + FRONTIER]), np.int8)) for i in range(0, len(roots), FRONTIER)]
    while stack:
        level, u, v, spent = stack.pop()
        if level == len(levels):
            apart = u < v
            yield u[apart], v[apart]
            continue
        if group is not None:
            open_ = (known[level][u] < 0) | (known[level][u] != known[level][v])
            u, v, spent = u[open_], v[open_], spent[open_]
        a, b, same = levels[level][u], levels[level][v], u == v
        us, vs, es = [], [], []
        for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
            ok = (a[:, i] >= 0) & (b[:, j] >= 0)
            if i != j:
                ok &= spent < max_bits
            if (i, j) == (1, 0):
                ok &= ~same
            us.append(a[ok, i])
            vs.append(b[ok, j])
            es.append(spent[ok] + np.int8(i != j))
        u, v, spent = np.concatenate(us), np.concatenate(vs), np.concatenate(es)
        for i in range(0, len(u), FRONTIER):
            stack.append((level + 1, u[i : i + FRONTIER], v[i : i + FRONTIER], spent[i : i + FRONTIER]))


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest position of a component) after the links u-v."""
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def digits(path: int) -> list[int]:
    """The blocks, from the first to the last, that a trie's path names."""
    out = []
    while path:
        path, block = divmod(path, PATH_BASE)
        out.append(block - 1)
    return out[::-1]


def split_cells(rows: DataFrame, choices: int, turn: Callable[[DataFrame, int], DataFrame], level: int) -> DataFrame:
    """rows in each trie that ``choices`` more blocks give; ``turn`` sets the new cells."""
    more = F.explode(F.sequence(F.lit(0), F.lit(choices - 1)))
    rows = rows.withColumn("block", more).withColumn("path", F.col("path") * PATH_BASE + F.col("block") + 1)
    return turn(rows, level).drop("block")


def dealt(rows: DataFrame, choices: int, turn: Callable[[DataFrame, int], DataFrame], n: int, mark: str) -> DataFrame:
    """rows (path, cell, ...) with lead, i and j, which say what goes to one task: whole
    cells, or two salts of a crowded one.

    A crowded cell's rows are put into ``choices`` new tries each, whose cells are told
    apart by one more block of bits, and so on for ``LEVELS`` levels: copies of a row grow
    with the logarithm of the rows, not with their number. Only where salts cost fewer
    copies, or at the last level (values that agree in all those blocks), cells are salted.
    ``n`` is the number of rows of a path; ``mark`` is hashed for the salts."""
    out = []
    for level in range(LEVELS + 1):
        groups = max(1, math.ceil(n / TRIE_ROWS))
        lead = F.pmod(F.xxhash64("path", "cell"), F.lit(groups))
        split = 0
        if n > CELL_ROWS:
            sizes = rows.groupBy("path", "cell").agg(F.count("*").alias("rows")).where(F.col("rows") > CELL_ROWS)
            salts = F.ceil(2 * F.col("rows") / CELL_ROWS).cast("int")
            on = (salts > choices + 1) if level < LEVELS else F.lit(False)
            crowded = write_table(sizes.select("path", "cell", "rows", salts.alias("salts"), on.alias("split")), "simhash-crowded")
            of_path = crowded.groupBy("path").agg(F.count("*").alias("cells"), F.sum(F.when(F.col("split"), F.col("rows"))).alias("rows"))
            cells, split = of_path.agg(F.coalesce(F.sum("cells"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
            crowded = crowded.drop("rows")
            rows = rows.join(F.broadcast(crowded) if cells <= BROADCAST_CELLS else crowded, ["path", "cell"], "left")
        else:
            rows = rows.withColumns({"salts": F.lit(None).cast("int"), "split": F.lit(None).cast("boolean")})
        stay = rows.where(~F.coalesce("split", F.lit(False))) if split else rows
        # a salted cell's values are dealt to salts, and a task walks the trie of two salts
        own = F.pmod(F.xxhash64(mark), F.col("salts")).cast("int")
        others = F.array_remove(F.sequence(F.lit(0), F.col("salts") - 1), F.col("own"))
        stay = stay.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
        lead = F.when(F.col("salts").isNull(), lead).otherwise(-1 - F.col("cell"))
        out.append(stay.withColumns({"lead": lead, "i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("cell", "salts", "split", "own", "other"))
        if not split:
            break
        rows, n = split_cells(rows.where("split").drop("salts", "split"), choices, turn, level + 1), split
    return reduce(DataFrame.unionByName, out)


def rotation(level: int, blocks: int) -> tuple[int, int]:
    """(bits that are settled above a level, width of its blocks) of a fingerprint."""
    settled = 0
    for _ in range(level):
        settled += (BITS - settled) // blocks
    return settled, (BITS - settled) // blocks


def turned_back(values: np.ndarray, path: int, blocks: int) -> np.ndarray:
    """Fingerprints from what a trie's path has made of them."""
    for level, block in reversed(list(enumerate(digits(path)))):
        settled, _ = rotation(level, blocks)
        rest = BITS - settled
        by = np.uint64(rest * block // blocks)
        if by:
            mask = np.uint64((1 << rest) - 1)
            low = values & mask
            values = (values & ~mask) | (low >> by) | ((low << (np.uint64(rest) - by)) & mask)
    return values


def fingerprint_links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct values of
    ``simhash`` within max_bits differing bits.

    A trie's values have the block of its path in front; in a crowded cell the bits
    behind it are parted into blocks again, of which one has no difference either."""
    blocks = max_bits + 1

    def turn(rows: DataFrame, level: int) -> DataFrame:
        settled, width = rotation(level, blocks)
        rest = BITS - settled
        mask = (1 << rest) - 1 if settled else -1
        low, turned = F.col("bits").bitwiseAND(F.lit(mask).cast("long")), F.col("bits")
        for block in range(1, blocks):
            by = rest * block // blocks
            rolled = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, rest - by)).bitwiseAND(F.lit(mask).cast("long"))
            if settled:
                rolled = rolled.bitwiseOR(F.col("bits").bitwiseAND(F.lit(~mask).cast("long")))
            turned = F.when(F.col("block") == block, rolled).otherwise(turned)
        rows = rows.withColumn("bits", turned)
        return rows.withColumn("cell", F.shiftrightunsigned("bits", rest - width))

    start = prints.select(F.col("simhash").alias("bits"), F.lit(0).alias("path"))
    rows = dealt(split_cells(start, blocks, turn, 0), blocks, turn, prints.count(), "bits")

    def walk(table: pa.Table) -> pa.Table:
        path = table.column("path")[0].as_py()
        values = np.unique(table.column("bits").to_numpy().view(np.uint64))
        label = np.arange(len(values), dtype=np.int64)
        for u, v in trie_links(values, sum(rotation(len(digits(path)) - 1, blocks)), max_bits):
            label = merge_labels(label, u.astype(np.int64), v.astype(np.int64))
        back = turned_back(values, path, blocks).view(np.int64)
        apart = label != np.arange(len(label))
        return pa.table({"a": back[apart], "b": back[label[apart]]})

    return rows.groupBy("path", "lead", "i", "j").applyInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row of docs: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id of all documents reached by links.

    Null and empty texts have fingerprint zero and link like any other. Rows repeated
    with the same id share their component. A null id gets a component (null if no
    other id is in it). Other columns of docs are not read. Empty in, empty out."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    prints = write_table(with_fingerprint(slim, "text", "simhash", shingle).select("id", "simhash"), "simhash")
    distinct = write_table(prints.groupBy("simhash").agg(F.min("id").alias("low")), "simhash-low")
    parts = write_table(connected_components(fingerprint_links(distinct, max_bits)), "simhash-parts")
    grouped = distinct.join(parts.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    reached = grouped.join(lows, "component").select("simhash", "component_id")
    return prints.join(reached, "simhash").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a text with fewer words, of all its words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [words[i:] for i in range(shingle)]
    grams = map(b" ".join, zip(*parts, strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of a shingle set with WORDS * WORD_BITS bits; zeros for an empty set."""
    size = WORDS * WORD_BITS // BITS
    ones = np.zeros(WORDS * WORD_BITS, np.float64)
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[at : at + (1 << 12), None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.ones(len(x), np.float32) @ np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def bit_budget(least: float) -> int:
    """Differing bits of wide fingerprints up to which two sets may have a Jaccard
    similarity of ``least``: the angle of equally large sets, and some deviations."""
    bits, share = WORDS * WORD_BITS, math.acos(2 * least / (1 + least)) / math.pi
    return math.floor(bits * share + SIGMAS * math.sqrt(bits * share * (1 - share)))


def spanning(label: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Edges (by number) of the forest of least distances that unites what u-v unite;
    edges within one label are left out."""
    label, kept = label.copy(), []
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((v, u, d))] = np.arange(len(u))
    by_rank, left = np.argsort(rank), np.arange(len(u))
    while True:
        left = left[label[u[left]] != label[v[left]]]
        if not len(left):
            return np.unique(np.concatenate(kept)) if kept else left
        best = np.full(len(label), len(u))
        for side in (u, v):
            np.minimum.at(best, label[side[left]], rank[left])
        chosen = by_rank[np.unique(best[best < len(u)])]
        kept.append(chosen)
        label = merge_labels(label, u[chosen], v[chosen])


def ragged(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and all j from low[i] to high[i], a bounded number at a time."""
    ends, at = np.cumsum(high - low), 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, "right")))
        n = (high - low)[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, low[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def first_of_kind(x: np.ndarray) -> np.ndarray:
    """For each element, where its value occurs first."""
    _, first, inverse = np.unique(x, return_index=True, return_inverse=True)
    return first[inverse]


def proposals(value: np.ndarray, prints: np.ndarray, sizes: np.ndarray, first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one trie that unite what all pairs unite that may reach the
    similarity: the nearest ones. Values are the ``first`` bits of a cell, then the rest
    of a word.

    A chain of close neighbours comes first, and nodes of the trie that it has made one
    are not walked, so a dense group does not cost its square."""
    budget = bit_budget(least)
    order = np.lexsort((prints[:, 1], prints[:, 0], value))
    label = np.arange(len(order))

    def near(i: np.ndarray, j: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = order[i], order[j]
        ok = (label[i] != label[j]) & (np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]) - 1e-9)
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        d = np.bitwise_count(prints[a] ^ prints[b]).sum(1, dtype=np.int64)
        return i[d <= most], j[d <= most], d[d <= most]

    at = np.arange(len(order) - 1)
    u, v, _ = near(at, at + 1, CLOSE * budget)
    chain = order[np.stack([u, v])]
    label = merge_labels(label, u, v)
    turn = np.lexsort((label, value[order]))
    order, label = order[turn], first_of_kind(label[turn])
    found, edges, kept = value[order], [np.zeros(0, np.int64)] * 3, 0
    start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    end = np.r_[start[1:], len(found)]
    run = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (label[1:] != label[:-1])])
    group = np.where(np.minimum.reduceat(label, start) == np.maximum.reduceat(label, start), label[start], -1)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.arange(len(found))
        # of one value, rows that the chain has not united
        yield from ragged(np.r_[run[1:], len(found)][np.searchsorted(run, rows, "right") - 1], end[np.searchsorted(start, rows, "right") - 1])
        for u, v in trie_links(found[start], first, WORD_BUDGET, first + WORD_BITS - WORD_BITS // (WORD_BUDGET + 1), group):
            for k, i in ragged(start[u], end[u]):
                for m, j in ragged(start[v[k]], end[v[k]]):
                    yield i[m], j

    for i, j in pairs():
        edges = [np.concatenate(x) for x in zip(edges, near(i, j, budget), strict=True)]
        if len(edges[0]) > 2 * kept + FRONTIER:
            tree = spanning(label, *edges)
            edges, kept = [x[tree] for x in edges], len(tree)
    tree = spanning(label, *edges)
    out = np.concatenate([chain, order[np.stack([edges[0][tree], edges[1][tree]])]], axis=1)
    return out[0], out[1]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def verified_links(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that unite what all pairs with at least this Jaccard similarity
    unite.

    Of the pairs that fingerprints allow, forests of the nearest are verified until every
    pair is of one component or has failed; all others have failed on their bits."""
    prints = np.frombuffer(b"".join(map(wide_fingerprint, sets)), np.uint64).reshape(len(sets), -1)
    sizes, budget = np.array([len(x) for x in sets]), bit_budget(least)
    label, links = np.arange(len(sets)), [np.zeros((2, 0), np.int64)]
    for at in range(0, len(sets), 512):
        d = np.zeros((len(sets[at : at + 512]), len(sets) - at), np.uint16)
        for k in range(prints.shape[1]):
            d += np.bitwise_count(prints[at : at + 512, k][:, None] ^ prints[at:, k][None])
        i, j = np.nonzero(d <= budget)
        d = d[i, j].astype(np.int64)
        i, j = i + at, j + at
        ok = (i < j) & (np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]) - 1e-9)
        i, j, d = i[ok], j[ok], d[ok]
        while len(i):
            tree = spanning(label, i, j, d)
            good = np.array([jaccard(sets[a], sets[b]) >= least - 1e-9 for a, b in zip(i[tree], j[tree], strict=True)], bool)
            links.append(np.stack([i[tree][good], j[tree][good]]))
            label = merge_labels(label, *links[-1])
            rest = np.ones(len(i), bool)
            rest[tree] = False
            rest &= label[i] != label[j]
            i, j, d = i[rest], j[rest], d[rest]
    out = np.concatenate(links, axis=1)
    return out[0], out[1]


def cell_bytes(path: int) -> list[int]:
    """The bytes of a wide fingerprint that texts of one cell of a trie share: one of the
    trie's word, and for every further level one of another word."""
    block, *more = digits(path)
    word, byte = divmod(block, WORD_BUDGET + 1)
    words = [(word + 1 + level * OTHERS + k) % WORDS for level, k in enumerate(more)]
    return [block, *(w * (WORD_BUDGET + 1) + byte for w in words)]


def wide_tries(prints: DataFrame) -> DataFrame:
    """``dealt`` rows of the tries of all words. ``prints`` has key, n and print; texts
    without words are in no trie.

    A cell is a byte of a word: one of its bytes at least is the same in both texts of a
    pair. In a crowded cell a byte of another word has to be the same too, of one of
    ``OTHERS`` words: of pairs at 0.8 that meet in the cell at least 0.89 do so again, and
    a pair meets in several cells."""
    rows, blocks = prints.where("n > 0"), WORD_BUDGET + 1

    def turn(rows: DataFrame, level: int) -> DataFrame:
        # the same rule as cell_bytes, by the digits of the path
        if not level:
            at = F.col("block")
        else:
            root = F.floor(F.col("path") / PATH_BASE**level).cast("int") - 1
            word = (F.floor(root / blocks) + 1 + (level - 1) * OTHERS + F.col("block")) % WORDS
            at = (word * blocks + root % blocks).cast("int")
        value = F.conv(F.hex(F.substr("print", at + 1, F.lit(1))), 16, 10).cast("long")
        return rows.withColumn("cell", value if not level else F.shiftleft("cell", 8).bitwiseOR(value))

    start = split_cells(rows.withColumn("path", F.lit(0)), WORDS * blocks, turn, 0)
    return dealt(start, OTHERS, turn, rows.count(), "key")


def candidates(prints: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of keys that unite what all pairs unite that the
    tries of all words propose. ``prints`` has key, n and print."""
    blocks, byte = WORD_BUDGET + 1, 8

    def walk(table: pa.Table) -> pa.Table:
        path = table.column("path")[0].as_py()
        key, raw = table.column("key").to_numpy(), np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        shared, block = cell_bytes(path), digits(path)[0]
        at = block // blocks * blocks
        own = [at + (block + k) % blocks for k in range(1, blocks)]
        value = np.zeros(len(key), np.uint64)
        for k in (*shared, *own):
            value = (value << np.uint64(byte)) | raw[:, k].astype(np.uint64)
        u, v = proposals(value, raw.view(np.uint64), table.column("n").to_numpy(), byte * len(shared), least)
        return pa.table({"a": np.minimum(key[u], key[v]), "b": np.maximum(key[u], key[v])})

    return wide_tries(prints).groupBy("path", "lead", "i", "j").applyInArrow(walk, "a long, b long").distinct()


def united(sets: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) between the sets (component, key, hashes) of one component
    that unite what all its links unite. A component of too many texts or shingles is
    dealt to salts, and every two salts meet in a task."""
    sizes = sets.groupBy("component").agg(F.count("*").alias("texts"), F.sum(F.size("hashes")).alias("shingles"))
    salts = F.greatest(F.ceil(2 * F.col("texts") / GROUP_TEXTS), F.ceil(2 * F.col("shingles") / GROUP_SHINGLES)).cast("int")
    over = sizes.where((F.col("texts") > GROUP_TEXTS) | (F.col("shingles") > GROUP_SHINGLES)).select("component", salts.alias("salts"))
    rows = sets.join(over, "component", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"), F.lit(0)))
    others = F.coalesce(F.array_remove(F.sequence(F.lit(0), F.col("salts") - 1), F.col("own")), F.array(F.lit(0)))
    rows = rows.withColumn("other", F.explode(others)).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.select("component", "i", "j", "key", "hashes")

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, lists = table.column("key").to_numpy(), table.column("hashes").chunk(0)
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy().view(np.uint64)
        u, v = verified_links([flat[x:y] for x, y in zip(ends, ends[1:], strict=False)], least)
        return pa.table({"a": np.minimum(key[u], key[v]), "b": np.maximum(key[u], key[v])})

    return rows.groupBy("component", "i", "j").applyInArrow(verify, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of docs: the id, ``text_hash`` (Spark's xxhash64 of the text),
    ``component_id``, the smallest id of all documents reached by pairs with a Jaccard
    similarity of at least ``least``, and ``component``, a number for the same group that
    tells groups apart even where ids repeat.

    Equal sets are merged first; null and empty texts are copies of each other. Tries of
    wide fingerprints propose pairs; within what these unite, all pairs whose
    fingerprints allow it are verified on the sets, unless they are united already. A
    pair at 0.8 exactly is proposed with a probability of 0.98, at 0.85 with 0.999. Rows
    repeated with the same id share their component; a null id gets a component (null if
    no other id is in it). Other columns are not read. Empty in, empty out."""

    @F.pandas_udf("key long, n int, print binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        keys, sizes, prints = [], [], []
        for t in texts:
            found = shingle_set(t, shingle)
            keys.append(set_key(found))
            sizes.append(len(found))
            prints.append(wide_fingerprint(found))
        return pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "n": sizes, "print": prints})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            keys = np.array([set_key(h) for h in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["key", "hashes"])

    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    prints = write_table(slim.select("id", "text_hash", sketch("text").alias("s")).select("id", "text_hash", "s.*"), "similar")
    first = F.min(F.struct("id", "text_hash"))
    classes = write_table(prints.groupBy("key").agg(first.alias("first"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("print").alias("print")), "similar-classes")
    groups = write_table(connected_components(write_table(candidates(classes.select("key", "n", "print"), least), "similar-pairs")).withColumnRenamed("node", "key"), "similar-groups")
    # shingle sets of the grouped texts, read again from one text of each
    needed = write_table(classes.join(groups, "key").select("first.id", "first.text_hash"), "similar-needed").alias("k")
    texts = slim.alias("t").join(needed, F.col("t.id").eqNullSafe(F.col("k.id")) & (F.col("t.text_hash") == F.col("k.text_hash"))).select("t.text")
    sets = write_table(texts.mapInArrow(whole, "key long, hashes array<long>"), "similar-sets").dropDuplicates(["key"]).join(groups, "key")
    parts = write_table(connected_components(write_table(united(sets, least), "similar-links")).withColumnRenamed("node", "key"), "similar-parts")
    grouped = classes.join(parts, "key", "left").select("key", "low", F.coalesce("component", "key").alias("component"))
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    reached = grouped.join(lows, "component").select("key", "component", "component_id")
    return prints.join(reached, "key").select(F.col("id").alias(id_col), "text_hash", "component", "component_id")


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
