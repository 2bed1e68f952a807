"""Near copies against exact Jaccard similarity of all pairs, and the pipeline's recall."""

import random

import numpy as np

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from channelweave.llm import simhash
from channelweave.llm.simhash import similar_documents

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, least=0.8):
    """id -> smallest id reached."""
    ids, sets = [i for i, _ in rows], [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root[find(i)] = find(j)
    low = {}
    for i, k in enumerate(ids):
        low[find(i)] = min(low.get(find(i), k), k)
    return {k: low[find(i)] for i, k in enumerate(ids)}


def planted():
    """Copies of texts with a few words replaced, so that similarities lie around 0.8."""
    rng = random.Random(5)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(rng.choice([1, 4, 8])):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    return [*rows, (900, None), (901, ""), (902, "One two"), (903, "one  two"), (904, "one three")]


@pytest.mark.parametrize("crowd", ["", "salted", "split"])
def test_same_as_all_pairs(spark, monkeypatch, crowd):
    if crowd:
        monkeypatch.setattr(simhash, "TRIE_ROWS", 4)
        monkeypatch.setattr(simhash, "CELL_ROWS", 2 if crowd == "salted" else 1)
        monkeypatch.setattr(simhash, "GROUP_TEXTS", 4)
    rows = planted()
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("swaps", [1, 3, 5])
def test_stage_drops_planted_copies(spark, sf_dir, swaps):
    """Copies with a similarity of 0.8 and more go; what is below stays."""
    rng = random.Random(swaps)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near, far = list(base), list(base)
    for k in range(swaps):
        near[20 + 50 * k] = f"x{k}"
    for k in range(15):
        far[10 + 18 * k] = f"y{k}"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], SCHEMA)
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, sf_dir).collect()) == [1, 3]


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, None)], SCHEMA)
    assert sorted(((r.doc_id, r.component_id) for r in similar_documents(docs).collect()), key=str) == [(1, 1), (1, 1), (None, 1), (None, None)]
    assert similar_documents(docs.where("doc_id = 2")).count() == 0


def test_repeated_ids_in_the_stage(spark, sf_dir):
    """Of one id with two texts both groups keep a row, of one group one row."""
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(1, a, "x"), (1, a + " more", "x"), (1, b, "x"), (2, b, "x"), (1, b, "a"), (1, b, "a"), (3, None, "x"), (3, "", "x"), (None, "alone", "x")]
    got = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA + ", extra string"), sf_dir).collect()
    assert len(got) == 4 and {(r.doc_id, r.extra) for r in got if r.text == b} == {(1, "a")}
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "3", "None"]


def test_recall_at_the_least_similarity():
    """Pairs of sets with a Jaccard similarity of 0.8 are proposed by nearly all tries."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(300):
        both, one, other = np.split(rng.integers(0, 1 << 63, 360, np.uint64), [288, 324])
        prints = [np.frombuffer(simhash.wide_fingerprint(np.sort(np.r_[both, x])), np.uint64) for x in (one, other)]
        apart = np.bitwise_count(prints[0] ^ prints[1]).sum()
        words = np.bitwise_count((prints[0] ^ prints[1]).view(np.uint8)).reshape(simhash.WORDS, -1).sum(1)
        found += apart <= simhash.bit_budget(0.8) and words.min() <= simhash.WORD_BUDGET
    assert found >= 0.96 * 300


@pytest.mark.parametrize("level", [1, 2])
def test_recall_of_split_cells(level):
    """Pairs at 0.8 that meet in no cell but split ones are still proposed."""
    rng = np.random.default_rng(7)
    base, blocks, found = simhash.PATH_BASE, simhash.WORD_BUDGET + 1, 0
    paths = range(1, 1 + simhash.WORDS * blocks)
    for _ in range(level):
        paths = [base * p + k + 1 for p in paths for k in range(simhash.OTHERS)]
    shared = np.array([simhash.cell_bytes(p) for p in paths])
    assert all(len(set(x // blocks)) == level + 1 for x in shared)
    for _ in range(300):
        both, one, other = np.split(rng.integers(0, 1 << 63, 360, np.uint64), [288, 324])
        prints = [np.frombuffer(simhash.wide_fingerprint(np.sort(np.r_[both, x])), np.uint8) for x in (one, other)]
        apart = np.bitwise_count(prints[0] ^ prints[1])
        words = apart.reshape(simhash.WORDS, -1).sum(1)
        meets = (apart[shared] == 0).all(1) & (words[shared[:, 0] // blocks] <= simhash.WORD_BUDGET)
        found += apart.sum() <= simhash.bit_budget(0.8) and meets.any()
    assert found >= 0.96 * 300


def test_rows_of_the_tries_grow_with_the_input(spark, monkeypatch):
    """Twice the texts, beyond crowded cells, give twice the rows (with salts: four times);
    a hundredth is for the few cells that are crowded by chance a level below."""
    monkeypatch.setattr(simhash, "TRIE_ROWS", 2)
    monkeypatch.setattr(simhash, "CELL_ROWS", 4)

    def rows(n):
        prints = spark.range(n).select(F.col("id").alias("key"), F.lit(9).alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 384)).alias("print"))
        return simhash.wide_tries(prints).count()

    one, two = rows(9000), rows(18000)
    assert two <= 2.01 * one and two <= 1.01 * 18000 * simhash.WORDS * 3 * simhash.OTHERS


def test_dense_group_is_not_its_square(spark):
    """Many near copies of one text: the forest has about a row for each."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [simhash.shingle_set(t) for _, t in rows]
    prints = [(i, len(h), bytearray(simhash.wide_fingerprint(h))) for i, h in enumerate(sets)]
    pairs = simhash.candidates(spark.createDataFrame(prints, "key long, n int, print binary"), 0.8).count()
    assert pairs < 1500 * simhash.WORDS
    assert {r.component_id for r in similar_documents(docs).collect()} == {0}
