"""Links and components against brute force, and rows that link with nothing."""

import numpy as np
import pytest

from channelweave.llm import embeddings
from channelweave.llm.embeddings import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, np.float64)).all() and np.any(np.array(v))]
    dim = max((len(v) for _, v in ok), default=1)
    x = np.array([np.r_[v, np.zeros(dim - len(v))] / np.linalg.norm(v) for _, v in ok]).reshape(-1, dim)
    hit = x @ x.T >= cosine
    low = np.array([i for i, _ in ok])
    links = hit.sum(1) - 1
    while len(ok):
        new = np.where(hit, low[None], np.iinfo(np.int64).max).min(1)
        if (new == low).all():
            break
        low = new
    told = {}
    for (i, _), n, c in zip(ok, links, low, strict=True):
        told.setdefault(i, []).append((int(n), int(c)))
    return told


def vectors(seed, n, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, 16))
    return [(i, (centres[rng.integers(len(centres))] + noise * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("noise", [0.05, 0.25])
def test_same_as_brute_force(spark, noise):
    rows = vectors(3, 600, noise)
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    got = near_duplicate_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    want = brute(rows)
    assert {r.vec_id: [(r.n_links, r.component_id)] for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_oversized_leaves(spark, monkeypatch):
    """Small limits: leaves are split on their own quantiles, and what cannot be is salted."""
    monkeypatch.setattr(embeddings, "GROUP_ROWS", 60)
    monkeypatch.setattr(embeddings, "LEVELS", 3)
    rng = np.random.default_rng(5)
    one = rng.normal(size=8).astype(np.float32)
    rows = [(i, (one * np.float32(1 + i / 7)).tolist()) for i in range(150)]  # one direction, no split
    rows += [(1000 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    got = near_duplicate_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r.vec_id: [(r.n_links, r.component_id)] for r in got} == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e-30, 0.0]), (9, [3e38, 0.0, 0.0]), (None, [0.0, 1.0])]
    got = near_duplicate_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert all(by[i] == (0, i, True) for i in range(1, 7))
    assert by[7] == (3, 7, True) and by[8] == (3, 7, False) and by[9] == (3, 7, False)
    assert by[None] == (0, None, True)
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_on_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = embeddings.op5_embedding_dedup(spark, sf_dir).collect()
    assert {r.vec_id: [(r.n_links, r.component_id)] for r in got} == brute(rows)


def test_recall_of_a_forest_that_splits(spark, monkeypatch):
    """Trees of many leaves over 4000 vectors: nearly all linked pairs meet in a leaf, and
    reruns with other partitions agree."""
    monkeypatch.setattr(embeddings, "LEAF_ROWS", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(1000, 32))
    x = (centres[rng.integers(0, 1000, 4000)] + rng.normal(scale=0.15, size=(4000, 32))).astype(np.float32)
    tree = embeddings.Tree(x.astype(float), 4000, 1)
    assert sum(left < 0 for left in tree.left) > 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = int((unit @ unit.T >= 0.9).sum()) - 4000
    got = [{r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(d).collect()} for d in (df, df.repartition(7))]
    assert want > 1000 and 0.9 * want <= sum(got[0].values()) <= want and got[0] == got[1]


def test_near_copies_take_a_row_for_each_leaf(spark, monkeypatch):
    """A dense group in many leaves: counts as all pairs give them, rows written in proportion
    to the vectors and not to their pairs."""
    monkeypatch.setattr(embeddings, "LEAF_ROWS", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=16) + rng.normal(scale=0.02, size=(700, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "cls long, v array<float>, n long")
    found = embeddings.linked(df, 0.9, 8, 1).collect()
    assert len(found) < 40 * len(rows)
    more = dict.fromkeys(range(700), 0)
    for r in found:
        more[r.cls] += r.more
    want = {i: n for i, [(n, _)] in brute(rows).items()}
    assert all(more[i] <= want[i] for i in want) and sum(more.values()) >= 0.9 * sum(want.values())
