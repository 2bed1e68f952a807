"""Targets, permutations, draws and the mix itself."""

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from channelweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-3
    free = [t / mixing.WEIGHTS[i % 3] for i, (t, s) in enumerate(zip(got, sizes, strict=True)) if t < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1000, 4097):
        x = np.arange(n)
        got = mixing.permuted(x, np.full(n, n), np.full(n, 5))
        assert sorted(got) == list(x)
    assert list(mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 6))) != list(got[:1000])


def test_draws_use_up_the_quotas():
    quotas = np.array([20_000, 0, 7, 9_000])
    rows = mixing.draws(quotas)
    total = Counter()
    for shard, source, first, count in rows:
        assert first == total[source] and count > 0 and shard >= 0
        total[source] += count
    assert [total[i] for i in range(4)] == quotas.tolist()
    assert rows == mixing.draws(quotas)


def corpus(spark, n=400):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(int(rng.integers(0, 900)))), ["a", "b", None, "c"][int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))], 9) for i in range(n)]
    rows += [rows[5], rows[5], (None, "x y z", "a", 1), (7000, None, "b", 1), (7001, "", "b", 1), (7002, "long " * 30_000, "c", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def mix(docs):
    places, found = mixing.lay_out(docs)
    sources = mixing.plan(found)
    return places, sources, mixing.pieces(places, sources)


def test_mix(spark):
    docs = corpus(spark)
    places, sources, took = mix(docs)
    assert places.count() == docs.count()
    size = {(r.skey, r["at"], r["size"]): r for r in places.collect()}
    taken = defaultdict(int)
    for r in took.collect():
        taken[r.skey, r["at"], r["size"]] += r.n
    assert all(n <= 2 * k[2] for k, n in taken.items())
    assert set(taken) <= set(size)
    for s in sources:
        got = sum(n for k, n in taken.items() if k[0] == s["skey"])
        assert abs(got - s["target"]) <= 3 * mixing.BLOCK + 0.02 * s["target"]
    assert [s["skey"] for s in sources] == ["sa", "sb", "sc", "null"]
    again = mix(docs)[2]
    key = ("shard", "slot", "skey", "at", "size", "skip", "n")
    assert sorted(map(tuple, took.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


def test_documents(spark):
    docs = corpus(spark)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = {r.doc_id: set((r.text or "").split()) for r in docs.collect()}
    rows = out.collect()
    assert all(r.text and set(r.text.split()) <= words[r.doc_id] for r in rows)
    assert max(Counter(r.doc_id for r in rows if r.doc_id != 5).values()) <= 2
    assert sum(len(r.text.split()) for r in rows) > 1.3 * sum(len((r.text or "").split()) for r in docs.collect())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mix(docs)[2].count() == 0
    assert mixing.mix_documents(docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a", 0), (2, None, None, 0)], SCHEMA)
    assert mixing.mix_documents(blank).count() == 0
