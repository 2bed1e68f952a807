"""Fingerprints and groups against brute force, also with crowded cells."""

import random
import re

import pytest
import xxhash

from channelweave.llm import simhash
from channelweave.llm.simhash import fingerprint, near_duplicates

SCHEMA = "doc_id long, text string, fingerprint int"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """(id or None, fingerprint) -> smallest id reachable."""
    values = sorted({f for _, f in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    low = {}
    for i, f in prints:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return {(i, f): low.get(find(f)) for i, f in prints}


def corpus(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 40)) for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(300):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return [*rows, (900, None), (901, ""), (902, " \t\x0b"), (903, "One"), (904, "one"), (905, "A b"), (None, "one"), (906, "É É é"), (907, "x y " * 40_000), (3, "again id"), (905, "A b")]


@pytest.mark.parametrize("crowd", [None, 5, 1])
def test_same_as_brute_force(spark, monkeypatch, crowd):
    """Crowded cells are salted (5) or told apart by further blocks (1)."""
    if crowd:
        monkeypatch.setattr(simhash, "TRIE_ROWS", 4)
        monkeypatch.setattr(simhash, "CELL_ROWS", crowd)
    rows = corpus(4)
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    assert [fingerprint(t) for _, t in rows] == [f for _, f in prints]
    got = near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)).collect()
    want = components(prints)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((i, f"{f:016x}", want[i, f]) for i, f in prints), key=str)


def test_trie_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    near = [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base]
    values = np.unique(np.r_[base, np.array(near, np.uint64)])
    got = {(int(a), int(b)) for u, v in simhash.trie_links(values, 0, 3) for a, b in zip(u, v, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("max_bits", [2, 3])
def test_blocks_in_front(spark, monkeypatch, max_bits):
    """Close values in few cells, all of which are split twice: links as all pairs'."""
    monkeypatch.setattr(simhash, "TRIE_ROWS", 2)
    monkeypatch.setattr(simhash, "CELL_ROWS", 1)
    rng = random.Random(max_bits)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        v = rng.getrandbits(64) & ~0xFFFF_FFFF_0000
        values |= {v} | {v ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(1, 6)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    found = simhash.fingerprint_links(spark.createDataFrame(signed, "simhash long"), max_bits).collect()
    links = {(a % (1 << 64), b % (1 << 64)) for a, b in found}
    assert links <= {(a, b) for a in values for b in values if a != b}

    def parts(pairs):
        root = {v: v for v in values}
        for a, b in pairs:
            a, b = root[a], root[b]
            root = {v: min(a, b) if r in (a, b) else r for v, r in root.items()}
        return root

    every = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= max_bits]
    assert parts(links) == parts(every)


def test_turned_back():
    import numpy as np

    values = np.random.default_rng(2).integers(0, 1 << 63, 50, np.uint64)
    for path in (1, 3, 64 * 2 + 4, (64 * 3 + 2) * 64 + 4):
        assert len(np.unique(simhash.turned_back(values, path, 4))) == 50
    assert (simhash.turned_back(values, 1, 4) == values).all()
    assert int(simhash.turned_back(np.array([1 << 63], np.uint64), 2, 4)[0]) == 1 << 47


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
