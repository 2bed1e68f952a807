"""Removal against brute force, also with prefixes that are made longer."""

import random

import pytest

from channelweave.llm import substring
from channelweave.llm.substring import remove_repeats

SCHEMA = "doc_id long, text string, n_words int"


def brute(rows, window):
    docs = [(i, (t or "").split()) for i, t in rows]
    key = lambda i: (i is not None, i or 0)
    first = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, (key(i), s)), (key(i), s))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def texts(seed, n=120):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"u{rng.randint(0, 300)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows


@pytest.mark.parametrize(("window", "prefix", "prefix_rows"), [(20, 6, 1 << 14), (20, 6, 10), (20, 6, 1), (8, 3, 4), (5, 5, 1 << 14), (5, 5, 2)])
def test_same_as_brute_force(spark, window, prefix, prefix_rows):
    rows = texts(window + prefix_rows)
    rows += [(None, "same " * 50), (500, "same " * 50), (501, None), (502, ""), (503, "x"), (3, rows[4][1]), rows[7], rows[7], (504, "a  b c " * 30_000)]
    got = remove_repeats(spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA), window=window, prefix=prefix, prefix_rows=prefix_rows).collect()
    # as in the contract, words are parted by ASCII white space only
    plain = [(i, t and t.replace(" ", "_")) for i, t in rows]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept.replace(" ", "_")) for r in got], key=str) == brute(plain, window)
    assert all(sum(s.n for s in r.spans) == r.n_removed for r in got)


def test_crowded_prefixes(spark):
    """One phrase in front of many words, one line over and over in one document, and words
    that agree in the phrase's anchor only: prefixes of every length, as brute force has it."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 3)}"
    phrase = "the quick brown fox jumps over"
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(0, 20))), phrase, *(word() for _ in range(rng.randint(0, 20)))])) for i in range(300)]
    rows += [(1000, " ".join(f"line{k}" for k in range(25)) * 1 + " " + (" ".join(f"line{k}" for k in range(25)) + " ") * 400)]
    got = remove_repeats(spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA), prefix_rows=20).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == brute(rows, 20)


def test_codes_of_64_bits():
    """Words are told apart by all 64 bits of their codes within a tree, too."""
    codes, ends = substring.coded(["a b c"], substring.Codes())
    assert codes.dtype == "uint64" and list(ends) == [3] and (codes > 1 << 32).all()


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert remove_repeats(spark.createDataFrame([(1, None, 0)], SCHEMA)).first().kept == ""
