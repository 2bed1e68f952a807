"""Hits against brute force, blocks of items, and cutting spans out."""

import random
import re

from channelweave.llm.decontaminate import find_contamination, remove_spans

SCHEMA = "doc_id long, text string, starts int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            b = words(text)
            n = min(10, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    names.add("null" if name is None else str(name))
        out.append((i, len(w), sorted(hit), sorted(names)))
    return out


def data(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.choice([3, 9, 10, 14, 40])))) for k in range(20)]
    items += [(50, None), (51, ""), (52, "!?"), (None, "single"), (1, "again w1 w2"), (53, "Ünïcode Wörds x1 y2 z3 a4 b5 c6 d7 e8 f9")]
    docs = []
    for i in range(60):
        parts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(1, rng.choice(items)[1] or "")
        docs.append((i, rng.choice([" ", ", ", "\n-- "]).join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "... single."), (103, "a b " * 60_000 + "single"), (None, "SINGLE"), (5, "single single")]
    return docs, items, spark.createDataFrame([(i, t, 0) for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")


def test_same_as_brute_force(spark):
    docs, items, d, b = data(spark)
    want = brute(docs, items)
    for size in (1_000_000, 20):  # one broadcast, and many
        rows = find_contamination(d, b, block_words=size).collect()
        got = [(r.doc_id, r.found.n_words, sorted(k for a, z in zip(r.found.starts, r.found.ends, strict=True) for k in range(a, z)), r.found["items"]) for r in rows]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_cut(spark):
    docs, _, d, b = data(spark)
    found = find_contamination(d, b)
    was = {(r.doc_id, r.text): r.found for r in found.collect()}
    clean = remove_spans(found).collect()
    assert len(clean) == len(docs)
    for i, t in docs:
        f = was[i, t]
        kept = [w for k, w in enumerate(words(t)) if not any(a <= k < z for a, z in zip(f.starts, f.ends, strict=True))]
        assert any(r.doc_id == i and words(r.text) == kept for r in clean)


def plain_cut(text, spans):
    """The text without the spans' words and what stands between them, byte by byte."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    gone = {k for a, z in spans for k in range(places[a][0], places[z - 1][1])}
    return bytes(c for k, c in enumerate(raw) if k not in gone).decode()


def test_cut_keeps_the_rest_as_it_was(spark):
    rng = random.Random(5)
    marks, letters = [" ", "\n", "--", ", ", "\t!", "$1_", "\\"], ["a", "Zz", "9", "é", "日本", "😀x", "_b"]
    rows = []
    for i in range(200):
        text = "".join(rng.choice(marks) * rng.randrange(1, 3) + rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        text = (text if i % 2 else text.lstrip()) + rng.choice(["", "...", "\n"])
        n, spans, at = len(words(text)), [], 0
        while at < n and rng.random() < 0.7:
            a = rng.randrange(at, n)
            z = rng.randrange(a + 1, n + 1)
            spans.append((a, z))
            at = z + 1
        rows.append((i, text, "mine", ([a for a, _ in spans], [z for _, z in spans])))
    rows += [(200, None, "mine", ([], [])), (201, "", "mine", ([], [])), (202, "a " * 50_000 + "end", "mine", ([0], [50_000]))]
    d = spark.createDataFrame(rows, "doc_id long, text string, _pieces string, found struct<starts: array<int>, ends: array<int>>")
    got = {r.doc_id: (r.text, r._pieces) for r in remove_spans(d).collect()}
    for i, text, mine, (starts, ends) in rows:
        spans = list(zip(starts, ends, strict=True))
        assert got[i] == (plain_cut(text, spans) if spans else text, mine), i


def test_empty(spark):
    _, _, d, b = data(spark)
    assert find_contamination(d, b.where("false")).where("size(found.starts) > 0").count() == 0
    assert find_contamination(d.where("false"), b).count() == 0
