"""Base counts against plain code, references against counters, verdicts on planted junk."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from channelweave.llm import quality

SMALL = "the of and to in is that for it was on with as be by this are from at or".split()


def prose(r, words=300):
    """Common words in falling shares, and long ones that are hardly ever the same."""
    out = [r.choices(SMALL, [1 / (k + 1) for k in range(len(SMALL))])[0] if r.random() < 0.5 else "".join(r.choices("aeioulnrst", k=r.randint(4, 9))) for _ in range(words)]
    return "\n".join(" ".join(out[k : k + 12]).capitalize() + "." for k in range(0, words, 12))


def plain_repeats(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_counts():
    r = random.Random(1)
    for _ in range(300):
        words = ["".join(r.choices("aé中#", k=r.randint(1, 2))) for _ in range(r.randint(0, 25))]
        text = "".join(w + r.choice([" ", "\n", "\t ", "\n\n", " ", "\r\n"]) for w in words)
        plain = [w for w in text.replace(" ", "_").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        want = len(plain), sum(map(len, plain)), text.count("#"), len(lines) - len(set(lines)), plain_repeats(plain)
        assert quality.base_counts(text, text.encode()) == want, text


def test_class_counts():
    text = "aB3 \t.#éЖ—中\U0001f600\x7f"
    assert quality.class_counts(text).tolist() == [1, 1, 1, 2, 1, 2, 1, 1, 1, 1, 1]


def test_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([[0.5, 0.5, 0], [0, 0, 1], [0.25, 0.25, 0.5]])
    d = quality.js_squared(p, q)
    assert d[0] == 0 and d[1] == pytest.approx(1) and 0 < d[2] < 1
    assert quality.js_squared(q[2], p) == pytest.approx(d[2])


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(5)
    good = [prose(r) for _ in range(60)]
    junk = [
        " ".join(w + r.choice(["###", "$$$", "&&&"]) for w in prose(r).split()), prose(r).upper().replace(" ", "!! "),
        " | ".join("".join(r.choices("aeioulnrst", k=8)) for _ in range(300)), " ".join(["again and again"] * 100),
    ]
    rows = [(k, t, "en", 9) for k, t in enumerate(good)] + [(100 + k, t, "en", 9) for k, t in enumerate(junk)]
    rows += [(200, None, "en", 9), (201, "", None, 9), (202, prose(r, 49), "xx", 9), (203, good[0], None, 9), (0, good[0], "en", 9), (204, prose(r, 60_000), "en", 9), (None, good[1], "xx", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, word int")
    refs = quality.language_references(docs)
    return docs, refs, quality.apply_rules(docs, refs).collect()


def test_references(judged):
    docs, refs, _ = judged
    words = Counter(w for r in docs.collect() if r["text"] and r["lang"] == "en" for w in quality.terms(r["text"].encode()))
    assert refs.langs == ["en"]  # of the other language there are too few words
    top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
    assert [refs.words[0][refs.bins[w][0][1]] for w, _ in top] == pytest.approx([n / words.total() for _, n in top])
    assert refs.words.sum() == pytest.approx(1) and refs.classes.sum() == pytest.approx(1)


def test_verdicts(judged):
    docs, _, rows = judged
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["rules"])
    assert len(rows) == docs.count() and rows[0]["word"] == 9
    assert all(x["kept"] for k in [*range(60), 203, 204, None] for x in got[k])
    assert len(got[0]) == 2 and got[0][0] == got[0][1] == got[203][0]
    assert not any(got[100 + k][0]["kept"] for k in range(4))
    assert [got[100 + k][0]["base_failed"] for k in range(4)] == [False, False, False, True]
    assert got[100][0]["class_distance"] > quality.CLASS_DISTANCE and got[102][0]["word_distance"] > quality.WORD_DISTANCE
    assert got[200][0]["n_words"] == got[201][0]["n_words"] == 0 and got[202][0]["base_failed"] and got[202][0]["word_distance"] is None


def test_empty(spark, judged):
    docs, refs, _ = judged
    none = docs.where("false")
    assert quality.language_references(none).langs == [] and quality.apply_rules(none, refs).count() == 0
    alone = quality.apply_rules(docs.where("doc_id IN (1, 103)"), quality.language_references(none)).collect()
    assert {r["doc_id"]: r["rules"]["kept"] for r in alone} == {1: True, 103: False}  # base rules only


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(quality.OP12_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, quality.op12_quality_rules(spark, sf_dir).select(names).collect())) == sorted(want.fetchall())
