"""Each stage of the pipeline against a plain version, on its own input."""

from collections import Counter

import corpus_pipeline as cp
import pytest

from tests.llm.test_decontaminate import brute, words
from tests.llm.test_similar import brute as similar


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(90_001, None, "en", "src1", 0), (90_002, "12 34 !?", "en", "src1", 8), (90_003, "", None, None, 0), (90_001, None, "en", "src1", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for name, stage in cp.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "mix_sources", "sharding"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_language(stages):
    was, now = stages[0].collect(), {r.doc_id for r in stages[1].collect()}
    assert not {90_001, 90_002, 90_003} & now
    clean = [r.doc_id for r in was if r.text and any(map(str.isalpha, r.text))]
    assert len(now) >= 0.99 * len(clean)


def test_near_duplicates(stages):
    """One document of each group that pairs with a Jaccard similarity of 0.8 make."""
    want = set(similar([(r.doc_id, r.text) for r in stages[1].collect()]).values())
    assert Counter(r.doc_id for r in stages[2].collect()) == Counter(want)


def test_decontamination(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    texts, now = dict(docs), {r.doc_id: r for r in stages[3].collect()}
    for i, n, hit, _ in brute(docs, items):
        if len(hit) > cp.MOST_HIT * n:
            assert i not in now
        else:
            gone = set(hit)
            assert words(now[i].text) == [w for k, w in enumerate(words(texts[i])) if k not in gone] and now[i].n_chars == len(now[i].text)
            assert hit or now[i].text == texts[i]


def test_mix(stages):
    was = {r.doc_id: r for r in stages[3].collect()}
    sizes, taken = Counter(), Counter()
    for r in was.values():
        sizes[r.source] += len(r.text.split())
    seen = Counter()
    for r in stages[4].collect():
        seen[r.doc_id] += 1
        mine, whole = r.text.split(), was[r.doc_id].text.split()
        at = 0
        for w in mine:  # words of the document, in order
            at = whole.index(w, at) + 1
        taken[r.source] += len(mine)
    assert max(seen.values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())


def test_shards(stages):
    sums = Counter()
    rows = stages[5].collect()
    for r in rows:
        sums[r.shard] += len(r.text.encode())
    assert len(rows) == stages[4].count() and all(r.shard_bytes == sums[r.shard] for r in rows)
