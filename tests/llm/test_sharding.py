"""Shards: whole, within the limit, and split no more than needed."""

from collections import defaultdict

from channelweave.llm.sharding import BITS, assign_shards

SCHEMA = "doc_id long, text string, shard int, cell int, depth int"


def check(spark, rows, limit):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA)
    got = assign_shards(docs, limit=limit).collect()
    assert len(got) == len(rows)
    sums = defaultdict(int)
    for r in got:
        assert r.bytes == len((r.text or "").encode())
        sums[r.shard] += r.bytes
    for r in got:
        assert r.shard_bytes == sums[r.shard] and (sums[r.shard] <= limit or len(r.shard) == BITS)
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # no shard lies in another
    for name in names:  # a bucket was split only because it was too large
        if name:
            assert sum(n for s, n in sums.items() if s.startswith(name[:-1])) > limit
    return got


def test_shards(spark):
    rows = [(i, "é" * (i % 50)) for i in range(2000)]
    assert len({r.shard for r in check(spark, rows, 5000)}) > 15
    assert {r.shard for r in check(spark, rows, 1 << 30)} == {""}


def test_hot_and_odd_rows(spark):
    rows = [(i, "x" * 10) for i in range(300)] + [(7, "copy" * 10)] * 200 + [(8, "y" * 5000), (None, "n"), (9, None), (None, None), (10, "")]
    got = check(spark, rows, 1000)
    assert {len(r.shard) for r in got if r.doc_id == 8 and r.text[0] == "y"} == {BITS}
    assert len({r.shard for r in got if r.doc_id == 7 and r.text != "x" * 10}) == 1


def test_empty(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.shard for r in assign_shards(spark.createDataFrame([(1, None, 1, 1, 1)], SCHEMA)).collect()} == {""}
