"""Rankings against scores of all pairs in plain code, and against DuckDB."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from channelweave.llm import ranking

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score)."""
    read = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total, df = len(read), sum(x[2] for x in read), Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, count, size in read:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 8 * m)) for t in words(text) if count[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def corpus(r, docs, topics=6):
    """Documents that mostly use the words of one topic."""
    pick = lambda k: r.choice([f"t{k}w{int(r.expovariate(0.1))}", f"c{r.randint(0, 9)}"])
    return [(i, " ".join(pick(k) for _ in range(r.randint(1, 40)))) for i in range(docs) for k in [r.randrange(topics)]]


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    text = "The Éa_b-c 12中\U0001f600x\x00Z\x7fQ ÀB"
    assert [t.decode() for t in ranking.terms(text)] == words(text)


@pytest.mark.parametrize(("shard_docs", "block_bytes"), [(7, 1 << 19), (64, 200), (4096, 1 << 19)])
def test_brute_force(spark, shard_docs, block_bytes):
    r = random.Random(shard_docs)
    docs = corpus(r, 500)
    docs += [(1000 + k, docs[k][1]) for k in range(60)]  # equal scores
    items = [(f"i{k}", t) for k, (_, t) in enumerate(corpus(r, 25))]
    found = ranking.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), shard_docs=shard_docs, block_bytes=block_bytes)
    assert got(found) == brute(docs, items)


def test_edge_cases(spark):
    docs = [(5, "Alpha beta"), (3, "ALPHA beta"), (None, "alpha beta"), (3, "alpha beta"), (7, None), (8, ""), (9, "..."), (1, "gamma " * 60_000 + "alpha"), (2, "Éa éa")]
    items = [(1, "alpha alpha beta"), (2, None), (3, "unknown words"), (None, "gamma"), (1, "alpha alpha beta"), (4, "éa"), (5, "")]
    frame = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, item_id string, score int")
    asked = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, rank int")
    found = ranking.rank_documents(frame, asked)
    assert got(found) == brute(docs, items)
    assert got(ranking.rank_documents(frame.where("false"), asked)) == got(ranking.rank_documents(frame, asked.where("false"))) == []


def test_bisection_gathers_topics():
    """Leaves of the fitted tree hold one topic each, for new documents as well."""
    r = random.Random(2)
    names: dict[str, int] = {}
    texts = [[names.setdefault(f"{k}.{int(r.expovariate(0.2))}", len(names)) for _ in range(30)] for k in (0, 1, 2, 3) for _ in range(150)]
    rows, topic = [np.unique(t) for t in texts], np.repeat(range(4), 150)
    fit = r.sample(range(600), 300)
    tree = ranking.bisection([rows[k] for k in fit], len(names), 2)
    leaf = ranking.leaves(tree, np.cumsum([0, *map(len, rows)]), np.concatenate(rows))
    pure = sum(Counter(topic[leaf == x].tolist()).most_common(1)[0][1] for x in range(4) if (leaf == x).any())
    assert pure >= 0.95 * len(rows)


def test_stops_early(spark):
    """Shards are passed by where documents of one topic are together."""
    r = random.Random(4)
    docs = spark.createDataFrame(corpus(r, 3000), "doc_id long, text string")
    queries = next(ranking.query_blocks(spark.createDataFrame([(k, f"t{k}w1 t{k}w2 t{k}w3") for k in range(6)], "item_id long, text string"), "item_id", "text", 1 << 19))
    found = ranking.write_table(ranking.forward(docs, queries.vocabulary, "doc_id", "text"), "forward")
    n, total = found.selectExpr("count_if(n > 0)", "sum(n)").first()
    tree = ranking.bisection([np.array(x["terms"]) for x in found.where("size(terms) > 0").limit(500).collect()], len(queries.vocabulary))
    shards = ranking.write_table(ranking.into_shards(ranking.ordered(found, tree, n, total), 50), "shards")
    scorer = spark.sparkContext.broadcast(ranking.Scorer(queries, np.full(len(queries.vocabulary), 1000), 10))
    bounds = ranking.shard_bounds(shards, scorer)
    best = ranking.search(shards, scorer, docs.schema["doc_id"].dataType)
    least = best.groupBy("q").agg({"score": "min"}).withColumnRenamed("min(score)", "least")
    assert bounds.join(least, "q").where("bound >= least").count() < 0.6 * shards.count() * 6


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got(ranking.op11_ranked_search(spark, sf_dir)) == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ranking.OP11_SQL})").fetchall(), key=str)
