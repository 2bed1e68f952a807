"""A corpus pipeline of five stages: language identification, near-duplicates,
benchmark decontamination, mixing of sources, and sharding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last give the columns of
``documents``. The stages work on all that the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelweave.llm.decontaminate import find_contamination, remove_spans
from channelweave.llm.langid import UNKNOWN, fit, held_out, predict
from channelweave.llm.mixing import mix_documents
from channelweave.llm.sharding import assign_shards
from channelweave.llm.shared import shared_dir
from channelweave.llm.simhash import similar_documents

#: A document goes if the network gives no language at least this probability. Of held-out
#: labelled documents (10,000 documents in four languages) all 3352 that are told right
#: have at least 0.59, so a majority of the probability is asked for.
LEAST_SCORE = 0.5
#: A document goes if so many of its words are a benchmark's; else only those words go.
MOST_HIT = 0.5
#: Near-duplicates: documents whose sets of so many words have at least this similarity.
SHINGLE, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language; null texts and texts without letters go."""
    found = predict(docs, fit(docs.where(~held_out())))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id; of
    several texts under this id that with the least hash, and of rows that repeat both
    the least by all columns. Null and empty texts are one group. Empty in, empty out."""
    found = similar_documents(docs.select("doc_id", "text"), shingle=SHINGLE, least=SIMILARITY)
    ahead = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    kept = ahead.groupBy("component").agg(F.min_by(F.struct("doc_id", "text_hash", "times"), "text_hash").alias("k"))
    same = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("text") == F.col("k.text_hash"))
    rows = docs.join(kept.select("k"), same).select(*docs.columns, F.col("k.times").alias("_times"))
    once = rows.where("_times = 1").select(*docs.columns)
    often = rows.where("_times > 1").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min(F.struct(*docs.columns)).alias("r"))
    return once.unionByName(often.select("r.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of benchmark items out; drop documents that are mostly such words."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="_found")
    hit = F.aggregate(F.zip_with("_found.ends", "_found.starts", lambda b, a: b - a), F.lit(0), lambda s, x: s + x)
    clean = remove_spans(found.where(hit <= MOST_HIT * F.col("_found.n_words")), found="_found")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents once for each pass that takes words of them."""
    return mix_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard; no shard has more bytes of text than the limit."""
    return assign_shards(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("sharding", shard),
]
#: SQL can't express the network or the fingerprints; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
