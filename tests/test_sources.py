"""Readers and writers: bound parameters, cache, replaces, ranges, documents."""

import json

import pytest
from pyspark.sql import functions as F

from channelweave.plans import report
from channelweave.sources import documents, tables


def test_query(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert tables.query(spark, "SELECT * FROM ten WHERE id > :low", low=6).count() == 3
    assert tables.query(spark, "SELECT '{ds}' AS name, '{}' AS braces", ds="a.b").first().name == "a.b"
    with pytest.raises(ValueError, match="schema"):
        tables.query(spark, "SELECT 1", ds="x; DROP TABLE y")
    tables.execute(spark, "CREATE OR REPLACE TEMPORARY VIEW one AS SELECT 1 AS x")
    assert spark.table("one").first().x == 1


def test_cached(spark, tmp_path):
    source = f"{tmp_path}/source"
    spark.range(3).write.parquet(source)
    assert tables.cached(spark.read.parquet(source), str(tmp_path), "t").count() == 3
    spark.range(4).write.mode("overwrite").parquet(source)
    assert tables.cached(spark.read.parquet(source), str(tmp_path), "t").count() == 4  # the file has changed
    assert tables.cached(spark.read.parquet(source), str(tmp_path), "t", refresh=True).count() == 4
    spark.range(6).write.parquet(f"{source}-2")
    assert tables.cached(spark.read.parquet(f"{source}-2"), str(tmp_path), "t").count() == 6  # same schema, another path
    wide = [spark.range(2).select(*(F.lit(i).alias(f"c{i}") for i in range(40)), F.lit(x).alias("last")) for x in (1, 2)]
    assert [tables.cached(w, str(tmp_path), "w").first()["last"] for w in wide] == [1, 2]
    assert tables.cached(spark.range(5), str(tmp_path), "t").count() == 5  # another plan, same name


def test_replace_and_register(spark, sf_dir):
    assert tables.replace_table(spark.range(3), "made").count() == 3
    assert tables.replace_table(spark.range(2), "made").count() == 2
    spark.sql("DROP TABLE made")
    tables.register(spark, sf_dir, ["nation"])
    assert spark.table("nation").count() == 25


def test_ranges(spark, tmp_path):
    df = spark.createDataFrame([(i, 1) for i in (50799, 50800, 50824, 50825, 51599, 51600, 53161, None)], "itemid int, subject int")
    tables.write_ranged(df, f"{tmp_path}/r", "itemid", "subject", 50800, 51600, 25)
    got = {r.itemid: r.bucket for r in spark.read.parquet(f"{tmp_path}/r").collect()}
    assert got == {50799: -1, 50800: 50800, 50824: 50800, 50825: 50825, 51599: 51575, 51600: 51600, 53161: 51600, None: None}


def test_documents(spark, tmp_path):
    cells = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "k string, x double")
    documents.write_result(f"{tmp_path}/r.json", {"k": 13}, cells, note="n")
    assert json.loads((tmp_path / "r.json").read_text()) == {"protocol": {"k": 13}, "cells": [{"k": "a", "x": 1.5}, {"k": "b", "x": None}], "note": "n"}
    assert {r.k: r.x for r in documents.read_results(spark, [f"{tmp_path}/r.json"]).collect()} == {"a": 1.5, "b": None}
    with pytest.raises(ValueError, match="rows"):
        documents.write_result(f"{tmp_path}/s.json", {}, cells, most=1)
    documents.write_records(cells, f"{tmp_path}/l")
    documents.write_csv(cells, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/l").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["k", "x"]
    (tmp_path / "m.json").write_text('{"A": "a"}')
    assert documents.mapping(spark, documents.read_config(f"{tmp_path}/m.json"), "raw", "bucket").first().bucket == "a"


def test_report(spark):
    head = spark.createDataFrame([("d", "red", 1.0), ("e", "other", 2.0)], "db string, atom string, x double")
    more = spark.createDataFrame([("d", 0.5)], "db string, p double")
    joined = report.labelled(report.join_results(["db"], head, gate=more), "atom").orderBy("db")
    assert [tuple(r) for r in joined.collect()] == [("d", "redundant", 1.0, 0.5), ("e", "other", 2.0, None)]
    page = report.markdown("Numbers", {"All": joined.withColumn("pm", report.plus_minus("x", "gate_p"))})
    assert "| d | redundant | 1 | 0.5 | 1.0 ± 0.5 |" in page and "| e | other | 2 |  |  |" in page
