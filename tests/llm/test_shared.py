"""The session's settings and the shared folder are as before after the operators."""

from channelweave.llm import shared, simhash, warc


def test_settings_stay(spark, sf_dir):
    was = dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.checkpoint.dir")}
    warc.op9_warc_transactions(spark, sf_dir).count()
    simhash.op6_simhash_dedup(spark, sf_dir).count()
    assert was == dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.checkpoint.dir")}


def test_tables_are_written_and_dropped(spark):
    t = shared.write_table(spark.range(10), "test")
    files = t.inputFiles()
    assert t.count() == 10 and files[0].split("file:")[-1].lstrip("/").startswith(shared.shared_dir(spark).lstrip("/"))
    shared.drop_table(t)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (5, 5), (None, 4)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys((3, 7, 9), 3)}
