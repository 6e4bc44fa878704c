import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from civitext.session import scratch_path
from civitext.sources import readers, writers

ROWS = [
    (1, 'say "hi", then', "hate", "train"),
    (2, "two\nlines and a comma,", "normal", "train"),
    (3, "  padded  ", "normal", "test"),
    (4, "back\\slash", "hate", "val"),
    (5, "NA", "normal", "val"),
    (6, None, "normal", "val"),
    (7, "", "normal", "val"),
    (8, "ሰላም 😊", None, "val"),
]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(ROWS, readers.CORPUS_SCHEMA)


def test_csv_keeps_every_text(spark, corpus):
    path = scratch_path(spark, "csv")
    writers.write_csv(corpus.repartition(3), path)
    back = readers.read_csv(spark, path).orderBy("doc_id").collect()
    # An empty field is a missing value, so the empty text comes back as NULL.
    wanted = [(k, t or None, label, split) for k, t, label, split in ROWS]
    assert [tuple(r) for r in back] == wanted


def test_missing_corpus_is_skipped(spark):
    assert readers.read_csv(spark, scratch_path(spark, "nothing")) is None


def test_one_split_reads_one_partition(spark, corpus):
    path = scratch_path(spark, "splits")
    encoded = corpus.withColumn("label_id", F.lit(0)).select("doc_id", "text", "label", "label_id", "split")
    writers.write_splits(encoded, path)
    val = readers.read_splits(spark, path, "val")
    assert {r.doc_id for r in val.collect()} == {4, 5, 6, 7, 8}
    plan = val._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert readers.read_splits(spark, path).count() == len(ROWS)


def test_union_tags_rows_and_fills_columns(spark):
    a = spark.createDataFrame([(1, "x", "hate")], "doc_id long, text string, label string")
    b = spark.createDataFrame([(2, "y")], "doc_id long, text string")
    out = readers.union_splits({"train": a, "test": b}).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "x", "hate", "train"), (2, "y", None, "test")]


def test_harmonise(spark):
    tweets = spark.createDataFrame([("a", "Hate")], "tweet string, label string")
    assert [tuple(r) for r in readers.harmonise(tweets, lower_labels=True).collect()] == [("a", "hate")]
    both = spark.createDataFrame([("a", "b")], "tweet string, text string")
    assert readers.harmonise(both).columns == ["tweet", "text"]


def test_manifest_leaves_out_what_is_empty(spark, corpus):
    manifest = writers.dataset_manifest({"a": corpus, "b": corpus.filter("doc_id > 99"), "c": None})
    path = scratch_path(spark, "manifest")
    writers.write_json(manifest, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert lines == [{"dataset": "a", "rows": 8, "columns": ["doc_id", "text", "label", "split"]}]


def test_files_of_splits_follow_bytes_and_not_tasks(spark, corpus):
    path = scratch_path(spark, "many-tasks")
    rows = spark.range(0, 20000, 1, 200).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"), F.lit("hate").alias("label"), F.lit(0).alias("label_id"))
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    writers.write_splits(rows.withColumn("split", split), path)
    back = readers.read_splits(spark, path)
    assert back.count() == 20000 and len(back.inputFiles()) <= 8
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:  # a split larger than a file of that size is cut
        writers.write_splits(rows.withColumn("split", split), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert readers.read_splits(spark, path).count() == 20000
    assert len([f for f in readers.read_splits(spark, path).inputFiles() if "split=train" in f]) > 2


def test_sinks_replace_or_refuse(spark, corpus):
    path = scratch_path(spark, "twice")
    encoded = corpus.withColumn("label_id", F.lit(0)).select("doc_id", "text", "label", "label_id", "split")
    for write, rows, read in ((writers.write_csv, corpus, readers.read_csv), (writers.write_splits, encoded, readers.read_splits)):
        own = f"{path}/{write.__name__}"
        write(rows, own)
        write(rows.limit(2), own)
        assert read(spark, own).count() == 2
        with pytest.raises(AnalysisException):
            write(rows, own, mode="error")
        assert read(spark, own).count() == 2
