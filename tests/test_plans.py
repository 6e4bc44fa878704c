"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from civitext import HARM
from civitext.operators import explain, naive_bayes, prepare, profile
from civitext.operators import predict as pr
from civitext.operators import split as sp
from civitext.plans import corpora, queries
from civitext.session import materialise

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prepared(spark):
    return materialise(prepare.preprocess(corpora.harm(spark, SF_DIR), HARM), "prepared")


@pytest.fixture(scope="module")
def model(prepared):
    return naive_bayes.fit(prepared.filter("split = 'train'"), HARM)


def documents(spark):
    return corpora.table(spark, SF_DIR, "documents")


def test_text_is_normalised_once_and_after_the_label_filter(spark):
    text = plan(prepare.clean(corpora.harm(spark, SF_DIR), HARM))
    assert text.count("ArrowEvalPython") == 1
    assert len(re.findall(r"www\\\.", text)) == 1
    assert text.index("ArrowEvalPython") < text.index("BroadcastHashJoin")


def test_assigning_a_split_moves_no_rows(spark, prepared):
    table = prepared.drop("split")
    assert "Exchange" not in plan(sp.stratified_split(table))


def test_fitting_a_split_reads_keys_and_labels_only(spark, prepared):
    rows = prepared.select("label_id", sp.key_hash(F.col("doc_id"), 42).alias("h"))
    assert "ReadSchema: struct<doc_id:bigint,label_id:int>" in plan(rows)


def test_scoring_shuffles_one_row_per_text(spark, model):
    text = plan(pr.predict(documents(spark), model))
    assert text.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in text and "partial_sum" in text
    assert "SortMergeJoin" not in text and "Cartesian" not in text


def test_large_tables_are_joined_by_salted_shuffle(spark, model):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(pr.predict(documents(spark), model, max_rows=100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "salt" in text
    assert re.search(r"hashpartitioning\(token#\d+, salt#\d+", text)
    assert text.count("documents.parquet") == 1  # the texts are still read once


def test_attribution_shuffles_texts_once(spark, model):
    attributed = explain.attributions(documents(spark), model)
    for df in (attributed, explain.with_margin(attributed), explain.top_tokens(attributed), explain.plot_data(attributed)):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_attribution_with_a_large_table_still_shuffles_texts_once(spark, model):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        attributed = explain.attributions(documents(spark), model, max_rows=100)
        attributed.write.format("noop").mode("overwrite").save()
        attributed.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan(attributed).split("Initial Plan")[0]
    assert final.count("documents.parquet") == 1 and "ReusedExchange" in final


def test_attribution_with_a_large_table_moves_unsettled_token_rows_only(spark, model):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(explain.with_margin(explain.attributions(documents(spark), model, max_rows=100)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, \d+\), ENSURE_REQUIREMENTS", text)


def test_attribution_parts_follow_the_bytes_of_the_texts(spark, model, monkeypatch):
    monkeypatch.setattr(explain, "PART_BYTES", 10_000)
    size = documents(spark).agg(F.sum(F.octet_length("text"))).first()[0]
    parts = -(-size // 10_000)
    assert parts > 8
    assert explain.attributions(documents(spark), model).rdd.getNumPartitions() == parts


def test_the_linear_model_scores_texts_that_are_cleaned_once(spark):
    text = plan(queries()["linear_roundtrip"](spark, SF_DIR))
    assert "ArrowEvalPython" not in text and "documents.parquet" not in text


def test_samples_are_limited_before_the_shuffle(spark):
    text = plan(profile.sample_per_class(corpora.harm(spark, SF_DIR)))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("FileScan") == 2  # documents and labels, each read once


def test_no_query_multiplies_rows(spark, model, prepared):
    frequencies = profile.length_frequencies(profile.stack({"d": documents(spark)}, ["text"]))
    for df in (profile.length_histogram(frequencies), profile.length_median(frequencies), prepared):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ReadSchema: struct<text:string>" in plan(frequencies)
