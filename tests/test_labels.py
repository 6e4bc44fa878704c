import pytest
from pyspark.sql import functions as F

from civitext import HARM, VERACITY, get_task
from civitext.functions import labels
from civitext.operators import naive_bayes, prepare


def encode(spark, task, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, label string")
    return [r.label_id for r in prepare.encode_labels(rows, task).orderBy("doc_id").collect()]


def test_known_labels(spark):
    assert encode(spark, "hate_speech", ["hate", "abusive", "normal"]) == [0, 1, 2]
    assert encode(spark, "fake_news", ["fake", "real"]) == [0, 1]


def test_case_and_blanks(spark):
    assert encode(spark, HARM, ["HATE", "Abusive", "Normal", " Offensive\t", "\u3000hate\u00a0"]) == [0, 1, 2, 1, 0]


def test_unknown_and_null_are_dropped_and_counted(spark):
    values = ["hate", "UNKNOWN", "normal", None, ""]
    assert encode(spark, HARM, values) == [0, 2]
    rows = spark.createDataFrame([(v,) for v in values], "label string")
    assert tuple(prepare.unknown_labels(rows, HARM).first()) == (5, 2, 3)


def test_decode_is_canonical(spark):
    row = spark.range(1).select(*(labels.decode(F.lit(i), HARM) for i in range(4))).first()
    assert tuple(row) == ("hate", "abusive", "normal", None)


def test_unknown_task_is_an_error():
    assert get_task("fake_news") is VERACITY
    with pytest.raises(ValueError):
        get_task("sentiment")


def test_project_keeps_key_and_split(spark):
    rows = spark.createDataFrame(
        [(1, "a", "hate", "train", 5), (2, None, "hate", "train", 5), (3, "c", None, "test", 5)],
        "doc_id long, content string, tag string, split string, extra int",
    )
    out = prepare.project(rows, "content", "tag")
    assert out.columns == ["doc_id", "text", "label", "split"]
    assert [r.doc_id for r in out.collect()] == [1]


def test_a_table_of_many_labels(spark):
    size = 100_000
    table = spark.range(size).select(F.lit("big").alias("task"), F.concat(F.lit("Label "), "id").alias("label"), F.col("id").cast("int").alias("label_id"), F.lit(True).alias("canonical"))
    table = table.union(spark.createDataFrame([("big", " label 7\t", 3, False), ("other", "label 8", 1, True), ("big", None, 5, False)], "task string, label string, label_id int, canonical boolean"))
    rows = spark.createDataFrame([(1, "LABEL 99999 "), (2, "label 7"), (3, "nothing"), (4, None), (5, "\u00a0label 8"), (5, "label 8")], "doc_id long, label string")
    for limits in ({}, {"max_rows": 10}, {"max_bytes": 10}):
        out = prepare.encode_labels_by_table(rows, table, "big", **limits)
        assert sorted((r.doc_id, r.label_id) for r in out.collect()) == [(1, 99999), (2, 3), (5, 8), (5, 8)]
        assert out.columns == ["doc_id", "label", "label_id"]
    assert "BroadcastHashJoin" in prepare.encode_labels_by_table(rows, table, "big")._jdf.queryExecution().executedPlan().toString()
    decoded = prepare.decode_labels_by_table(spark.createDataFrame([(7,), (-1,)], "label_id int"), table, "big")
    assert {(r.label_id, r.label) for r in decoded.collect()} == {(7, "Label 7"), (-1, None)}


def test_the_tasks_as_a_table(spark):
    table = prepare.label_map(spark, HARM, VERACITY)
    rows = spark.createDataFrame([(" Offensive",), ("HATE",), ("x",), (None,)], "label string")
    assert sorted(map(tuple, prepare.encode_labels_by_table(rows, table, HARM.name).collect())) == sorted(map(tuple, prepare.encode_labels(rows, HARM).collect()))
    names = prepare.decode_labels_by_table(spark.range(3).select(F.col("id").cast("int").alias("label_id")), table, HARM.name)
    assert {r.label_id: r.label for r in names.collect()} == dict(enumerate(HARM.labels))


def test_drops_are_counted_while_the_table_is_written(spark):
    rows = [(1, "good text", "hate"), (2, None, "hate"), (3, "good text", None), (4, "good text", "??"), (5, "@user ab", "normal"), (6, "fine text", "NORMAL"), (7, "", "??")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    counts = prepare.DropCounts()
    out = prepare.preprocess(df, HARM, counts=counts)
    assert counts.dropped() == {"n_rows": 7, "n_missing": 2, "n_unknown": 2, "n_near_empty": 1, "n_kept": 2}
    assert counts.rows() == {"read": 7, "missing": 5, "unknown": 3, "near_empty": 2} and out.count() == 2
    plan = prepare.clean(df, HARM, counts=prepare.DropCounts())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("CollectMetrics") == 4
    empty = prepare.DropCounts()
    prepare.preprocess(df.limit(0), HARM, counts=empty)
    assert set(empty.dropped().values()) == {0}


def test_texts_of_two_tasks_are_cleaned_once(spark):
    rows = [(i, f"some text {i}" if i % 9 else "x", ["hate", "normal", "abusive", "?"][i % 4], ["fake", "real", None][i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, harm string, veracity string")
    table = prepare.preprocess_tasks(df, {"hate_speech": "harm", "fake_news": "veracity"})
    models = naive_bayes.fit_tasks(table, ["hate_speech", "fake_news"])
    for task, column in ((HARM, "harm"), (VERACITY, "veracity")):
        alone = prepare.preprocess(df.select("doc_id", "text", F.col(column).alias("label")), task)
        assert sorted(map(tuple, prepare.of_task(table, task.name).collect())) == sorted(map(tuple, alone.select("doc_id", "text", "label", "label_id", "split").collect()))
        model, single = models[task.name], naive_bayes.fit(alone.filter("split = 'train'"), task)
        assert (model.class_rows, model.class_tokens, model.vocabulary_size, model.vocabulary_bytes) == (single.class_rows, single.class_tokens, single.vocabulary_size, single.vocabulary_bytes)
        assert sorted(map(tuple, model.counts.collect())) == sorted(map(tuple, single.counts.collect()))
