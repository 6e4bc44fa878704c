import pytest

from civitext import HARM
from civitext.operators import linear, model_store, naive_bayes
from civitext.operators import predict as pr
from civitext.session import scratch_path
from tests.test_models import corpus, frame, new_texts


def publish(spark, path, mode="append", write=lambda folder: None, **more):
    return model_store.publish(spark, path, "k", "t", write, mode=mode, **more)


def test_versions_are_numbered_and_the_newest_is_read(spark):
    path = scratch_path(spark, "store")
    assert model_store.versions(spark, path) == []
    for i in range(3):
        publish(spark, path, config={"alpha": i}, metrics={"f1": i / 10, "accuracy": 0.5}, counts={"rows": [1, 2]})
    found = model_store.versions(spark, path)
    assert [v.number for v in found] == [1, 2, 3] and len({v.folder for v in found}) == 3
    last = model_store.latest(spark, path, "k")
    assert (last.config, last.metrics, last.counts, last.task) == ({"alpha": 2}, {"f1": 0.2, "accuracy": 0.5}, {"rows": [1, 2]}, "t")
    table = model_store.version_table(spark, path)
    assert [tuple(r) for r in table.collect()][:2] == [(1, "k", "t", "accuracy", 0.5), (1, "k", "t", "f1", 0.0)]
    with pytest.raises(model_store.ModelNotFound):
        model_store.latest(spark, path, "another kind")


def test_a_failed_save_leaves_the_old_version(spark):
    path = scratch_path(spark, "store")
    publish(spark, path, config={"n": 1})

    def broken(folder):
        spark.range(3).write.parquet(f"{folder}/counts")
        raise OSError("lost")

    for mode in ("append", "overwrite"):
        with pytest.raises(OSError):
            publish(spark, path, mode, broken)
        assert [v.config for v in model_store.versions(spark, path)] == [{"n": 1}]


def test_modes(spark):
    path = scratch_path(spark, "store")
    publish(spark, path, "error")
    with pytest.raises(FileExistsError):
        publish(spark, path, "error")
    with pytest.raises(ValueError):
        publish(spark, path, "replace")
    publish(spark, path)
    publish(spark, path, "overwrite")
    assert [v.number for v in model_store.versions(spark, path)] == [3]
    publish(spark, path)
    assert [v.number for v in model_store.versions(spark, path)] == [3, 4]


def test_naive_bayes_keeps_settings_and_metrics(spark):
    path, rows = scratch_path(spark, "nb"), corpus(3, 60)
    model = naive_bayes.fit(frame(spark, rows), HARM, alpha=0.5)
    model.save(path, {"seed": 7}, {"val_f1_macro": 0.75})
    later = naive_bayes.fit(frame(spark, rows[:30]), HARM)
    later.save(path)
    first, second = model_store.versions(spark, path)
    assert first.config == {"alpha": 0.5, "seed": 7} and first.metrics == {"val_f1_macro": 0.75} and first.counts["class_rows"] == list(model.class_rows)
    loaded = naive_bayes.load(spark, path)
    assert (loaded.alpha, loaded.class_rows, loaded.class_tokens) == (1.0, later.class_rows, later.class_tokens)
    df = new_texts(spark, rows)
    assert sorted(map(str, pr.predict(df, loaded).collect())) == sorted(map(str, pr.predict(df, later).collect()))
    assert second.counts["class_rows"] == list(later.class_rows)


def test_linear_model_with_pairs(spark):
    """Classes that differ by the order of two words alone: single words can't tell them."""
    rows = [(i, ("red blue green" if c == 0 else "blue red green" if c == 1 else "green red red blue") + f" w{i % 5}", c) for i in range(150) for c in [i % 3]]
    config = linear.LinearConfig(features=1 << 10, iterations=20, weight_decay=0.001)
    for pairs, wanted in ((True, 1.0), (False, 0.8)):
        own = linear.LinearConfig(config.features, config.iterations, config.weight_decay, pairs)
        model = linear.train(frame(spark, rows), HARM, own)
        assert set(model.metrics) == {f"{p}_{m}" for p in ("val", "test") for m in ("f1_macro", "accuracy")}
        assert (model.metrics["test_f1_macro"] == wanted) if pairs else (model.metrics["test_f1_macro"] < wanted)
    assert model.train_rows == 104 and model.config.seed == 42


def test_linear_model_is_stored_whole(spark):
    path, rows = scratch_path(spark, "linear"), corpus(3, 90)
    config = linear.LinearConfig(features=1 << 10, iterations=5, seed=3)
    with pytest.raises(model_store.ModelNotFound):
        linear.load(spark, path)
    model = linear.train(frame(spark, rows), HARM, config)
    model.save(path)
    loaded = linear.load(spark, path)
    assert (loaded.config, loaded.metrics, loaded.task, loaded.train_rows) == (config, model.metrics, HARM, model.train_rows)
    df = frame(spark, rows)
    assert sorted(map(str, linear.predict(df, loaded).collect())) == sorted(map(str, linear.predict(df, model).collect()))
    again = linear.train(frame(spark, rows), HARM, config)
    assert sorted(map(str, linear.predict(df, again).collect())) == sorted(map(str, linear.predict(df, model).collect()))
    other = linear.train(frame(spark, rows), HARM, linear.LinearConfig(features=1 << 10, iterations=5, seed=4))
    assert other.train_rows == model.train_rows and sorted(map(str, linear.predict(df, other).collect())) != sorted(map(str, linear.predict(df, model).collect()))
