import random

import pytest

from civitext.operators import evaluate as ev

NAMES = {0: "hate", 1: "abusive", 2: "normal"}


def judged(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_pred int")


def brute(pairs):
    out = {}
    for c in NAMES:
        tp = sum(t == p == c for t, p in pairs)
        support, predicted = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
        out[c] = (
            tp / predicted if predicted else 0.0,
            tp / support if support else 0.0,
            2 * tp / (support + predicted) if support + predicted else 0.0,
            support,
        )
    return out


@pytest.mark.parametrize("classes", [(0, 1, 2), (0, 2), (2,), (0, 1, 2, 7)])
def test_report_equals_brute_force(spark, classes):
    rng = random.Random(9)
    pairs = [(rng.choice(classes), rng.choice(classes)) for _ in range(200)]
    df, wanted = judged(spark, pairs), brute(pairs)
    support = sum(w[3] for w in wanted.values())
    accuracy = sum(t == p for t, p in pairs) / len(pairs)
    r = ev.full_report(df, NAMES, "t").first()
    macro = [sum(w[i] for w in wanted.values()) / 3 for i in range(3)]
    weighted = [sum(w[i] * w[3] for w in wanted.values()) / support for i in range(3)]
    assert (r.accuracy, r.f1_macro, r.f1_weighted, r.precision, r.recall) == pytest.approx(
        (accuracy, macro[2], weighted[2], macro[0], macro[1]), abs=6e-5
    )
    lines = {x.label: x for x in ev.class_report(df, NAMES).collect()}
    for c, name in NAMES.items():
        x = lines[name]
        assert (x.precision, x.recall, x.f1, x.support) == pytest.approx(wanted[c], abs=6e-5)
    assert lines["weighted avg"].f1 == pytest.approx(weighted[2], abs=6e-5)
    assert lines["macro avg"].support == support and lines["accuracy"].support == len(pairs)


def test_confusion_matrix_is_dense(spark):
    pairs = [(0, 0), (0, 1), (2, 1), (2, 2), (2, 2)]
    cells = {(r.true_label, r.pred_label): r.n for r in ev.confusion_matrix(judged(spark, pairs), NAMES).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 5 and cells["normal", "normal"] == 2
    shares = {
        (r.true_label, r.pred_label): r.share
        for r in ev.confusion_matrix_normalised(judged(spark, pairs), NAMES).collect()
    }
    assert shares["normal", "abusive"] == 0.3333 and shares["hate", "hate"] == 0.5
    assert shares["abusive", "hate"] is None


def test_binary_f1_and_accuracy(spark):
    df = judged(spark, [(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)])
    assert ev.f1_binary(df).first().f1_binary == pytest.approx(0.6667)
    assert ev.f1_binary(df, 0).first().f1_binary == 0.5
    assert tuple(ev.accuracy(df).first()) == (5, 0.6)
    assert ev.accuracy(df.filter("y_true > 9")).first().accuracy == 0.0


def test_models_are_ranked(spark):
    good, bad = judged(spark, [(0, 0), (1, 1), (2, 2)]), judged(spark, [(0, 1), (1, 1), (2, 2)])
    out = ev.compare_models([ev.full_report(bad, NAMES, "bad"), ev.full_report(good, NAMES, "good")]).collect()
    assert [(r.task, r.rank) for r in out] == [("good", 1), ("bad", 2)]


def test_models_in_one_pass_equal_single_reports(spark):
    rng = random.Random(12)
    rows = [(rng.choice([0, 1, 2, 7, None]), rng.choice([0, 1, 2]), rng.choice([0, 2, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "y_true int, a int, b int")
    together = ev.model_reports(df, NAMES, {"first": "a", "second": "b"})
    single = [ev.full_report(df, NAMES, name, y_pred=column) for name, column in (("first", "a"), ("second", "b"))]
    assert sorted(map(tuple, together.collect())) == sorted(tuple(r.first()) for r in single)
    assert [r.rank for r in ev.compare_models(together).collect()] == [1, 2]
    plan = ev.compare_models(ev.model_reports(df, NAMES, {"first": "a", "second": "b"}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_binary_f1_of_several_classes_in_one_pass(spark):
    df = judged(spark, [(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)])
    both = ev.f1_binary(df, (1, 0))
    assert [tuple(r) for r in both.collect()] == [tuple(ev.f1_binary(df, c).first()) for c in (1, 0)]
    plan = ev.f1_binary(df, (1, 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
