"""Evaluation of predictions against true labels.

Everything derives from counts, taken in one pass with map-side partial sums;
the number of classes bounds all later steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0/0 counts as 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def class_statistics(
    df: DataFrame, id2label: Mapping[int, str], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """One row: ``n``, ``correct`` and an array ``classes`` of per-class figures.

    Accuracy covers all rows; classes without rows stay in with zeros.
    """
    true, pred = F.col(y_true), F.col(y_pred)
    counts = [F.count("*").alias("n"), F.count_if(true == pred).alias("correct")]
    for c in sorted(id2label):
        counts += [
            F.count_if((true == c) & (pred == c)).alias(f"tp{c}"),
            F.count_if(true == c).alias(f"true{c}"),
            F.count_if(pred == c).alias(f"pred{c}"),
        ]

    return df.agg(*counts).select("n", "correct", _figures(id2label).alias("classes"))


def _figures(id2label: Mapping[int, str]) -> Column:
    """Per-class figures from the sums ``tp<c>``, ``true<c>`` and ``pred<c>``."""

    def figures(c: int) -> Column:
        tp, support, predicted = F.col(f"tp{c}"), F.col(f"true{c}"), F.col(f"pred{c}")
        return F.struct(
            F.lit(c).alias("label_id"),
            F.lit(id2label[c]).alias("label"),
            _ratio(tp, predicted).alias("precision"),
            _ratio(tp, support).alias("recall"),
            _ratio(2 * tp, support + predicted).alias("f1"),
            support.alias("support"),
        )

    return F.array(*(figures(c) for c in sorted(id2label)))


def _macro(name: str, k: int) -> Column:
    return _add([F.col("classes")[i][name] for i in range(k)]) / F.lit(float(k))


def _weighted(name: str, k: int) -> Column:
    rows = [F.col("classes")[i] for i in range(k)]
    return _ratio(_add([r[name] * r["support"] for r in rows]), _add([r["support"] for r in rows]))


def full_report(
    df: DataFrame,
    id2label: Mapping[int, str],
    task_name: str = "classifier",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """The metric record of one model, rounded to four places."""
    stats = class_statistics(df, id2label, y_true, y_pred)
    return stats.select(F.lit(task_name).alias("task"), *_record(len(id2label)))


def _record(k: int) -> list[Column]:
    return [
        F.round(_ratio(F.col("correct"), F.col("n")), 4).alias("accuracy"),
        F.round(_macro("f1", k), 4).alias("f1_macro"),
        F.round(_weighted("f1", k), 4).alias("f1_weighted"),
        F.round(_macro("precision", k), 4).alias("precision"),
        F.round(_macro("recall", k), 4).alias("recall"),
    ]


def accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    correct = F.count_if(F.col(y_true) == F.col(y_pred))
    return df.agg(F.count("*").alias("n"), F.round(_ratio(correct, F.count("*")), 4).alias("accuracy"))


def class_report(
    df: DataFrame, id2label: Mapping[int, str], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Rows per class, then accuracy, macro average and weighted average."""
    k = len(id2label)

    def row(label: Column, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            label.alias("label"),
            F.round(precision, 4).alias("precision"),
            F.round(recall, 4).alias("recall"),
            F.round(f1, 4).alias("f1"),
            support.cast("long").alias("support"),
        )

    none = F.lit(None).cast("double")
    classes = [F.col("classes")[i] for i in range(k)]
    support = _add([c["support"] for c in classes])
    lines = [row(c["label"], c["precision"], c["recall"], c["f1"], c["support"]) for c in classes]
    lines += [
        row(F.lit("accuracy"), none, none, _ratio(F.col("correct"), F.col("n")), F.col("n")),
        row(F.lit("macro avg"), _macro("precision", k), _macro("recall", k), _macro("f1", k), support),
        row(F.lit("weighted avg"), _weighted("precision", k), _weighted("recall", k), _weighted("f1", k), support),
    ]
    stats = class_statistics(df, id2label, y_true, y_pred)
    return stats.select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def f1_binary(
    df: DataFrame, pos_label: int | Sequence[int] = 1, y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """F1 of one class, or a row for each of several, from one aggregation.

    The default, class 1, is ``real`` in the veracity task.
    """

    def row(label: int) -> Column:
        true, pred = F.col(y_true) == label, F.col(y_pred) == label
        f1 = _ratio(2 * F.count_if(true & pred), F.count_if(true) + F.count_if(pred))
        return F.struct(F.lit(label).alias("pos_label"), F.round(f1, 4).alias("f1_binary"))

    wanted = [pos_label] if isinstance(pos_label, int) else list(pos_label)
    return df.agg(F.array(*map(row, wanted)).alias("rows")).select(F.explode("rows").alias("row")).select("row.*")


def confusion_matrix(
    df: DataFrame, id2label: Mapping[int, str], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Counts for every pair of true and predicted class, zeros included."""
    pairs = [(t, p) for t in sorted(id2label) for p in sorted(id2label)]
    counts = [F.count_if((F.col(y_true) == t) & (F.col(y_pred) == p)) for t, p in pairs]
    cells = [
        F.struct(F.lit(id2label[t]).alias("true_label"), F.lit(id2label[p]).alias("pred_label"), n.alias("n"))
        for (t, p), n in zip(pairs, counts)
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def confusion_matrix_normalised(
    df: DataFrame, id2label: Mapping[int, str], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Each row of the matrix divided by its sum; NULL where a true class has no rows."""
    cells = confusion_matrix(df, id2label, y_true, y_pred)
    row_sum = F.sum("n").over(Window.partitionBy("true_label"))
    return cells.select(
        "true_label", "pred_label", F.round(F.col("n") / F.nullif(row_sum, F.lit(0)), 4).alias("share")
    )


def model_reports(
    df: DataFrame, id2label: Mapping[int, str], predictions: Mapping[str, str], y_true: str = "y_true"
) -> DataFrame:
    """The metric record of several models from one pass over their predictions.

    ``predictions`` names a model's column of predicted ids. Each row gives one
    cell of the confusion counts of every model, so the aggregation holds one row
    for each model and pair of classes, and the rest works on those.
    """
    cells = [F.struct(F.lit(model).alias("task"), F.col(column).alias("y_pred")) for model, column in predictions.items()]
    judged = df.select(F.col(y_true).alias("y_true"), F.explode(F.array(*cells)).alias("cell"))
    counts = judged.groupBy("cell.task", "y_true", "cell.y_pred").agg(F.count("*").alias("n"))
    return _reports(counts, id2label)


def _reports(counts: DataFrame, id2label: Mapping[int, str]) -> DataFrame:
    """Metric records from ``task, y_true, y_pred, n``."""
    k = len(id2label)
    some = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    true, pred = F.col("y_true"), F.col("y_pred")
    sums = [F.sum("n").alias("n"), some(true == pred).alias("correct")]
    for c in sorted(id2label):
        sums += [some((true == c) & (pred == c)).alias(f"tp{c}"), some(true == c).alias(f"true{c}"), some(pred == c).alias(f"pred{c}")]
    stats = counts.groupBy("task").agg(*sums).select("task", "n", "correct", _figures(id2label).alias("classes"))
    return stats.select("task", *_record(k))


def compare_models(reports: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """Metric records of several models, best macro F1 first, with their rank."""
    stacked = reports if isinstance(reports, DataFrame) else reduce(lambda a, b: a.unionByName(b), reports)
    # One row per model enters the window.
    place = F.row_number().over(Window.orderBy(F.desc("f1_macro"), "task"))
    return stacked.withColumn("rank", place).orderBy("rank")
