"""Choosing a model by its validation metric."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civitext.functions import scores as sc
from civitext.functions import tokens as tok
from civitext.operators.lookup import sum_by_key
from civitext.operators.naive_bayes import SCALE, NaiveBayes


@dataclass(frozen=True)
class Candidate:
    """Smoothing, and the fewest training occurrences a token needs to count."""

    alpha: float
    min_count: int = 1


def _candidate_weights(model: NaiveBayes, candidates: Sequence[Candidate]) -> str:
    """Scaled weights of all candidates as one flat SQL array, class by class.

    A token below the candidate's limit is unknown to it and weighs 0.
    """
    ids = model.task.ids
    sums = []
    for m in sorted({c.min_count for c in candidates}):
        sums.append(f"count_if(total >= {m}) AS size_{m}")
        sums += [f"coalesce(sum(n[{c}]) FILTER (WHERE total >= {m}), 0L) AS tokens_{m}_{c}" for c in ids]
    totals = model.counts.agg(*map(F.expr, sums)).first()

    weights = []
    for cand in candidates:
        m, alpha = cand.min_count, float(cand.alpha)
        size = totals[f"size_{m}"]
        for c in ids:
            denominator = math.log(totals[f"tokens_{m}_{c}"] + alpha * size) if size else 0.0
            log = f"ln(n[{c}] + {alpha!r}D) - {denominator!r}D"
            weights.append(f"if(total >= {m}, cast(round(({log}) * {float(SCALE)!r}D) AS bigint), 0L)")
    return f"array({', '.join(weights)})"


def evaluate_candidates(
    validation: DataFrame,
    model: NaiveBayes,
    candidates: Sequence[Candidate],
    key: str = "doc_id",
    text_col: str = "text",
    pos_label: int = 1,
    **limits: int,
) -> DataFrame:
    """Validation metric of every candidate from one pass over the text.

    All candidates share the counts of ``model``, so none is trained again.
    Columns: ``candidate`` (1-based place in the list), ``alpha``,
    ``min_count``, ``f1``: macro F1, or the F1 of ``pos_label`` for a task that
    selects by binary F1. ``validation`` holds normalised text and ``label_id``.
    """
    ids, k = model.task.ids, len(model.task.ids)
    flat = F.expr(_candidate_weights(model, candidates)).alias("w")
    rows = validation.select(key, "label_id", F.explode_outer(tok.words(F.col(text_col))).alias("token"))
    sums = {f"t{i}": f"coalesce(w[{i}], 0L)" for i in range(k * len(candidates))}
    summed = sum_by_key(rows, model.token_table([flat]), sums, key, ["label_id"], **limits)
    priors = model.priors()
    scored = summed.selectExpr("label_id", *(f"t{i} + {priors[i % k]}L AS s{i}" for i in range(len(sums))))

    predicted = [sc.argmax_sql([f"s{j * k + c}" for c in ids]) for j in range(len(candidates))]
    decisions = scored.select(
        F.col("label_id").alias("y_true"), F.expr(f"posexplode(array({', '.join(predicted)}))").alias("place", "y_pred")
    )

    def f1(c: int) -> str:
        hits = f"2 * count_if(y_true = {c} AND y_pred = {c})"
        return f"coalesce({hits} / nullif(count_if(y_true = {c}) + count_if(y_pred = {c}), 0), 0D)"

    if model.task.selection_metric == "f1_binary":
        metric = f1(pos_label)
    else:
        metric = f"({' + '.join(f1(c) for c in ids)}) / {k}"
    judged = decisions.groupBy("place").agg(F.expr(metric).alias("f1"))
    alphas = ", ".join(f"{float(c.alpha)!r}D" for c in candidates)
    min_counts = ", ".join(str(c.min_count) for c in candidates)
    return judged.selectExpr(
        "place + 1 AS candidate",
        f"array({alphas})[place] AS alpha",
        f"array({min_counts})[place] AS min_count",
        "f1",
    )


def mark_best(scored: DataFrame) -> DataFrame:
    """Flag the candidate with the highest metric, unrounded; the first one wins a tie."""
    # One row per candidate enters the window.
    place = F.row_number().over(Window.orderBy(F.desc("f1"), "candidate"))
    return scored.withColumn("is_best", place == 1)


def best_model(scored: DataFrame, model: NaiveBayes) -> NaiveBayes:
    """The model of the winning candidate; one row reaches the driver."""
    winner = mark_best(scored).filter("is_best").first()
    return model.restricted(winner.alpha, winner.min_count)


def early_stopping(history: DataFrame, patience: int = 2) -> DataFrame:
    """Apply early stopping to a history ``task, step, f1``.

    Training stops at the first step that is the ``patience``-th in a row
    without a new maximum; the model kept is the best up to there. Adds
    ``best_so_far``, ``stop_step`` (NULL if training ran through) and ``kept``.
    A history has one row per evaluation of a task.
    """
    ordered = Window.partitionBy("task").orderBy("step")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    improved = F.coalesce(F.col("f1") > F.max("f1").over(before), F.lit(True))
    place = F.row_number().over(ordered)
    marked = history.withColumn("place", place).withColumn("improved", improved)
    last = F.max(F.when(F.col("improved"), F.col("place"))).over(ordered)
    marked = marked.withColumn("waited", F.col("place") - last)
    whole = Window.partitionBy("task")
    stop = F.min(F.when(F.col("waited") >= patience, F.col("step"))).over(whole)
    marked = marked.withColumn("stop_step", stop)
    ran = F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step"))
    kept = F.max(F.when(F.col("improved") & ran, F.col("step"))).over(whole)
    return marked.select(
        "task",
        "step",
        "f1",
        F.max("f1").over(ordered).alias("best_so_far"),
        "stop_step",
        (F.col("step") == kept).alias("kept"),
    )
