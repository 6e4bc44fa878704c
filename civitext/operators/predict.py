"""Scoring of text tables: label, confidence and score of every class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.functions import scores as sc
from civitext.functions import text as tx
from civitext.functions import tokens as tok
from civitext.operators.lookup import TokenTable, sum_by_key
from civitext.operators.naive_bayes import SCALE, NaiveBayes


def _joint_weights(models: Sequence[NaiveBayes]) -> TokenTable:
    """One table with the weight arrays ``w0``, ``w1``, … of all models."""
    parts = [m.weights(f"w{i}") for i, m in enumerate(models)]
    table = parts[0].table
    for part in parts[1:]:
        # Both sides are per-token tables, so this join meets each token once.
        left, right = table.withColumnRenamed("total", "t0"), part.table.withColumnRenamed("total", "t1")
        total = F.coalesce("t0", F.lit(0)) + F.coalesce("t1", F.lit(0))
        table = left.join(right, "token", "full_outer").withColumn("total", total).drop("t0", "t1")
    return TokenTable(
        table, sum(p.rows for p in parts), sum(p.bytes for p in parts), sum(p.occurrences for p in parts)
    )


def class_scores(
    df: DataFrame,
    models: Sequence[NaiveBayes],
    key: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    normalise: bool = True,
    **limits: int,
) -> DataFrame:
    """Log scores of every row: one ``scores<i>`` array per model.

    The text is tokenised once for all models. All tokens of a row come out of
    one task, so the sums are nearly complete before the only shuffle, by key.
    Unknown tokens add nothing; a row without tokens keeps the prior. ``carry``
    names small columns to keep. A row is known by a hash of its key and text, so
    keys may repeat or be NULL: as many rows come out as went in.
    """
    text = tx.normalise(F.col(text_col)) if normalise else F.col(text_col)
    row = F.xxhash64(key, F.coalesce(F.col(text_col), F.lit(""))).alias("_row")
    # beside the generator the hash of a text would be taken again for each of its tokens
    texts = df.select(row, key, *carry, tok.words(text).alias("_words"))
    rows = texts.select("_row", key, *carry, F.posexplode_outer("_words").alias("_place", "token"))
    sums = {f"s{i}_{c}": f"coalesce(w{i}[{c}], 0L)" for i, m in enumerate(models) for c in m.task.ids}
    # equal rows add up to one; their first tokens, or their having none, count them
    copies = {"_copies": "CAST(coalesce(_place, 0) = 0 AS BIGINT)"}
    summed = sum_by_key(rows, _joint_weights(models), sums, "_row", [key, *carry], copies, **limits)
    single = summed.withColumns({name: F.expr(f"{name} div _copies") for name in sums})
    summed = single.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))

    def array(i: int, m: NaiveBayes) -> Column:
        priors = m.priors()
        return F.array(*((F.col(f"s{i}_{c}") + F.lit(priors[c])) / F.lit(float(SCALE)) for c in m.task.ids))

    return summed.select(key, *carry, *(array(i, m).alias(f"scores{i}") for i, m in enumerate(models)))


def decide(df: DataFrame, labels: Sequence[str], scores: str = "scores", suffix: str = "") -> DataFrame:
    """Turn a column of class scores into the prediction record.

    Adds ``label``, ``label_id``, ``confidence`` and ``scores`` (label -> share),
    each with ``suffix``. Confidence and scores are rounded to four places after
    the label is chosen.
    """
    names = F.array(*(F.lit(label) for label in labels))
    kept = [c for c in df.columns if c != scores]
    chosen = df.withColumn("_p", sc.softmax(F.col(scores))).withColumn("_id", sc.argmax(F.col(scores)))
    return chosen.select(
        *kept,
        F.col("_id").alias(f"label_id{suffix}"),
        F.get(names, F.col("_id")).alias(f"label{suffix}"),
        F.round(F.get(F.col("_p"), F.col("_id")), 4).alias(f"confidence{suffix}"),
        sc.score_map(F.col("_p"), labels).alias(f"scores{suffix}"),
    )


def _with_status(df: DataFrame, text_col: str) -> DataFrame:
    status = F.when(tx.is_blank(F.col(text_col)), "empty_input").otherwise("ok")
    return df.withColumn("status", status)


def _only_if_ok(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = F.col("status") == "ok"
    return df.withColumns({c: F.when(ok, F.col(c)) for c in columns})


def predict(
    df: DataFrame,
    model: NaiveBayes,
    key: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    normalise: bool = True,
    **limits: int,
) -> DataFrame:
    """Label, confidence and scores of every row.

    Text is normalised first, as it was for training. A blank text gets the
    status ``empty_input`` and no prediction.
    """
    rows = _with_status(df, text_col)
    scored = class_scores(rows, [model], key, text_col, [*carry, "status"], normalise, **limits)
    record = decide(scored.withColumnRenamed("scores0", "scores"), model.task.labels)
    return _only_if_ok(record, ["label_id", "label", "confidence", "scores"])


def predict_combined(
    df: DataFrame,
    models: Sequence[NaiveBayes],
    key: str = "doc_id",
    text_col: str = "text",
    **limits: int,
) -> DataFrame:
    """Predictions of several tasks from one pass over the text.

    The columns of each task end in ``_<task name>``.
    """
    scored = class_scores(_with_status(df, text_col), models, key, text_col, ["status"], **limits)
    added = []
    for i, m in enumerate(models):
        suffix = f"_{m.task.name}"
        scored = decide(scored, m.task.labels, f"scores{i}", suffix)
        added += [f"{c}{suffix}" for c in ("label_id", "label", "confidence", "scores")]
    return _only_if_ok(scored, added)


def score_breakdown(predictions: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per class in falling score order; ties by label."""
    pairs = F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("label")))
    ordered = predictions.select(key, F.posexplode(F.array_sort(pairs)).alias("place", "entry"))
    return ordered.select(
        key,
        (F.col("place") + 1).alias("rank"),
        F.col("entry.label").alias("label"),
        (-F.col("entry.neg")).alias("score"),
    )
