"""Token attributions of a linear text model.

For an additive score the exact Shapley value of a feature has a closed form:
weight times distance of the feature from its mean. Weights are centred over
the classes. The values explain the log score of the predicted class, not a
probability.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitext.functions import scores as sc
from civitext.functions import tokens as tok
from civitext.operators.lookup import join_tokens
from civitext.operators.naive_bayes import SCALE, NaiveBayes
from civitext.operators.predict import class_scores, decide
from civitext.operators.prepare import normalise_texts

# Bytes of text in a part. Its token rows, some tens of times as many bytes, are counted
# and sorted in the memory of one task.
PART_BYTES = 8 * 1024 * 1024


def _text_parts(df: DataFrame, text_col: str) -> int:
    """Parts of at most about ``PART_BYTES`` of text, one for each core at least."""
    size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES))


def _centred(model: NaiveBayes) -> list[Column]:
    logs = [model.log_weight(c) for c in model.task.ids]
    mean = sum(logs[1:], logs[0]) / F.lit(float(len(logs)))
    return [w - mean for w in logs]


def attributions(
    df: DataFrame,
    model: NaiveBayes,
    key: str = "doc_id",
    text_col: str = "text",
    **limits: int,
) -> DataFrame:
    """One row per known token of a text, for the class the model predicts.

    Columns: key, ``token``, ``n``, ``label`` and ``confidence`` of the model,
    ``weight`` (centred weight of the token) and ``phi`` (its contribution).
    Normalised texts are placed by key before they are taken apart, so counting,
    scoring and ranking per text share that one shuffle. Their bytes are counted first:
    parts are as many as keep the token rows of each in memory.
    """
    ids = model.task.ids
    parts = _text_parts(df, text_col)
    placed = normalise_texts(df.select(key, text_col), text_col, drop_near_empty=False).repartition(parts, key)
    rows = placed.select(key, F.explode(tok.words(F.col(text_col))).alias("token"))
    terms = rows.groupBy(key, "token").agg(F.count("*").alias("n"))

    scaled = [F.round(model.log_weight(c) * SCALE).cast("long") for c in ids]
    table = model.token_table(
        [
            F.array(*scaled).alias("w"),
            F.array(*_centred(model)).alias("centred"),
            (F.col("total") / F.lit(float(model.train_rows))).alias("mean_n"),
        ]
    )
    known = join_tokens(terms, table, key, parts=parts, **limits).filter(F.col("total").isNotNull())

    # One column per class: this runs once per token row.
    priors = model.priors()
    sums = [f"(sum(w[{c}] * n) OVER (PARTITION BY `{key}`) + {priors[c]}L) / {float(SCALE)!r}D AS s{c}" for c in ids]
    scores = [f"s{c}" for c in ids]
    scored = known.selectExpr(f"`{key}`", "token", "n", "centred", "mean_n", *sums)
    decided = scored.selectExpr(
        f"`{key}`",
        "token",
        "n",
        "centred",
        "mean_n",
        f"{sc.argmax_sql(scores)} AS label_id",
        f"round({sc.confidence_sql(scores)}, 4) AS confidence",
    )
    names = ", ".join(f"'{label}'" for label in model.task.labels)
    return decided.selectExpr(
        f"`{key}`",
        "token",
        "n",
        f"array({names})[label_id] AS label",
        "confidence",
        "centred[label_id] AS weight",
        "centred[label_id] * (n - mean_n) AS phi",
    )


def with_margin(attributed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add the sum of a text's contributions."""
    return attributed.withColumn("margin", F.sum("phi").over(Window.partitionBy(key)))


def _strength() -> Column:
    # Rounded, so that equal contributions tie and the token decides.
    return F.round(F.abs("phi"), 8)


def top_tokens(attributed: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The ``k`` strongest tokens for and against the prediction of each text."""
    signed = attributed.filter(F.round("phi", 8) != 0).withColumn(
        "side", F.when(F.col("phi") > 0, "top").otherwise("bottom")
    )
    order = Window.partitionBy(key, "side").orderBy(_strength().desc(), "token")
    ranked = signed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(key, "label", "confidence", "side", "rank", "token", "phi")


def explanation_records(
    df: DataFrame,
    model: NaiveBayes,
    k: int = 10,
    key: str = "doc_id",
    text_col: str = "text",
    **limits: int,
) -> DataFrame:
    """One record per text: prediction, ``top_tokens`` and ``bottom_tokens`` arrays.

    A text without a known token, also a blank one, has the prediction of the
    prior and empty arrays. A text has at most ``2k`` rows left when the arrays
    are built.
    """

    def tokens(side: str) -> Column:
        entry = F.struct("rank", "token", F.round("phi", 4).alias("score"))
        listed = F.array_sort(F.collect_list(F.when(F.col("side") == side, entry)))
        return F.transform(listed, lambda e: F.struct(e["token"].alias("token"), e["score"].alias("score")))

    chosen = top_tokens(attributions(df, model, key, text_col, **limits), k, key)
    listed = chosen.groupBy(key).agg(tokens("top").alias("top_tokens"), tokens("bottom").alias("bottom_tokens"))
    scored = class_scores(df, [model], key, text_col, **limits).withColumnRenamed("scores0", "scores")
    predicted = decide(scored, model.task.labels).select(key, "label", "confidence")
    sides = {side: F.coalesce(side, F.array().cast(listed.schema[side].dataType)) for side in ("top_tokens", "bottom_tokens")}
    return predicted.join(listed, key, "left").withColumns(sides)


def token_importance(attributed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Absolute weight of each token, scaled so that a text's largest is 1.

    Special tokens count for the scale and are dropped afterwards; if all
    weights are 0 they stay 0.
    """
    size = F.abs("weight")
    largest = F.max(size).over(Window.partitionBy(key))
    scaled = attributed.select(
        key, "label", "token", F.when(largest > 0, size / largest).otherwise(size).alias("score")
    )
    return scaled.filter(~F.col("token").isin(*tok.SPECIAL_TOKENS))


def plot_data(attributed: DataFrame, k: int = 15, key: str = "doc_id") -> DataFrame:
    """The ``k`` strongest tokens of each text with the sign of their effect."""
    order = Window.partitionBy(key).orderBy(_strength().desc(), "token")
    ranked = attributed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    direction = F.when(F.col("phi") > 0, "increases").otherwise("decreases")
    return ranked.select(key, "rank", "token", "phi", direction.alias("direction"))
