"""Multinomial naive Bayes trained by two aggregations.

Weights are logarithms held as whole numbers of 1e-9. Sums of whole numbers do
not depend on the order of addition, so a score is the same bit for bit under
any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions import tokens as tok
from civitext.operators.lookup import TokenTable
from civitext.operators.model_store import ModelNotFound, Version, latest, publish
from civitext.session import materialise
from civitext.tasks import Task, get_task

__all__ = ["ModelNotFound", "NaiveBayes", "fit", "load"]

SCALE = 1_000_000_000
_COUNTS_SCHEMA = "token string, n array<bigint>, total bigint"
_KIND = "naive_bayes"


@dataclass(frozen=True)
class NaiveBayes:
    """A fitted model: the table of counts per token and class, and k totals."""

    task: Task
    counts: DataFrame = field(repr=False)
    class_rows: tuple[int, ...]
    class_tokens: tuple[int, ...]
    vocabulary_size: int
    vocabulary_bytes: int
    alpha: float = 1.0

    @property
    def train_rows(self) -> int:
        return sum(self.class_rows)

    def priors(self) -> tuple[int, ...]:
        """Scaled log prior of each class; a class without rows can never win."""
        n = self.train_rows
        never = -(10**9) * SCALE
        return tuple(round((math.log(c) - math.log(n)) * SCALE) if c else never for c in self.class_rows)

    def log_weight(self, class_id: int) -> Column:
        """Log likelihood of a token in a class, unscaled."""
        denominator = math.log(self.class_tokens[class_id] + self.alpha * self.vocabulary_size)
        return F.ln(F.col("n")[class_id] + F.lit(float(self.alpha))) - F.lit(denominator)

    def token_table(self, columns: Sequence[Column]) -> TokenTable:
        """``token``, the given columns and ``total``, with the size of the table."""
        width = 48 + 8 * len(self.task.labels)
        return TokenTable(
            self.counts.select("token", *columns, "total"),
            self.vocabulary_size,
            self.vocabulary_bytes + width * self.vocabulary_size,
            sum(self.class_tokens),
        )

    def weights(self, name: str = "w") -> TokenTable:
        """The scaled weights as one array per token."""
        scaled = [F.round(self.log_weight(c) * SCALE).cast("long") for c in self.task.ids]
        return self.token_table([F.array(*scaled).alias(name)])

    def restricted(self, alpha: float, min_count: int = 1) -> NaiveBayes:
        """The same counts under another smoothing, without the tokens seen less
        than ``min_count`` times; nothing is trained again."""
        if min_count <= 1:
            return replace(self, alpha=alpha)
        kept = self.counts.filter(F.col("total") >= min_count)
        size, chars, tokens = _totals(kept, self.task)
        return replace(
            self, counts=kept, alpha=alpha, vocabulary_size=size, vocabulary_bytes=chars, class_tokens=tokens
        )

    def save(
        self,
        path: str,
        config: Mapping[str, Any] | None = None,
        metrics: Mapping[str, float] | None = None,
        mode: str = "append",
    ) -> Version:
        """Publish a version with its settings and metrics; see ``model_store.publish`` for the modes."""
        counts = {
            "class_rows": self.class_rows,
            "class_tokens": self.class_tokens,
            "vocabulary_size": self.vocabulary_size,
            "vocabulary_bytes": self.vocabulary_bytes,
        }
        return publish(
            self.counts.sparkSession,
            path,
            _KIND,
            self.task.name,
            lambda folder: self.counts.write.parquet(f"{folder}/counts"),
            {"alpha": self.alpha, **(config or {})},
            metrics,
            counts,
            mode,
        )


def load(spark: SparkSession, path: str) -> NaiveBayes:
    """Load the newest saved model; a missing one is an error with its path."""
    found = latest(spark, path, _KIND)
    counts = spark.read.schema(_COUNTS_SCHEMA).parquet(f"{found.folder}/counts")
    return NaiveBayes(
        get_task(found.task),
        counts,
        tuple(found.counts["class_rows"]),
        tuple(found.counts["class_tokens"]),
        found.counts["vocabulary_size"],
        found.counts["vocabulary_bytes"],
        found.config["alpha"],
    )


def _totals(counts: DataFrame, task: Task) -> tuple[int, int, tuple[int, ...]]:
    """Rows, bytes of token text, and occurrences per class of a table of counts."""
    row = counts.agg(
        F.count("*"),
        F.coalesce(F.sum(F.octet_length("token")), F.lit(0)),
        *(F.coalesce(F.sum(F.col("n")[c]), F.lit(0)) for c in task.ids),
    ).first()
    return row[0], row[1], tuple(row[2:])


def fit(train: DataFrame, task: str | Task, alpha: float = 1.0, text_col: str = "text") -> NaiveBayes:
    """Train on normalised ``text`` and ``label_id``.

    Tokens are counted with map-side partial sums, so a frequent word costs one
    row per task in the shuffle. The table is written once; only one row of
    totals and one row per class reach the driver.
    """
    task = get_task(task)
    rows = train.select("label_id", F.explode(tok.words(F.col(text_col))).alias("token"))
    per_class = [F.count_if(F.col("label_id") == c) for c in task.ids]
    counts = rows.groupBy("token").agg(F.array(*per_class).alias("n"), F.count("*").alias("total"))
    counts = materialise(counts, "token-counts")

    size, chars, tokens = _totals(counts, task)
    by_class = {r.label_id: r.n for r in train.groupBy("label_id").agg(F.count("*").alias("n")).collect()}
    return NaiveBayes(task, counts, tuple(by_class.get(c, 0) for c in task.ids), tokens, size, chars, alpha)


def fit_tasks(table: DataFrame, names: Sequence[str], alpha: float = 1.0, text_col: str = "text") -> dict[str, NaiveBayes]:
    """Train several tasks, given by name, on the result of ``prepare.preprocess_tasks``, with one count of the tokens.

    Each model is the one that ``fit`` gives on the training part of its task.
    """
    tasks = [get_task(name) for name in names]
    taught = [F.when(F.col(f"split_{t.name}") == "train", F.col(f"label_id_{t.name}")).alias(f"c{i}") for i, t in enumerate(tasks)]
    rows = table.select(*taught, text_col).filter(F.coalesce(*(f"c{i}" for i in range(len(tasks)))).isNotNull())
    tokens = rows.select(*(f"c{i}" for i in range(len(tasks))), F.explode(tok.words(F.col(text_col))).alias("token"))
    per_class = [F.array(*(F.count_if(F.col(f"c{i}") == c) for c in t.ids)).alias(f"n{i}") for i, t in enumerate(tasks)]
    counts = tokens.groupBy("token").agg(*per_class, *(F.count(f"c{i}").alias(f"total{i}") for i in range(len(tasks))))
    counts = materialise(counts, "token-counts")
    sizes = rows.agg(*(F.array(*(F.count_if(F.col(f"c{i}") == c) for c in t.ids)).alias(f"r{i}") for i, t in enumerate(tasks))).first()
    models = {}
    for i, task in enumerate(tasks):
        own = counts.filter(F.col(f"total{i}") > 0).select("token", F.col(f"n{i}").alias("n"), F.col(f"total{i}").alias("total"))
        size, chars, occurrences = _totals(own, task)
        models[task.name] = NaiveBayes(task, own, tuple(sizes[f"r{i}"]), occurrences, size, chars, alpha)
    return models
