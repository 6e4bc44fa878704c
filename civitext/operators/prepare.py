"""Cleaning and label encoding of a labelled corpus."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from civitext.functions import labels, text
from civitext.operators import split as splitting
from civitext.session import materialise
from civitext.tasks import Task


def project(
    df: DataFrame, text_col: str = "text", label_col: str = "label", key: str = "doc_id"
) -> DataFrame:
    """Standard column names, only the needed columns, no NULL text or label.

    The key stays, because rows need an identity, and so does a split column.
    """
    columns = [F.col(key), F.col(text_col).alias("text"), F.col(label_col).alias("label")]
    if "split" in df.columns:
        columns.append(F.col("split"))
    return df.select(*columns).dropna(subset=["text", "label"])


def encode_labels(df: DataFrame, task: str | Task) -> DataFrame:
    """Add ``label_id`` and drop rows whose label is unknown."""
    return df.withColumn("label_id", labels.encode(F.col("label"), task)).filter(F.col("label_id").isNotNull())


def unknown_labels(df: DataFrame, task: str | Task) -> DataFrame:
    """How many rows ``encode_labels`` keeps and drops, in one pass over the labels."""
    known = labels.encode(F.col("label"), task).isNotNull()
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(known).alias("n_known"),
        F.count_if(~known).alias("n_unknown"),
    )


def normalise_texts(df: DataFrame, text_col: str = "text", drop_near_empty: bool = True) -> DataFrame:
    """Normalise a text column and drop what is left of near-empty texts.

    The optimizer copies a projected expression into any filter on it, and may
    push that filter below joins: the chain would run twice, and over rows that
    are dropped anyway. It does not look through a generator, so a one-element
    ``explode`` computes the chain once, where it is written.
    """
    others = [c for c in df.columns if c != text_col]
    once = df.select(*others, F.explode(F.array(text.normalise(F.col(text_col)))).alias(text_col))
    normalised = once.select(*df.columns)
    return normalised.filter(~text.is_near_empty(F.col(text_col))) if drop_near_empty else normalised


@dataclass
class DropCounts:
    """Rows before and after each step that drops some, counted while the rows pass.

    Every step is observed where it stands, in the job that writes the cleaned
    table; no row is read a second time. Read it after that job.
    """

    steps: dict[str, Observation] = field(default_factory=dict)

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        self.steps[step] = Observation(step)
        return df.observe(self.steps[step], F.count(F.lit(1)).alias("n"))

    def rows(self) -> dict[str, int]:
        """Rows that left each step, in order."""
        return {step: seen.get["n"] for step, seen in self.steps.items()}

    def dropped(self) -> dict[str, int]:
        """Rows read and kept, and the rows that each step dropped."""
        rows = list(self.rows().items())
        lost = {step: before - n for (_, before), (step, n) in zip(rows, rows[1:])}
        return {"n_rows": rows[0][1], **{f"n_{step}": n for step, n in lost.items()}, "n_kept": rows[-1][1]}


def clean(
    df: DataFrame,
    task: str | Task,
    text_col: str = "text",
    label_col: str = "label",
    key: str = "doc_id",
    counts: DropCounts | None = None,
) -> DataFrame:
    """Project, normalise, drop near-empty texts and encode: one narrow pass.

    ``counts`` takes the rows that each step drops; without it filters may move
    into the scan.
    """
    watch = counts.watch if counts else lambda rows, step: rows
    complete = watch(project(watch(df, "read"), text_col, label_col, key), "missing")
    return watch(normalise_texts(watch(encode_labels(complete, task), "unknown")), "near_empty")


def preprocess(
    df: DataFrame,
    task: str | Task,
    mode: str = "stratified",
    text_col: str = "text",
    label_col: str = "label",
    key: str = "doc_id",
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
    counts: DropCounts | None = None,
) -> DataFrame:
    """Clean a corpus and give every row a split: ``train``, ``val`` or ``test``.

    The cleaned rows are written once; the passes that fix the split then read
    only the key and the label from that table. ``mode="predefined"`` keeps the
    split column of the input and carves a validation part out of the training
    rows if there is none.
    """
    cleaned = clean(df, task, text_col, label_col, key, counts)
    if mode == "stratified":
        table = materialise(cleaned.drop("split"), "cleaned")
        return splitting.stratified_split(table, test_size, val_size, seed, key=key)
    if mode == "predefined":
        table = materialise(cleaned, "cleaned")
        return splitting.carve_validation(splitting.predefined_split(table), val_size, seed, key=key)
    raise ValueError(f"unknown split mode {mode!r}; expected 'stratified' or 'predefined'")


def preprocess_tasks(
    df: DataFrame,
    label_cols: Mapping[str, str],
    text_col: str = "text",
    key: str = "doc_id",
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Like ``preprocess``, for several tasks over the same texts, each named with its label column.

    The texts are normalised and written once. The table has ``label_<task>``,
    ``label_id_<task>`` and ``split_<task>`` for each task; where a label is missing
    or unknown its id and split are NULL. A task's split is the one that it would
    get alone.
    """
    columns = [F.col(key), F.col(text_col).alias("text")]
    for task, column in label_cols.items():
        columns += [F.col(column).alias(f"label_{task}"), labels.encode(F.col(column), task).alias(f"label_id_{task}")]
    some: Column = F.coalesce(*(F.col(f"label_id_{task}") for task in label_cols)).isNotNull()
    table = materialise(normalise_texts(df.select(*columns).filter(F.col("text").isNotNull() & some)), "cleaned")
    splits = {}
    for task in label_cols:
        label_id = F.col(f"label_id_{task}")
        own = table.select(key, label_id.alias("label_id")).filter(F.col("label_id").isNotNull())
        cuts = splitting.stratified_cuts(own, test_size, val_size, seed, key)
        part = cuts.column(label_id, F.col(key)) if cuts.bounds else F.lit(cuts.rest)
        splits[f"split_{task}"] = F.when(label_id.isNotNull(), part)
    return table.withColumns(splits)


def of_task(table: DataFrame, task: str, key: str = "doc_id") -> DataFrame:
    """One task's rows of ``preprocess_tasks``, as ``preprocess`` gives them."""
    own = [F.col(f"{c}_{task}").alias(c) for c in ("label", "label_id", "split")]
    return table.select(key, "text", *own).filter(F.col("label_id").isNotNull())


# A table of labels that is broadcast at most.
LABEL_ROWS, LABEL_BYTES = 1_000_000, 256 * 1024 * 1024


def label_map(spark: SparkSession, *tasks: Task) -> DataFrame:
    """``task, label, label_id, canonical``: every accepted spelling of the labels of some tasks."""
    rows = [(t.name, label, i, t.labels[i] == label) for t in tasks for label, i in t.aliases.items()]
    return spark.createDataFrame(rows, "task string, label string, label_id int, canonical boolean")


def encode_labels_by_table(
    df: DataFrame, table: DataFrame, task: str, max_rows: int = LABEL_ROWS, max_bytes: int = LABEL_BYTES
) -> DataFrame:
    """``encode_labels`` for a vocabulary that does not fit a literal.

    ``table`` is one like ``label_map``; of several ids of one spelling the smallest
    counts. Spellings are compared in lower case without white space around.
    The table is broadcast if its counted rows and bytes are within limits,
    else both sides are shuffled by the label.
    """
    own = table.filter(F.col("task") == task).select(labels.clean(F.col("label")).alias("_label"), "label_id")
    own = own.filter(F.col("_label").isNotNull()).groupBy("_label").agg(F.min("label_id").alias("label_id"))
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_label")), F.lit(0)).alias("bytes")).first()
    fits = size.n <= max_rows and size.bytes + 48 * size.n <= max_bytes
    keyed = df.withColumn("_label", labels.clean(F.col("label")))
    return keyed.join(F.broadcast(own) if fits else own, "_label").drop("_label")


def decode_labels_by_table(df: DataFrame, table: DataFrame, task: str) -> DataFrame:
    """Add the canonical ``label`` of ``label_id``; NULL for an unknown id."""
    names = table.filter((F.col("task") == task) & F.col("canonical")).groupBy("label_id").agg(F.min("label").alias("label"))
    return df.join(names, "label_id", "left")
