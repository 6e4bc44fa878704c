"""Labelled corpora derived from the given tables.

The tables hold neither the labels nor the noise of social-media text, so both
are derived from keys and values, always for whole tables. The SQL oracle
states the same derivations on its side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions import tokens as tok
from civitext.session import cut, scan_parts

# The schemas of the given tables that carry text or labels.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
}

HARM_NAME, ROLES_NAME = "labelled_documents", "conversation_roles"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return cut(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", scan_parts(spark))


def _split_by(n: Column) -> Column:
    """Seven tenths ``train``, one ``validation``, two ``test``, by the last digit."""
    digit = F.pmod(n, F.lit(10))
    return F.when(digit <= 6, "train").when(digit == 7, "validation").otherwise("test")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a row in ``labels``; only those are cut into parts."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return cut(texts.join(table(spark, sf_dir, "labels"), "doc_id"), "doc_id", scan_parts(spark))


def _harm_label() -> Column:
    return F.when(F.col("toxic") == 1, "hate").when(F.col("quality") == 0, "abusive").otherwise("normal")


def _veracity_label() -> Column:
    return F.when(F.col("quality") == 1, "real").otherwise("fake")


def harm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents for the harm task, with a predefined split."""
    return _labelled(spark, sf_dir).select("doc_id", "text", "lang", _harm_label().alias("label"), _split_by(F.col("doc_id")).alias("split"))


def veracity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents for the veracity task."""
    return _labelled(spark, sf_dir).select("doc_id", "text", "lang", _veracity_label().alias("label"))


def both_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a label for either task."""
    return _labelled(spark, sf_dir).select("doc_id", "text", _harm_label().alias("harm"), _veracity_label().alias("veracity"))


def harm_without_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = F.when(F.col("split") == "validation", "train").otherwise(F.col("split"))
    return harm(spark, sf_dir).withColumn("split", merged)


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the second corpus: text in ``tweet``, labels in mixed case."""
    turns = cut(table(spark, sf_dir, "conversations"), "conv_id", scan_parts(spark))
    label = F.when(F.col("role") == "user", "Hate").when(F.col("role") == "assistant", "Offensive").otherwise("Normal")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("text").alias("tweet"),
        label.alias("label"),
        _split_by(F.col("conv_id")).alias("split"),
    )


def messy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harm corpus with missing, unknown, upper-case and padded labels, other column names."""
    return harm(spark, sf_dir).select("doc_id", F.col("text").alias("content"), _messy("label").alias("tag"), "split", "lang")


def _messy(label: str) -> Column:
    by = lambda n: F.pmod(F.col("doc_id"), F.lit(n)) == 0
    return (
        F.when(by(17), F.lit(None))
        .when(by(13), "UNKNOWN")
        .when(by(3), F.upper(label))
        .when(by(2), F.concat(F.lit(" "), F.col(label), F.lit("\t")))
        .otherwise(F.col(label))
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harm corpus with messy labels on texts of which some are NULL, blank or near-empty."""
    labelled = table(spark, sf_dir, "labels").withColumn("label", _harm_label())
    return sparse(spark, sf_dir).join(labelled, "doc_id").select("doc_id", "text", _messy("label").alias("label"))


def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large vocabulary: every word of the conversations as a spelling of a label, numbered by word."""
    words = table(spark, sf_dir, "conversations").select(F.explode(tok.words(F.col("text"))).alias("label")).distinct()
    number = F.conv(F.substring(F.md5(F.col("label").cast("binary")), 1, 7), 16, 10).cast("int")
    return words.select(F.lit("words").alias("task"), "label", number.alias("label_id"), F.lit(True).alias("canonical"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with one kind of social-media noise appended."""
    number = F.col("doc_id").cast("string")
    kind = F.pmod(F.col("doc_id"), F.lit(7))
    noise = (
        F.when(kind == 0, F.concat(F.lit(" https://ex.org/"), number, F.lit("?a=b")))
        .when(kind == 1, F.concat(F.lit(" @user"), number, F.lit(" a.b@example.com")))
        .when(kind == 2, F.concat(F.lit(" #ሰላም"), number, F.lit(" \u1215\u1206\u1a00")))
        .when(kind == 3, F.lit(" 😊🚀 漢字"))
        .when(kind == 4, F.lit(" !!!?? ok..."))
        .when(kind == 5, F.lit("\u00a0\t x \u3000"))
        .otherwise(F.lit(" cafe\u0301"))
    )
    return documents(spark, sf_dir).withColumn("text", F.concat("text", noise))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy documents of which some are NULL, blank or nothing but a mention."""
    by = lambda n: F.pmod(F.col("doc_id"), F.lit(n)) == 0
    text = (
        F.when(by(23), F.lit(None))
        .when(by(19), F.lit(" \t\u00a0"))
        .when(by(11), F.lit(" @u ab"))
        .otherwise(F.col("text"))
    )
    return noisy(spark, sf_dir).withColumn("text", text)


def synthetic_predictions(spark: SparkSession, sf_dir: str, mark: str, classes: int, df: DataFrame) -> DataFrame:
    """``y_true`` and a ``y_pred`` that is wrong for about a quarter of the rows."""
    return df.select("doc_id", F.col("label_id").alias("y_true"), synthetic_prediction(mark, classes).alias("y_pred"))


def synthetic_prediction(mark: str, classes: int) -> Column:
    wrong = F.substring(F.md5(F.concat(F.lit(f"{mark}:"), F.col("doc_id").cast("string"))), 1, 1) < "4"
    return F.when(wrong, F.pmod(F.col("label_id") + 1, F.lit(classes))).otherwise(F.col("label_id"))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a seventh of them twice, and a NULL key for an eleventh."""
    by = lambda n: F.pmod(F.col("doc_id"), F.lit(n)) == 0
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.union(rows.filter(by(7))).withColumn("doc_id", F.when(~by(11), F.col("doc_id")))
