"""The corpus pipeline: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes what the one before it kept, written as Parquet and read
again. All but the last return the columns of ``documents``, and further columns
that a table brings, whatever their names: a stage sees its own columns, and the
others travel in one struct.

A document is a pair of ``doc_id`` and text. Rows that are equal in both are one
document, of which the row that comes first in JSON order stays where a stage needs one;
different texts under one id are documents each, also where the id is null.
Ties between documents go to the smaller id; documents whose id is null or has several
texts come after the others, in the order of a hash. Null and empty texts are documents without
words: quality scores them like any text, near_dedup keeps them, mix leaves them out.
Texts are read whole whatever their length. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.llm import byte_bpe, hyperminhash, mixing, quality_cnn, secret_scan, text_arrays
from civitext.session import materialise

#: Texts are near-duplicates from this share of common shingles on.
PERCENT = 80


def _own(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others as one struct ``row``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("row"))


def _back(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of a table that went through :func:`_own`, some of them replaced."""
    stored = df.schema["row"].dataType.fieldNames()
    read = lambda c: replaced.get(c, F.col("row").getField(c) if c in stored else F.col(c)).alias(c)
    return df.select(*map(read, columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row`` with ``key``, one row for each document: the id, or a large number made from id and text where the id does not name one text."""
    own = _own(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    print_of = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    # written first, so that a short list is broadcast and the texts stay where they are
    repeated = own.groupBy("doc_id").agg(F.count("*").alias("copies"), (F.min(print_of) != F.max(print_of)).alias("several")).filter("copies > 1 AND doc_id IS NOT NULL")
    repeated = materialise(repeated.withColumnRenamed("doc_id", "its_id"), "repeated-ids")
    made = F.xxhash64("doc_id", print_of).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    named = own.join(repeated, F.col("doc_id") == F.col("its_id"), "left")
    named = named.withColumn("key", F.when(F.col("doc_id").isNull() | F.col("several"), made).otherwise(F.col("doc_id")))
    # one condition on both sides of the join, so that a join that is not broadcast is made once for both parts
    named = named.withColumn("copies", F.coalesce("copies", F.when(F.col("doc_id").isNull(), 2).otherwise(1))).drop("its_id", "several")
    first = Window.partitionBy("key").orderBy(F.to_json("row"))
    firsts = named.filter("copies > 1").withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
    return named.filter("copies = 1").union(firsts).drop("copies")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the network, learned on labelled ones, predicts as 0; equal rows are judged alike."""
    net = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    text_arrays.release()  # what the fit took in the driver
    scored = quality_cnn.score_quality(_own(docs, "text"), net, keep_text=True)
    return _back(scored.filter("predicted = 1"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id; documents without words stay."""
    keyed = materialise(_keyed(docs), "documents")
    found = hyperminhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), percent=PERCENT)
    dropped = materialise(found.filter("NOT kept").select(F.col("doc_id").alias("key")), "dropped")
    return _back(keyed.join(dropped, "key", "left_anti"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; no row goes."""
    return _back(secret_scan.mask_secrets(_own(docs, "text")), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document the words that the mix takes from it, joined by one space; those without any go.

    White space of the source becomes single spaces, and ``n_chars`` follows the text.
    """
    keyed = materialise(_keyed(docs), "documents")
    named = keyed.withColumnRenamed("doc_id", "own_id").withColumnRenamed("key", "doc_id")
    source = F.col("row").getField("source").alias("source")
    sizes = materialise(mixing.sizes_of(named.select("doc_id", "text", source)), "mix-sizes")
    mixed = mixing.mixed_texts(named, sizes)
    return _back(mixed, docs.columns, doc_id=F.col("own_id"), n_chars=F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids``: the token ids of every row as little-endian 32-bit integers."""
    coded = byte_bpe.encode(docs.select("doc_id", "text", "lang", "source"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: The quality network and the tokenizer have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
