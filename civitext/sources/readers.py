"""Corpus readers. Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

CORPUS_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("label", StringType()),
        StructField("split", StringType()),
    ]
)

ENCODED_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("label", StringType()),
        StructField("label_id", IntegerType()),
        StructField("split", StringType()),
    ]
)

# Quotes inside a field are doubled, line breaks may occur inside quotes.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: StructType = CORPUS_SCHEMA) -> DataFrame | None:
    """Read a CSV corpus, or return ``None`` when the path does not exist.

    Only an empty field is NULL; words such as ``NA`` are text.

    A file with line breaks inside fields is read by one task, so a large
    corpus should lie in many files (as ``writers.write_csv`` leaves it).
    """
    try:
        return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a table of splits; naming one prunes the other partitions."""
    table = spark.read.schema(ENCODED_SCHEMA).parquet(path)
    return table if split is None else table.filter(F.col("split") == split)


def union_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """Tag the rows of each frame with its split name and stack the frames."""
    tagged = [df.withColumn("split", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def harmonise(df: DataFrame, lower_labels: bool = False) -> DataFrame:
    """Give the text column its standard name, and optionally lower-case labels.

    ``tweet`` is renamed only when there is no ``text`` column already, so the
    result never holds two columns of one name.
    """
    if "tweet" in df.columns and "text" not in df.columns:
        df = df.withColumnRenamed("tweet", "text")
    if lower_labels and "label" in df.columns:
        df = df.withColumn("label", F.lower("label"))
    return df
