"""Token rows, term frequencies, vocabularies and encoded token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civitext.functions import tokens as tok
from civitext.operators.lookup import TokenTable, join_tokens
from civitext.session import materialise


def tokenise(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per token: key, 0-based position, token."""
    return df.select(key, F.posexplode(tok.words(F.col(text_col))).alias("pos", "token"))


def term_frequencies(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of each token in each row."""
    rows = df.select(key, F.explode(tok.words(F.col(text_col))).alias("token"))
    return rows.groupBy(key, "token").agg(F.count("*").alias("n"))


def pad_and_mask(df: DataFrame, length: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens cut or filled to ``length`` with their attention mask; no shuffle."""
    words = df.select(key, tok.words(F.col(text_col)).alias("words"))
    return words.select(
        key,
        tok.pad(F.col("words"), length).alias("tokens"),
        tok.attention_mask(F.col("words"), length).alias("attention_mask"),
    )


def fit_vocabulary(df: DataFrame, text_col: str = "text") -> TokenTable:
    """Dense ids by falling frequency, then token; ids start at 1, 0 is the filler.

    Ids come from a distributed sort. The sorted rows are written first, each
    with its place inside its own partition, so that the partition offsets are
    taken from fixed data and not from a second, possibly different, sort.
    """
    words = df.select(F.explode(tok.words(F.col(text_col))).alias("token"))
    counts = words.groupBy("token").agg(F.count("*").alias("total"))
    placed = counts.orderBy(F.desc("total"), "token").withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed, "vocabulary")

    partition = F.shiftright("place", 33)
    in_partition = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(partition.alias("part")).agg(
        F.count("*").alias("n"), F.sum("total").alias("occurrences"), F.sum(F.octet_length("token")).alias("bytes")
    )
    # One row per sort partition enters this window and the broadcast.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    ids = (
        placed.withColumn("part", partition)
        .join(F.broadcast(offsets), "part")
        .select("token", (F.col("before") + in_partition + 1).alias("token_id"), "total")
    )
    size = sizes.agg(F.sum("n"), F.sum("bytes"), F.sum("occurrences")).first()
    rows, chars, occurrences = (int(v or 0) for v in size)
    return TokenTable(ids, rows, chars + 32 * rows, occurrences)


def encode(
    df: DataFrame,
    vocabulary: TokenTable,
    length: int,
    key: str = "doc_id",
    text_col: str = "text",
    **limits: int,
) -> DataFrame:
    """Arrays of ``length`` token ids and masks, in position order.

    Encoder input is cut at ``length`` tokens, so no group is longer than that.
    Tokens outside the vocabulary become 0, like the filler.
    """
    words = F.slice(tok.words(F.col(text_col)), 1, length)
    rows = df.select(key, F.posexplode_outer(words).alias("pos", "token"))
    joined = join_tokens(rows, vocabulary, key, **limits)
    entry = F.when(
        F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(0)).cast("long").alias("id"))
    )
    grouped = joined.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    ids = F.transform("entries", lambda e: e["id"])
    return grouped.select(
        key,
        tok.pad(ids, length, F.lit(0).cast("long")).alias("input_ids"),
        tok.attention_mask(ids, length).alias("attention_mask"),
    )
