"""Corpus profiles: counts, label and split shares, lengths, samples, script."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civitext.functions import text as tx


def stack(datasets: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The named columns of several datasets under one ``dataset`` tag."""
    parts = [df.select(F.lit(name).alias("dataset"), *columns) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dataset_summary(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per dataset; an empty one is reported as not loaded."""

    def line(name: str, df: DataFrame) -> DataFrame:
        loaded = F.col("rows") > 0
        columns = F.array(*(F.lit(c) for c in df.columns))
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("dataset"),
            F.when(loaded, "LOADED").otherwise("NOT LOADED").alias("status"),
            "rows",
            F.when(loaded, columns).alias("columns"),
        )

    return reduce(lambda a, b: a.unionByName(b), [line(n, d) for n, d in datasets.items()])


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per dataset and label, and their percentage of the dataset."""
    counts = df.groupBy("dataset", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("dataset"))
    return counts.select("dataset", "label", "n", F.round(F.col("n") / total * 100, 1).alias("pct"))


def split_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "split").agg(F.count("*").alias("n"))


def text_lengths(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Length of each text in characters; NULL texts are left out."""
    return df.filter(F.col("text").isNotNull()).select(key, F.length("text").cast("long").alias("length"))


def length_frequencies(df: DataFrame) -> DataFrame:
    """Rows per dataset and text length.

    There are far fewer lengths than rows, so this is the one pass over the
    data that both the histogram and the exact median need.
    """
    lengths = df.filter(F.col("text").isNotNull()).select("dataset", F.length("text").cast("long").alias("length"))
    return lengths.groupBy("dataset", "length").agg(F.count("*").alias("n"))


def length_histogram(frequencies: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width bins from the shortest to the longest text, empty bins included.

    A bin holds its lower edge but not its upper one; the last holds both. If
    all texts have one length, the range is widened by a half on either side.
    """
    whole = Window.partitionBy("dataset")
    ranged = frequencies.withColumn("lo", F.min("length").over(whole).cast("double"))
    ranged = ranged.withColumn("hi", F.max("length").over(whole).cast("double"))
    margin = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ranged = ranged.withColumn("margin", margin).withColumns(
        {"lo": F.col("lo") - F.col("margin"), "hi": F.col("hi") + F.col("margin")}
    )
    place = F.width_bucket(F.col("length"), F.col("lo"), F.col("hi"), F.lit(bins))
    binned = ranged.withColumn("bin", F.least(place.cast("int"), F.lit(bins)))
    per_bin = binned.groupBy("dataset", "lo", "hi", "bin").agg(F.sum("n").alias("n"))
    # At most ``bins`` rows per dataset are grouped here.
    filled = per_bin.groupBy("dataset", "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    rows = filled.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return rows.select(
        "dataset",
        "bin",
        F.round(F.col("lo") + step * (F.col("bin") - 1), 4).alias("lower"),
        F.round(F.col("lo") + step * F.col("bin"), 4).alias("upper"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("n"),
    )


def length_median(frequencies: DataFrame) -> DataFrame:
    """Exact median length, the mean of the two middle ones for an even count."""
    weighted = F.percentile("length", F.lit(0.5), F.col("n"))
    return frequencies.groupBy("dataset").agg(F.sum("n").alias("n"), weighted.alias("median_length"))


# Size of the sketches, and how far (as a share of the rows) the rank of a
# quantile may lie from the one asked for: the sketch's own bound at 99 percent
# for this size, which is 1.33 percent, with room for merges.
SKETCH_SIZE, RANK_ERROR = 200, 0.02


def length_sketches(df: DataFrame, by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """A quantile sketch of the text lengths of each group, in a few KB whatever its rows.

    Sketches can be stored, and merged later into those of coarser groups
    without the texts.
    """
    lengths = df.filter(F.col("text").isNotNull()).select(*by, F.length("text").cast("long").alias("length"))
    return lengths.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("length", F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_quantile(sketches: DataFrame, share: float, name: str = "length") -> DataFrame:
    """The length at a share of the rows, exact up to the sketch's rank error."""
    return sketches.withColumn(name, F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))).withColumn("share", F.lit(share)).drop("sketch")


def rank_error(estimated: DataFrame, frequencies: DataFrame) -> DataFrame:
    """How far the rank of each estimated ``length`` lies from its ``share``, by the exact counts of ``length_frequencies``."""
    exact = frequencies.select("dataset", F.col("length").alias("_length"), F.col("n").alias("_n"))
    joined = estimated.join(exact, "dataset").groupBy("dataset", "n", "share", "length")
    below, upto = (F.sum(F.when(test, F.col("_n")).otherwise(0)) for test in (F.col("_length") < F.col("length"), F.col("_length") <= F.col("length")))
    ranked = joined.agg((below / F.sum("_n")).alias("low"), (upto / F.sum("_n")).alias("high"))
    gap = F.greatest(F.col("low") - F.col("share"), F.col("share") - F.col("high"), F.lit(0.0))
    return ranked.select("dataset", "n", "share", "length", gap.alias("rank_error"))


def sample_per_class(df: DataFrame, k: int = 2, seed: int = 42, key: str = "doc_id", preview: int = 120) -> DataFrame:
    """``k`` random rows of each class with the start of their text.

    Rows are ranked by a seeded hash of the key. A row is cut to its preview
    before it is sorted, and each task keeps only its own first ``k`` per class
    for the shuffle, so this is one pass without a join.
    """
    order = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    short = df.filter(F.col("text").isNotNull()).select("label", key, F.substring("text", 1, preview).alias("preview"))
    ranked = short.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("label", "rank", key, "preview")


def script_coverage(df: DataFrame, by: str) -> DataFrame:
    """Share of Ethiopic characters per group and how many different ones occur.

    Each row sends its totals once and each different Ethiopic character once;
    the block has 384 code points, which bounds both levels of grouping.
    """
    rows = df.filter(F.col("text").isNotNull()).withColumn("ethiopic", tx.ethiopic_only(F.col("text")))
    length = F.length("text").cast("long")
    found = F.length("ethiopic").cast("long")

    def part(char, n, chars, ethiopic):
        return F.struct(
            char.cast("string").alias("char"), n.alias("n"), chars.alias("chars"), ethiopic.alias("ethiopic")
        )

    nothing = F.lit(0).cast("long")
    totals = F.array(part(F.lit(None), F.lit(1).cast("long"), length, found))
    # Splitting an empty string gives one empty entry.
    distinct = F.array_remove(F.array_distinct(F.split("ethiopic", "")), "")
    marks = F.transform(distinct, lambda c: part(c, nothing, nothing, nothing))
    exploded = rows.select(by, F.explode(F.concat(totals, marks)).alias("e"))
    sums = [F.sum(f"e.{c}").alias(c) for c in ("n", "chars", "ethiopic")]
    per_char = exploded.groupBy(by, F.col("e.char").alias("char")).agg(*sums)
    return per_char.groupBy(by).agg(
        F.sum("n").alias("n_texts"),
        F.sum("chars").alias("n_chars"),
        F.sum("ethiopic").alias("n_ethiopic"),
        F.round(F.coalesce(F.sum("ethiopic") / F.nullif(F.sum("chars"), F.lit(0)), F.lit(0.0)), 6).alias("coverage"),
        F.count("char").alias("distinct_ethiopic"),
    )


def normalise_preview(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each text before and after normalisation, and whether it changed."""
    rows = df.select(key, "text", tx.normalise(F.col("text")).alias("normalised"))
    return rows.withColumn("changed", ~F.col("text").eqNullSafe(F.col("normalised")))
