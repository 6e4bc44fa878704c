"""Exact, reproducible stratified splits.

A row's place in its class is its rank by ``md5(seed:key)``, a fixed random
order. Each split takes a range of ranks, so a class needs only two cut hashes
and the assignment is a comparison: no shuffle and no join of the data. The
cuts are found by narrowing hash prefixes, each step one aggregation over keys
and labels, until the prefix that holds a cut is small enough to rank.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A hash prefix with at most this many rows is ranked directly.
RANK_LIMIT = 1_000_000
# Hex digits added per narrowing step: 4,096 buckets for each class.
_DIGITS = 3


def key_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def share(rows: int, fraction: Fraction) -> int:
    """Rows in a split: the fraction rounded up, in exact arithmetic."""
    return math.ceil(rows * fraction)


def quotas(counts: Mapping[int, int], total: int) -> dict[int, int]:
    """Apportion ``total`` rows to classes by largest remainder; ties to the lowest id."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    seats = {c: k * total // n for c, k in counts.items()}
    left = total - sum(seats.values())
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * total % n), c))
    for c in by_remainder[:left]:
        seats[c] += 1
    return seats


@dataclass(frozen=True)
class Cuts:
    """The fitted split: per class, the last hash of each held-out part."""

    seed: int
    names: tuple[str, ...]
    bounds: dict[int, tuple[str, ...]]
    rest: str = "train"

    def column(self, label_id: Column, key: Column) -> Column:
        hashed = key_hash(key, self.seed)
        result = F.lit(self.rest)
        for i in reversed(range(len(self.names))):
            entries = ", ".join(f"{label}, '{b[i]}'" for label, b in self.bounds.items())
            bound = F.try_element_at(F.expr(f"map({entries})"), label_id)
            result = F.when(hashed <= bound, F.lit(self.names[i])).otherwise(result)
        return result


@dataclass(frozen=True)
class _Target:
    """A wanted rank inside one hash prefix of one class."""

    label_id: int
    part: int
    prefix: str
    rank: int
    rows: int


def _any(conditions: list[str]) -> str:
    return " OR ".join(f"({c})" for c in conditions)


def _inside(t: _Target) -> str:
    return f"label_id = {t.label_id} AND startswith(h, '{t.prefix}')"


def _narrow(rows: DataFrame, targets: list[_Target]) -> list[_Target]:
    """Replace each target's prefix by the longer one that holds its rank."""
    width = len(targets[0].prefix)
    parent, bucket = F.substring("h", 1, width), F.substring("h", 1, width + _DIGITS)
    sizes = (
        rows.filter(_any([_inside(t) for t in targets]))
        .groupBy("label_id", parent.alias("parent"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    # At most 4,096 buckets per class and parent enter one window.
    upto = F.sum("n").over(Window.partitionBy("label_id", "parent").orderBy("bucket"))
    ranked = sizes.withColumn("upto", upto)
    wanted = [
        f"label_id = {t.label_id} AND parent = '{t.prefix}' AND upto >= {t.rank} AND upto - n < {t.rank}"
        for t in targets
    ]
    found = ranked.filter(_any(wanted)).collect()  # at most one row per target
    narrowed = []
    for t in targets:
        hit = next(
            r for r in found if r.label_id == t.label_id and r.parent == t.prefix and r.upto - r.n < t.rank <= r.upto
        )
        narrowed.append(_Target(t.label_id, t.part, hit.bucket, t.rank - (hit.upto - hit.n), hit.n))
    return narrowed


def _locate(rows: DataFrame, targets: list[_Target]) -> dict[tuple[int, int], str]:
    """The hash at each target's rank."""
    found: dict[tuple[int, int], str] = {}
    large = [t for t in targets if t.rows > RANK_LIMIT]
    small = [t for t in targets if t.rows <= RANK_LIMIT]
    while large:
        narrowed = _narrow(rows, large)
        # A full-length prefix is a hash by itself.
        found |= {(t.label_id, t.part): t.prefix for t in narrowed if len(t.prefix) >= 32}
        narrowed = [t for t in narrowed if len(t.prefix) < 32]
        small += [t for t in narrowed if t.rows <= RANK_LIMIT]
        large = [t for t in narrowed if t.rows > RANK_LIMIT]
    for width in sorted({len(t.prefix) for t in small}):
        group = [t for t in small if len(t.prefix) == width]
        place = F.row_number().over(Window.partitionBy("label_id", "prefix").orderBy("h"))
        ranked = (
            rows.filter(_any([_inside(t) for t in group]))
            .withColumn("prefix", F.substring("h", 1, width))
            .withColumn("place", place)
        )
        wanted = [f"label_id = {t.label_id} AND prefix = '{t.prefix}' AND place = {t.rank}" for t in group]
        hits = ranked.filter(_any(wanted)).select("label_id", "prefix", "place", "h").collect()
        by_place = {(r.label_id, r.prefix, r.place): r.h for r in hits}
        found |= {(t.label_id, t.part): by_place[t.label_id, t.prefix, t.rank] for t in group}
    return found


def class_counts(df: DataFrame) -> dict[int, int]:
    """Rows per class: one row per label id reaches the driver."""
    return {r.label_id: r.n for r in df.groupBy("label_id").agg(F.count("*").alias("n")).collect()}


def fit_cuts(df: DataFrame, parts: Mapping[str, Fraction], seed: int = 42, key: str = "doc_id") -> Cuts:
    """Find the cuts for ``parts``; each fraction is of what the earlier ones left."""
    counts = class_counts(df)
    left, taken, targets = dict(counts), dict.fromkeys(counts, 0), []
    empty: set[tuple[int, int]] = set()
    for i, fraction in enumerate(parts.values()):
        seats = quotas(left, share(sum(left.values()), fraction))
        for c, k in seats.items():
            taken[c] += k
            left[c] -= k
            if taken[c]:
                targets.append(_Target(c, i, "", taken[c], counts[c]))
            else:
                empty.add((c, i))
    rows = df.select("label_id", key_hash(F.col(key), seed).alias("h"))
    hashes = _locate(rows, targets) if targets else {}
    hashes |= dict.fromkeys(empty, "")
    bounds = {c: tuple(hashes[c, i] for i in range(len(parts))) for c in sorted(counts)}
    return Cuts(seed, tuple(parts), bounds)


def _apply(df: DataFrame, cuts: Cuts, key: str) -> DataFrame:
    if not cuts.bounds:  # no rows
        return df.withColumn("split", F.lit(cuts.rest))
    return df.withColumn("split", cuts.column(F.col("label_id"), F.col(key)))


def stratified_cuts(
    df: DataFrame, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42, key: str = "doc_id"
) -> Cuts:
    """Cuts for test and validation, both sizes given as fractions of all rows."""
    test, val = Fraction(str(test_size)), Fraction(str(val_size))
    return fit_cuts(df, {"test": test, "val": val / (1 - test)}, seed, key)


def stratified_split(
    df: DataFrame, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """Add a ``split`` column that keeps class shares; ``df`` should be a table."""
    return _apply(df, stratified_cuts(df, test_size, val_size, seed, key), key)


def predefined_split(df: DataFrame) -> DataFrame:
    """Use the corpus's own split column, with ``validation`` shortened to ``val``."""
    named = df.withColumn("split", F.when(F.col("split") == "validation", "val").otherwise(F.col("split")))
    return named.filter(F.col("split").isin("train", "val", "test"))


def carve_validation(df: DataFrame, val_size: float = 0.15, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """If no row is in ``val``, move a stratified part of ``train`` there."""
    if not df.filter(F.col("split") == "val").isEmpty():
        return df
    train = df.filter(F.col("split") == "train")
    cuts = fit_cuts(train, {"val": Fraction(str(val_size))}, seed, key)
    if not cuts.bounds:
        return df
    carved = cuts.column(F.col("label_id"), F.col(key))
    return df.withColumn("split", F.when(F.col("split") == "train", carved).otherwise(F.col("split")))


def split_label_report(df: DataFrame, label_name: Column) -> DataFrame:
    """Rows per split and class, with the class name."""
    counts = df.groupBy("split", "label_id").agg(F.count("*").alias("n"))
    return counts.select("split", "label_id", label_name.alias("label"), "n")


def overlapping_keys(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of keys, and of keys that occur in more than one split."""
    per_key = df.groupBy(key).agg((F.min("split") != F.max("split")).alias("overlaps"))
    return per_key.agg(F.count("*").alias("n_keys"), F.count_if("overlaps").alias("n_overlapping"))


def shared_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Number of different texts, of those that several splits hold, and of the rows of the latter."""
    per_text = df.groupBy(F.md5(F.col(text_col).cast("binary")).alias("text")).agg(
        (F.min("split") != F.max("split")).alias("shared"), F.count("*").alias("n")
    )
    return per_text.agg(
        F.count("*").alias("n_texts"),
        F.count_if("shared").alias("n_shared"),
        F.coalesce(F.sum(F.when(F.col("shared"), F.col("n"))), F.lit(0)).alias("n_rows_shared"),
    )
