"""Connected components of links, by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitext.session import materialise


def _nearest(edges: DataFrame) -> DataFrame:
    """Each vertex with its smallest neighbour or itself."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id, component_id`` (the smallest id reachable) for each id in a row ``a, b`` of ``links``.

    Each round sends every neighbour of a vertex that is larger (smaller) than
    it to the smallest of them, so a hub never gathers its neighbours in one
    row. The rounds grow with the logarithm of a component's size. Repeated
    links, loops and empty input are allowed. Each round is written to the
    shared folder.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = _both_ways(edges)
        large = both.filter("b > a").join(_nearest(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = low.select("a", F.col("m").alias("b")).union(low.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = materialise(small, "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots).distinct()
