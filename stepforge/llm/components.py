"""Connected components of a link table, as alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.shared import discarded, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (a, b); only links move, never groups.

    Each round points every node's larger neighbours at the least one (large star) and then its smaller ones (small
    star); the number of rounds grows as the logarithm of the longest chain. No list of neighbours is ever collected. The
    links of a round are a written table, and rounds end when two have the same number of links and sum of their hashes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while (now := _summed(edges)) != before:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.filter("u <> v").distinct(), "edges")
        discarded(edges)
        edges, before = new, now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v")).distinct())


def _summed(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.min("u"), F.max("u")).first())
