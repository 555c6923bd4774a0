"""Greedy leader clusters of a link table, in the order of ids.

In ascending order, each id that no earlier leader holds leads, and holds every later id that it links with and that is
still free. A round settles all ids whose smaller neighbours are settled, so rounds follow the longest chain of
undecided smaller neighbours and no neighbourhood is gathered in one place.

Defined results: an id without links leads itself; null ids and links to ids outside the nodes are left out; repeated or
reversed links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.operators.order import shared_dir


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark removes its files with the reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, leader for every id of ``nodes`` (id), from ``links`` (a, b)."""
    known = nodes.select("id").filter("id is not null").distinct()
    pairs = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("id")).filter("low <> id").distinct()
    pairs = _cut(pairs.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "low"), "low", "left_semi"))
    state = _cut(known.join(pairs.select("id").distinct().withColumn("waits", F.lit(True)), "id", "left").select("id", F.when(F.col("waits").isNull(), F.col("id")).alias("leader")))
    while state.filter("leader is null").limit(1).count():
        low = state.select(F.col("id").alias("low"), F.col("leader").alias("of_low"))
        open_pairs = pairs.join(state.filter("leader is null").select("id"), "id", "left_semi").join(low, "low")
        # A smaller leader holds the id once every still undecided neighbour before that leader is ruled out.
        seen = open_pairs.groupBy("id").agg(F.min(F.when(F.col("of_low") == F.col("low"), F.col("low"))).alias("first"), F.min(F.when(F.col("of_low").isNull(), F.col("low"))).alias("open"))
        held = F.when(F.col("first") < F.coalesce("open", F.col("id")), F.col("first"))
        settled = seen.select("id", F.coalesce(held, F.when(F.col("open").isNull(), F.col("id"))).alias("now"))
        state = _cut(state.join(settled, "id", "left").select("id", F.coalesce("leader", "now").alias("leader")))
    return state
