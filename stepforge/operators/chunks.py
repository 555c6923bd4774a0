"""Key and value chunks of step-ordered trajectories, as window functions of one trajectory each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT, GUIDANCE = 5, 5


def steps_window(trajectory: str, *order: str):
    return Window.partitionBy(trajectory).orderBy(*order)


def context(entry: Column, w, n: int = CONTEXT) -> Column:
    """The previous n entries, without the current, joined by ' ; '; '' at the start."""
    return F.array_join(F.collect_list(entry).over(w.rowsBetween(-n, -1)), " ; ")


def guidance(entry: Column, w, n: int = GUIDANCE) -> Column:
    """The current and the next n - 1 entries."""
    return F.collect_list(entry).over(w.rowsBetween(0, n - 1))


def is_last(w) -> Column:
    return F.lead(F.lit(1)).over(w).isNull()


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep-first dedup by ``keys`` in ``order``; each task keeps its own first row of a key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("first"))
    return first.select(*keys, *[F.col(f"first.{c}") for c in rest])


def first_match(df: DataFrame, trajectory: str, index: str, matched: Column) -> DataFrame:
    """The first step of each trajectory that matches."""
    return df.filter(matched).groupBy(trajectory).agg(F.min(index).alias("first_step"))
