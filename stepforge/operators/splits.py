"""Quotas, stratified samples, distribution shift and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.order import numbered


def hamilton(strata: DataFrame, key: str, total: int) -> DataFrame:
    """Largest-remainder quotas of ``total`` over strata (key, cap); leftovers by fraction, cap and key, all descending."""
    everything = Window.partitionBy()
    raw = F.lit(total) * F.col("cap") / F.sum("cap").over(everything)
    out = strata.withColumn("raw", raw).withColumn("floor", F.floor("raw")).withColumn("fraction", F.round(F.col("raw") - F.col("floor"), 9))
    left = F.lit(total) - F.sum("floor").over(everything)
    turn = F.row_number().over(Window.orderBy(F.desc("fraction"), F.desc("cap"), F.desc(key)))
    return out.withColumn("left", left).withColumn("turn", turn).select(key, "cap", (F.col("floor") + (F.col("turn") <= F.col("left")).cast("long")).alias("quota"))


def nested_quotas(counts: DataFrame, levels: list[str], total: int) -> DataFrame:
    """Largest-remainder quotas shared level by level: ``counts`` (levels and cap) with the quota of each innermost group.

    A level's groups share their parent's quota by size; ties go to the larger and then the later group. Counts are a row
    for each innermost group."""
    inner = counts.select(*levels, "cap")
    quotas = inner.agg(F.sum("cap").alias("all")).select(F.least(F.lit(total), F.col("all")).alias("quota"))
    for depth in range(1, len(levels) + 1):
        parent, own = levels[: depth - 1], levels[:depth]
        sizes = inner.groupBy(*own).agg(F.sum("cap").alias("cap"))
        sizes = sizes.join(quotas, parent) if parent else sizes.withColumn("quota", F.lit(quotas.first()[0]))
        w = Window.partitionBy(*parent)
        raw = F.col("quota") * F.col("cap") / F.sum("cap").over(w)
        sizes = sizes.withColumn("raw", raw).withColumn("low", F.floor("raw")).withColumn("fraction", F.round(F.col("raw") - F.col("low"), 9))
        turn = F.row_number().over(w.orderBy(F.desc("fraction"), F.desc("cap"), F.desc(levels[depth - 1])))
        spare = F.col("quota") - F.sum("low").over(w)
        quotas = sizes.withColumn("got", F.col("low") + (turn <= spare).cast("long")).select(*own, F.col("got").alias("quota"))
    return quotas


def proportional(counts: DataFrame, key: str, share: float) -> DataFrame:
    """key, cap, quota: max(1, floor(share * cap)) of each stratum."""
    return counts.select(key, "cap", F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("cap"))).cast("long").alias("quota"))


def held_out(df: DataFrame, group: str, id_: str, seed: str, limit: int) -> DataFrame:
    """``df`` with part: ``validation`` for the first ``limit`` ids of each group in the order of a seeded digest, else ``test``."""
    order = F.md5(F.concat(F.lit(seed), F.col(id_).cast("string")))
    first = firsts(df.select(group, id_), [group], [order, id_], limit).select(id_, F.lit("validation").alias("part"))
    return df.join(first, id_, "left").withColumn("part", F.coalesce("part", F.lit("test")))


def shifts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """attribute, tvd: half the sum of absolute differences of the two distributions of each of ``keys``; 0 if either is empty."""
    each = lambda d, side: d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e")).select("e.*", F.lit(side).alias("side"))
    counts = each(left, 0).unionByName(each(right, 1)).groupBy("attribute", "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sums = counts.groupBy("attribute").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    gap = F.abs(F.col("a") / F.col("all_a") - F.col("b") / F.col("all_b"))
    empty = (F.max("all_a") == 0) | (F.max("all_b") == 0)
    both = counts.join(F.broadcast(sums), "attribute")  # a row for each key
    return both.filter("all_a > 0 and all_b > 0").groupBy("attribute").agg(F.when(empty, 0.0).otherwise(F.round(F.sum(gap) / 2, 6)).alias("tvd")).unionByName(sums.filter("all_a = 0 or all_b = 0").select("attribute", F.lit(0.0).alias("tvd")))


def firsts(df: DataFrame, groups: list[str], order: list, limit: int) -> DataFrame:
    """``df`` with pick, the first ``limit`` rows of each group. The limit is a number, so each task keeps its own first
    rows of a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("pick", rank).filter(F.col("pick") <= limit)


def stratified(df: DataFrame, key: str, id_: str, quotas: DataFrame, seed: str) -> DataFrame:
    """Rows of each stratum up to its quota, in the order of a seeded digest of the id."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    order = F.md5(F.concat(F.lit(seed), F.col(id_).cast("string")))
    return firsts(df, [key], [order, id_], int(most)).join(quotas.select(key, "quota"), key).filter(F.col("pick") <= F.col("quota"))


def rare_first(df: DataFrame, combo: str, intent: str, id_: str, quota: int) -> DataFrame:
    """Round-robin over the intents of a combo, rare intents first, one id a round, ``quota`` ids a combo."""
    counts = df.groupBy(intent).agg(F.count(F.lit(1)).alias("in_all"))
    local = df.groupBy(combo, intent).agg(F.count(F.lit(1)).alias("in_combo"))
    # No combo takes more than quota ids of one intent.
    rounds = firsts(df, [combo, intent], [id_], quota).withColumnRenamed("pick", "round").join(counts, intent).join(local, [combo, intent])
    return firsts(rounds, [combo], ["round", "in_all", "in_combo", intent], quota)


def total_variation(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Half the sum of absolute differences of two distributions of ``key``; 0 if either is empty."""
    a, b = (d.groupBy(key).agg(F.count(F.lit(1)).alias("n")) for d in (left, right))
    share = lambda d: d.crossJoin(F.broadcast(d.agg(F.sum("n").alias("all")))).select(key, (F.col("n") / F.col("all")).alias("p"))  # noqa: E731  one row of totals
    both = share(a).withColumnRenamed("p", "pa").join(share(b).withColumnRenamed("p", "pb"), key, "full")
    empty = (F.max("pa").isNull()) | (F.max("pb").isNull())
    return both.agg(F.when(empty, 0.0).otherwise(F.round(F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))) / 2, 6)).alias("tvd"))


def step_bins(df: DataFrame, column: str, shares=(0.1, 0.25, 0.5, 0.75, 0.9)) -> list:
    """Strictly rising edges at the round((n - 1) q)-th values, from one count of each value, in one collect of the edges."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(counts, column)
    # Prefix sums in two levels: runs of the order, values of a run.
    placed = placed.withColumn("run", F.floor(F.col("place") / 4096))
    runs = placed.groupBy("run").agg(F.sum("n").alias("of_run"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("of_run").over(earlier), F.lit(0)).alias("before"), F.sum("of_run").over(Window.partitionBy()).alias("all"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("run").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    spans = placed.join(runs, "run").withColumn("upto", upto)
    wanted = F.array(*[F.bround((F.col("all") - 1) * F.lit(q), 0).cast("long") for q in shares])
    held = F.exists(wanted, lambda i: (i < F.col("upto")) & (i >= F.col("upto") - F.col("n")))
    return [r[0] for r in spans.filter(held).select(column).orderBy(column).collect()]


def bin_label(column: Column, edges: list) -> Column:
    if not edges:
        return F.lit("all")
    out = F.when(column <= edges[0], f"<= {edges[0]}")
    for low, high in zip(edges, edges[1:]):
        out = out.when(column <= high, f"{low + 1}-{high}")
    return out.otherwise(f">= {edges[-1] + 1}")


def capped_quotas(strata: DataFrame, key: str, total: int, least: int = 0) -> DataFrame:
    """key, cap, quota: ``total`` shared over strata (key, cap) that can take at most ``cap`` each.

    Every stratum that is not empty first gets ``least`` (or all it has) where the total suffices for that; the rest goes by
    the capacity that is left, rounded down, and what remains by the largest fractions, then sizes, then keys, one each. A
    total beyond all capacity is refused. Strata are a bounded dimension: they are ranked in one window."""
    known = strata.select(key, F.coalesce(F.col("cap"), F.lit(0)).cast("long").alias("cap"))
    room, eligible, low = known.agg(F.sum("cap"), F.count_if(F.col("cap") > 0), F.min("cap")).first()
    if total < 0 or least < 0 or (low or 0) < 0:
        raise ValueError("quotas and capacities are not negative")
    if total > (room or 0):
        raise ValueError(f"a total of {total} is beyond the capacity of {room or 0}")
    first = F.least(F.lit(least), F.col("cap")) if least * (eligible or 0) <= total else F.lit(0)
    given = known.withColumn("first", first.cast("long")).withColumn("room", F.col("cap") - F.col("first"))
    rooms, firsts_ = given.agg(F.sum("room"), F.sum("first")).first()
    rest = total - (firsts_ or 0)
    # Whole division and its remainder: exact for any size.
    share = F.lit(rest).cast("decimal(19,0)") * F.col("room").cast("decimal(19,0)")
    given = given.withColumn("floor", (F.expr("0L") if not rooms else F.floor(share / F.lit(rooms))).cast("long"))
    over = (share - F.col("floor").cast("decimal(19,0)") * F.lit(rooms or 1)).cast("decimal(38,0)")
    given = given.withColumn("over", over).withColumn("left", F.lit(rest) - F.sum("floor").over(Window.partitionBy()))
    # Fractions leave fewer units than there are strata with room, so one round is enough.
    turn = F.row_number().over(Window.orderBy(F.desc(F.col("room") > F.col("floor")), F.desc("over"), F.desc("cap"), F.desc(key)))
    return given.withColumn("turn", turn).select(key, "cap", (F.col("first") + F.col("floor") + (F.col("turn") <= F.col("left")).cast("long")).alias("quota"))


def split_quotas(strata: DataFrame, key: str, size: int) -> DataFrame:
    """key, cap, quota of a test split of exactly ``size`` rows (or all there are): each stratum's share rounded down, but one
    at least; where that is too much, units go from the largest quotas, and where it is too little they come to the strata
    with the most rows left, the first key first. Strata with more keys than ``size`` are refused: see ``split_sample``.

    A unit is a row of one window: as many as the quotas have, and at most one for each pair of strata to be added."""
    known = strata.filter("cap > 0").select(key, F.col("cap").cast("long").alias("cap"))
    keys, rows = known.agg(F.count(F.lit(1)), F.sum("cap")).first()
    size = min(size, rows or 0)
    if keys > size:
        raise ValueError(f"{keys} strata do not fit into {size} rows")
    share = F.floor(F.col("cap").cast("decimal(19,0)") * F.lit(size) / F.lit(rows or 1)).cast("long")
    given = known.withColumn("quota", F.least(F.greatest(F.lit(1), share), F.col("cap")))
    surplus = (given.agg(F.sum("quota")).first()[0] or 0) - size
    if surplus > 0:
        units = given.filter("quota > 1").select(key, F.explode(F.sequence(F.lit(2).cast("long"), F.col("quota"))).alias("height"))
        ordered, sign = [F.desc("height"), key], -1
    else:
        need = F.least(F.col("cap") - F.col("quota"), F.lit(-surplus))
        units = given.withColumn("need", need).filter("need > 0").select(key, F.explode(F.sequence(F.col("cap") - F.col("quota") - F.col("need") + 1, F.col("cap") - F.col("quota"))).alias("height"))
        ordered, sign = [F.desc("height"), key], 1
    moved = units.withColumn("turn", F.row_number().over(Window.orderBy(*ordered))).filter(F.col("turn") <= abs(surplus))
    moved = moved.groupBy(key).agg(F.count(F.lit(1)).alias("moved"))
    return given.join(moved, key, "left").select(key, "cap", (F.col("quota") + sign * F.coalesce("moved", F.lit(0))).alias("quota"))


def split_sample(df: DataFrame, key: str, id_: str, size: int, seed: str) -> DataFrame:
    """``df`` with part, ``test`` or ``validation``: a test split of ``size`` rows, stratified by ``key`` where no more strata
    than rows are asked for, else the first rows in the order of a seeded digest of the id."""
    strata = df.groupBy(key).agg(F.count(F.lit(1)).alias("cap"))
    if strata.count() <= min(size, df.count()):
        chosen = stratified(df, key, id_, split_quotas(strata, key, size), seed).select(id_)
    else:
        chosen = df.select(id_).orderBy(F.md5(F.concat(F.lit(seed), F.col(id_).cast("string"))), id_).limit(size)
    return df.join(chosen.withColumn("part", F.lit("test")), id_, "left").withColumn("part", F.coalesce("part", F.lit("validation")))


def shift_report(left: DataFrame, right: DataFrame, keys: list[str], number: str) -> DataFrame:
    """attribute, kind and distance: the total variation of each of ``keys``, of each pair of them and of all together, and the
    gap between the medians of ``number``."""
    named = {k: F.col(k).cast("string") for k in keys}
    together = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]] + ([tuple(keys)] if len(keys) > 2 else [])
    for group in together:
        named["+".join(group)] = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in group]))
    wide = lambda d: d.select(*[c.alias(n) for n, c in named.items()])
    found = shifts(wide(left), wide(right), list(named)).select("attribute", F.lit("variation").alias("kind"), F.col("tvd").alias("distance"))
    middle = lambda d, name: d.agg(F.percentile(number, F.lit(0.5)).alias(name))  # noqa: E731  one row
    gap = middle(left, "a").crossJoin(F.broadcast(middle(right, "b")))
    return found.unionByName(gap.select(F.lit(number).alias("attribute"), F.lit("median_gap").alias("kind"), F.round(F.abs(F.col("a") - F.col("b")), 6).alias("distance")))
