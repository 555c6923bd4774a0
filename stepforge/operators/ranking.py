"""Weighted text search, rank fusion, all-pair points and within-query normalisation.

A search sets a stated query set, in blocks of at most about ``BLOCK`` queries and ``UNITS`` units (terms, tokens or bigrams)
of them, against all documents. What is broadcast is a block's postings: the queries and weights of each unit. A task adds
up, for its documents, the postings of the units they hold, and keeps the best k of each query, so that neither documents nor
pairs are shuffled, however common a term is, and memory does not grow with the vocabulary; a window ranks the kept rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from stepforge.functions import text as tx

BLOCK, UNITS = 1024, 500_000
#: Postings that a task adds up at once (those of one document at least), and cells of documents and queries.
CELLS = 2_000_000
#: Terms of a corpus whose weights may be sent to all tasks: about 40 MB; beyond, they are joined.
TERMS = 1_000_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))


def document_frequency(docs: DataFrame, max_share: float | None = None, n: int = 0, column: str = "text") -> DataFrame:
    """term, df: in how many documents each term stands; each task adds up its own first."""
    df = docs.select(F.explode(F.array_distinct(terms(F.col(column)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df if max_share is None else df.filter(F.col("df") <= max_share * n)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


#: What a (document, unit) adds, from its count and the document's size; and the values of the sums of (document, query)
#: pairs, from the sums, the documents' facts and sizes, and the queries' own numbers.
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def _cells(lists: pa.Array, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, unit and count of the known units of some documents, by document."""
    found = pc.index_in(lists.flatten(), value_set=units).fill_null(-1).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    cells, counts = np.unique(owner[found >= 0] * len(units) + found[found >= 0], return_counts=True)
    return cells // max(1, len(units)), cells % max(1, len(units)), counts.astype(np.float64)


def _searcher(shared, k: int, part: Part, finish: Finish):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, first, query, weight, own = shared.value
        units = pa.array(units, pa.string())
        many, width = np.diff(first), len(ids)
        for batch in batches:
            size, fact = np.diff(batch.column(1).offsets.to_numpy()).astype(np.float64), batch.column(2).to_numpy(zero_copy_only=False)
            doc, unit, count = _cells(batch.column(1), units)
            value = part(count, size[doc])
            work, begin = np.cumsum(many[unit]), np.searchsorted(doc, np.arange(batch.num_rows + 1))
            upto, a = np.append(0, work)[begin], 0
            while a < batch.num_rows:
                b = max(a + 1, min(int(np.searchsorted(upto, upto[a] + CELLS, side="right")) - 1, a + max(1, CELLS // width)))
                rows = slice(begin[a], begin[b])
                each = many[unit[rows]]
                posting = np.arange(int(each.sum())) + np.repeat(first[unit[rows]] - np.cumsum(each) + each, each)
                cell = np.repeat((doc[rows] - a) * width, each) + query[posting]
                hits = np.bincount(cell, minlength=(b - a) * width)
                met = np.flatnonzero(hits)
                sums = np.bincount(cell, np.repeat(value[rows], each) * weight[posting], minlength=(b - a) * width)[met]
                row, column = met // width + a, met % width
                values = finish(sums, fact[row], size[row], own[column])
                if b - a > k:
                    # Only those that are among a query's best k here, ties too.
                    order = np.lexsort((-values[0], column))
                    turn = np.arange(len(order)) - np.searchsorted(column[order], column[order])
                    worst = np.full(width, -np.inf)
                    last = order[turn == k - 1]
                    worst[column[last]] = values[0][last]
                    keep = values[0] >= worst[column]
                    row, column, values = row[keep], column[keep], tuple(v[keep] for v in values)
                yield pa.RecordBatch.from_arrays([pa.array(ids[column]), batch.column(0).take(pa.array(row)), *[pa.array(v) for v in values]], [f"c{i}" for i in range(2 + len(values))])
                a = b

    return search


def _search(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k: int, part: Part, finish: Finish, names: list[str], weigh: Callable) -> DataFrame:
    """query_key, doc_key, ``names`` (the first ranks, ties by doc_key) and rank, of pairs that share a held unit.

    docs: doc_key, units (array), fact (double); queries: query_key, units. ``weigh`` gives, of a block's units and the
    (unit, query, count) of its queries, their weights (nan where not held) and a number of each query."""
    spark = docs.sparkSession
    own = queries.select(query_key, "units").filter(F.size("units") > 0)
    n, total = own.agg(F.count(F.lit(1)), F.sum(F.size("units"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(total or 0) // UNITS))
    schema = f"{query_key} long, {doc_key} long, " + ", ".join(f"{name} double" for name in names)
    found = None
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        units = sorted({u for r in rows for u in r["units"]})
        place = {u: i for i, u in enumerate(units)}
        held = [(place[u], j, c) for j, r in enumerate(rows) for u, c in Counter(r["units"]).items()]
        unit, query, count = (np.array(x) for x in zip(*sorted(held)))
        weight, numbers = weigh(units, unit, query, count.astype(np.float64), len(rows))
        ok = ~np.isnan(weight)
        first = np.searchsorted(unit[ok], np.arange(len(units) + 1))
        shared = spark.sparkContext.broadcast((np.array([r[query_key] for r in rows], dtype=np.int64), units, first, query[ok], weight[ok], numbers))
        hits = docs.select(F.col(doc_key).cast("long"), "units", F.col("fact").cast("double")).mapInArrow(_searcher(shared, k, part, finish), schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    return topk(found, query_key, [F.desc(names[0]), doc_key], k)


def _weights(df: DataFrame, units: list[str], weight: Column) -> np.ndarray:
    """The weight of each unit, nan where ``df`` has none."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(u,) for u in units], "term string")
    found = {r["term"]: r["w"] for r in df.join(F.broadcast(wanted), "term").select("term", weight.alias("w")).collect()}
    return np.array([found.get(u, np.nan) for u in units])


def tfidf_topk(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k: int) -> DataFrame:
    """Cosine of smoothed TF-IDF vectors (idf = ln((1 + n) / (1 + df)) + 1, terms in more than 95 % of documents left out)."""
    n = docs.count()
    weight = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1
    df = document_frequency(docs, 0.95, n).persist()
    size = df.count()
    own = docs.select(F.col(doc_key).cast("long").alias(doc_key), terms(F.col("text")).alias("units"))
    if size <= TERMS:
        table = df.select("term", weight.alias("w")).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), table.column("w").to_numpy()))

        def normed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, idf = shared.value
            for batch in batches:
                lists = batch.column(1)
                found = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[found >= 0]
                cells, tf = np.unique(owner * max(1, len(idf)) + found[found >= 0], return_counts=True)
                squares = (tf * idf[cells % max(1, len(idf))]) ** 2 if len(cells) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.sqrt(np.bincount(cells // max(1, len(idf)), squares, minlength=len(lists))))], [doc_key, "units", "fact"])

        own = own.mapInArrow(normed, f"{doc_key} long, units array<string>, fact double")
    else:
        tf = own.select(doc_key, F.explode("units").alias("term")).groupBy(doc_key, "term").agg(F.count(F.lit(1)).alias("tf"))
        norms = tf.join(df.hint("merge"), "term").groupBy(doc_key).agg(F.sqrt(F.sum((F.col("tf") * weight) ** 2)).alias("fact"))
        own = own.join(norms, doc_key)

    def finish(sums, norm, _, __):
        return (_rounded(sums / np.maximum(norm, 1e-300)),)

    def weigh(units, unit, query, count, many):
        idf = _weights(df, units, weight)[unit]
        norm = np.sqrt(np.bincount(query, np.nan_to_num(count * idf) ** 2, minlength=many))
        return count * idf * idf / np.maximum(norm, 1e-300)[query], np.zeros(many)

    out = _search(own, queries.select(query_key, terms(F.col("text")).alias("units")), doc_key, query_key, k, lambda count, _: count, finish, ["score"], weigh)
    df.unpersist()
    return out.select(query_key, doc_key, "score", "rank")


def bm25_topk(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25; a negative idf is raised to epsilon times the mean idf. Every query term counts as often as it occurs."""
    own = docs.select(doc_key, terms(F.col("text")).alias("units"), F.lit(0.0).alias("fact"))
    n, total = own.agg(F.count(F.lit(1)), F.sum(F.size("units"))).first()
    mean = (total or 0) / n if n and total else 1.0
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = document_frequency(docs).persist()
    floor = epsilon * (df.agg(F.avg(raw)).first()[0] or 0.0)

    def part(count, size):
        return count * (k1 + 1) / (count + k1 * (1 - b + b * size / mean))

    def weigh(units, unit, query, count, many):
        return count * _weights(df, units, F.when(raw < 0, F.lit(floor)).otherwise(raw))[unit], np.zeros(many)

    out = _search(own, queries.select(query_key, terms(F.col("text")).alias("units")), doc_key, query_key, k, part, lambda sums, *_: (_rounded(sums),), ["score"], weigh)
    df.unpersist()
    return out.select(query_key, doc_key, "score", "rank")


def topk(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def token_overlap(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, bigrams: bool, k: int) -> DataFrame:
    """query_key, doc_key, jaccard, overlap (the share of the query found) and rank, over distinct tokens or bigrams."""
    unit = (lambda c: F.array_distinct(tx.bigrams(tx.tokens(c)))) if bigrams else (lambda c: F.array_distinct(tx.tokens(c)))

    def finish(both, _, size, of_query):
        return _rounded(both / np.maximum(of_query + size - both, 1)), _rounded(both / np.maximum(of_query, 1))

    own = docs.select(doc_key, unit(F.col("text")).alias("units"), F.lit(0.0).alias("fact"))
    return _search(own, queries.select(query_key, unit(F.col("text")).alias("units")), doc_key, query_key, k, lambda count, _: count, finish, ["jaccard", "overlap"], lambda units, unit, query, count, many: (count, np.bincount(query, minlength=many).astype(float)))


def merged(head: DataFrame, tail: DataFrame, group: str, key: str) -> DataFrame:
    """Ordered union: ``head`` before ``tail`` (both with rank), keys first seen stay."""
    both = head.select(group, key, F.lit(0).alias("part"), "rank").unionByName(tail.select(group, key, F.lit(1).alias("part"), "rank"))
    first = both.groupBy(group, key).agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("at.part", "at.rank", key)).alias("rank"))


def reranked(candidates: DataFrame, group: str, score: Column, prefix: int, missing: str, top_k: int) -> DataFrame:
    """The first ``prefix`` rows by score (missing scores by policy), the others after them in their order."""
    fill = {"min": F.lit(-1e9), "zero": F.lit(0.0), "baseline": (F.lit(top_k + 1) - F.col("rank")).cast("double")}[missing]
    head = F.col("rank") <= prefix
    value = F.when(head, F.coalesce(score, fill))
    order = Window.partitionBy(group).orderBy(F.when(head, 0).otherwise(1), value.desc_nulls_last(), "rank")
    return candidates.withColumn("final_rank", F.row_number().over(order))


def all_pair_points(candidates: DataFrame, group: str, key: str, better: Column, tied: Column) -> DataFrame:
    """Points of every candidate over all pairs of a bounded candidate list: win 1, tie one half.

    ``better`` and ``tied`` compare columns l.* with r.*.
    """
    l, r = candidates.alias("l"), candidates.alias("r")
    pairs = l.join(r, (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col(f"l.{key}") != F.col(f"r.{key}")))
    return pairs.groupBy(F.col(f"l.{group}").alias(group), F.col(f"l.{key}").alias(key)).agg(F.sum(F.when(tied, 0.5).when(better, 1.0).otherwise(0.0)).alias("points"), (F.count(F.lit(1)) + 1).alias("n"))


def comparison_topk(candidates: DataFrame, group: str, key: str, better: Column, k: int) -> DataFrame:
    """``candidates`` (with rank) with final_rank: the k that fewest others are better than, by their retrieved rank where as
    many are, and then the rest as retrieved.

    ``better`` compares columns l.* with r.* of a bounded list. For an order without contradictions this is what sorts that
    ask for one comparison at a time end with; equal candidates keep their retrieved order."""
    l, r = candidates.alias("l"), candidates.alias("r")
    beaten = l.join(r, (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col(f"l.{key}") != F.col(f"r.{key}")) & better)
    beaten = beaten.groupBy(F.col(f"r.{group}").alias(group), F.col(f"r.{key}").alias(key)).agg(F.count(F.lit(1)).alias("over"))
    placed = candidates.join(beaten, [group, key], "left").withColumn("over", F.coalesce("over", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("over", "rank"))
    placed = placed.withColumn("place", place)
    order = Window.partitionBy(group).orderBy(F.when(F.col("place") <= k, F.col("place")).otherwise(k + F.col("rank")))
    return placed.withColumn("final_rank", F.row_number().over(order)).drop("over", "place")


def win_rates(points: DataFrame, group: str, key: str) -> DataFrame:
    w = Window.partitionBy(group)
    raw = F.when(F.col("n") <= 1, 0.5).otherwise(F.col("points") / (F.col("n") - 1))
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    out = points.withColumn("raw", raw).withColumn("scaled", F.when(high == low, 0.5).otherwise((F.col("raw") - low) / (high - low)))
    out = out.withColumn("llm_rank", F.row_number().over(w.orderBy(F.desc("points"), key)))
    return out.select(group, key, "points", F.round("raw", 6).alias("raw"), F.round("scaled", 6).alias("scaled"), "llm_rank", F.round(1 / F.col("llm_rank"), 6).alias("reciprocal"))


def zscores(df: DataFrame, group: str, column: str) -> Column:
    w = Window.partitionBy(group)
    return (F.col(column) - F.avg(column).over(w)) / F.coalesce(F.nullif(F.stddev_pop(column).over(w), F.lit(0.0)), F.lit(1.0))


def pass_order(size: int, wins: set[tuple[int, int]], k: int) -> list[int]:
    """The order that ``k`` passes of exchanges from the end of a list leave it in, by answers that may contradict each other.

    wins: (a, b) where a is better than b, by their places at first. Pass i exchanges neighbours down to place i; it begins one
    behind the place where the pass before made its first exchange, since nothing further down has moved. A pass without an
    exchange is the last."""
    order, begin = list(range(size)), size - 1
    for i in range(min(k, size)):
        first = None
        for at in range(begin, i, -1):
            if (order[at], order[at - 1]) in wins:
                order[at - 1], order[at] = order[at], order[at - 1]
                first = first or at
        if first is None:
            break
        begin = min(first + 1, size - 1)
    return order


@F.pandas_udf(ArrayType(IntegerType()))
def _passed(sizes: pd.Series, wins: pd.Series, ks: pd.Series) -> pd.Series:
    return pd.Series([pass_order(int(n), {(w["a"], w["b"]) for w in won}, int(k)) for n, won, k in zip(sizes, wins, ks)])


def pass_sorted(candidates: DataFrame, group: str, key: str, better: Column, k: int) -> DataFrame:
    """``candidates`` (with rank) with final_rank: sorted by ``k`` passes of exchanges (``pass_order``).

    ``better`` compares columns l.* with r.* of a bounded list, each ordered pair once."""
    own = Window.partitionBy(group).orderBy("rank", key)
    placed = candidates.withColumn("place_", (F.row_number().over(own) - 1).cast("int"))
    l, r = placed.alias("l"), placed.alias("r")
    won = l.join(r, (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l.place_") != F.col("r.place_")) & better)
    won = won.groupBy(F.col(f"l.{group}").alias(group)).agg(F.collect_list(F.struct(F.col("l.place_").alias("a"), F.col("r.place_").alias("b"))).alias("won"))
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("n"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    orders = sizes.join(won, group, "left").select(group, _passed(F.col("n"), F.coalesce("won", none), F.lit(k)).alias("order"))
    orders = orders.select(group, F.posexplode("order").alias("at", "place_"))
    return placed.join(orders, [group, "place_"]).withColumn("final_rank", (F.col("at") + 1).cast("int")).drop("place_", "at")
