"""Filtered vector top-k: a query set, in blocks, against all rows of a memory table.

Each task computes the distances of a batch to one block of queries as a matrix product and keeps the best k of each
query, so only partial results are shuffled; a window ranks them. Filters hold before the ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
DIVERSITY = ("none", "different_task_or_variation", "different_task", "same_task", "same_task_different_variation", "same_task_same_variation")


def _allowed(diversity: str, task: np.ndarray, variation: np.ndarray, q_task: np.ndarray, q_variation: np.ndarray) -> np.ndarray:
    same_task, same_variation = q_task[:, None] == task, q_variation[:, None] == variation
    return {
        "none": np.ones_like(same_task),
        "different_task_or_variation": ~(same_task & same_variation),
        "different_task": ~same_task,
        "same_task": same_task,
        "same_task_different_variation": same_task & ~same_variation,
        "same_task_same_variation": same_task & same_variation,
    }[diversity]


def _searcher(block, k: int, diversity: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_id, q_vec, q_task, q_var = block.value
        for batch in batches:
            ids, task, var = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            vectors = batch.column(3).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
            for a in range(0, len(ids), 4096):
                part = vectors[a : a + 4096]
                dist = np.sqrt(np.maximum(((q_vec[:, None, :] - part[None, :, :]) ** 2).sum(axis=2), 0)) if len(q_id) * part.size < 4e6 else np.stack([np.sqrt(((part - q) ** 2).sum(axis=1)) for q in q_vec])
                dist[~_allowed(diversity, task[a : a + 4096], var[a : a + 4096], q_task, q_var)] = np.inf
                order = np.lexsort((np.broadcast_to(ids[a : a + 4096], dist.shape), dist), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q_id)), order.shape[1])
                best = dist[row, order.ravel()]
                ok = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(q_id[row[ok]]), pa.array(ids[a : a + 4096][order.ravel()[ok]]), pa.array(best[ok])], ["query_id", "vec_id", "distance"])

    return search


def vector_topk(memory: DataFrame, queries: DataFrame, k: int = 10, diversity: str = "none") -> DataFrame:
    """query_id, vec_id, distance, rank; both tables have vec_id, task, variation, embedding. Ties rank by vec_id.

    Rows without a vector are not found and find nothing; of vectors of unlike lengths none is near another."""
    if diversity not in DIVERSITY:
        raise ValueError(f"unknown diversity strategy {diversity!r}")
    spark = memory.sparkSession
    # Vectors of unlike lengths have no distance: each length is searched for itself.
    sizes = sorted(r[0] for r in queries.filter("size(embedding) > 0").select(F.size("embedding")).distinct().collect())
    if len(sizes) > 1:
        found = [vector_topk(memory, queries.filter(F.size("embedding") == n), k, diversity) for n in sizes]
        return reduce(DataFrame.unionByName, found)
    memory = memory.filter(F.size("embedding") == (sizes[0] if sizes else -1))
    own = queries.select("vec_id", "task", "variation", "embedding").filter("size(embedding) > 0")
    blocks = max(1, -(-own.count() // BLOCK))
    found = None
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        block = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["task"] for r in rows]), np.array([r["variation"] for r in rows])))
        part = memory.filter("embedding is not null").select("vec_id", "task", "variation", "embedding").mapInArrow(_searcher(block, k, diversity), "query_id long, vec_id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def topk_stats(top: DataFrame) -> DataFrame:
    """Mean, population deviation and count of each query's distances."""
    return top.groupBy("query_id").agg(F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.stddev_pop("distance"), 6).alias("std_distance"), F.count(F.lit(1)).alias("n"))


def pick_rank(top: DataFrame, r: int) -> DataFrame:
    """The r-th row of each query, or the first where there are fewer."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return top.withColumn("n", n).filter(F.col("rank") == F.when(F.col("n") < r, 1).otherwise(r)).drop("n")
