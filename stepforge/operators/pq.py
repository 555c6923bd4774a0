"""Product-quantised vector index, kept in a folder.

A vector is kept whole and as a code: its cell, the nearest of at most ``CELLS`` centroids, and for each of ``PARTS`` equal
parts the number of the nearest of ``WORDS`` codewords of that part. The table is partitioned by cell, with codes and vectors
in columns of their own. A search reads the codes alone, of the cells that its queries probe; distances come from a table of
each query's parts against all codewords, so a row costs ``PARTS`` lookups. The ``SHORTLIST`` best of each query are then
measured on their whole vectors, which only they are read for.

Centroids and codewords are fitted on at most ``SAMPLE_ROWS`` rows chosen by hash; every row is indexed. Queries are a stated
set and come in blocks of ``BLOCK``, whose tables are broadcast (16 KB a query with the defaults).

Defined results: rows without a vector are not indexed, nor found; a table of vectors of unlike lengths is refused; equal
distances rank by vec_id; an index of no rows finds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions.similarity import l2

CELLS, PARTS, WORDS = 256, 16, 256
#: Cells probed of those there are, and the rows of a query that are measured exactly, a wanted row.
PROBED, SHORTLIST = 0.6, 10
SAMPLE_ROWS, ROUNDS, SEED = 20_000, 10, 5
BLOCK = 1024


@dataclass(frozen=True)
class Codebook:
    """Centroids of the cells, and codewords (parts, words, dimensions of a part)."""

    centroids: np.ndarray
    words: np.ndarray

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.reshape(len(vectors), len(self.words), -1)

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the codewords of each vector."""
        return _nearest(vectors, self.centroids), np.stack([_nearest(p, w) for p, w in zip(self.parts(vectors).swapaxes(0, 1), self.words)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of each query's parts from all codewords: (queries, parts, words)."""
        return np.stack([_squares(p, w) for p, w in zip(self.parts(queries).swapaxes(0, 1), self.words)], axis=1)

    def probed(self, queries: np.ndarray, share: float) -> np.ndarray:
        """Which cells each query probes: its nearest."""
        many = min(len(self.centroids), max(1, round(share * len(self.centroids))))
        out = np.zeros((len(queries), len(self.centroids)), dtype=bool)
        np.put_along_axis(out, _squares(queries, self.centroids).argsort(axis=1, kind="stable")[:, :many], True, axis=1)
        return out


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.maximum((left**2).sum(axis=1)[:, None] - 2 * left @ right.T + (right**2).sum(axis=1), 0)


def _nearest(vectors: np.ndarray, centres: np.ndarray, step: int = 8192) -> np.ndarray:
    return np.concatenate([_squares(vectors[a : a + step], centres).argmin(axis=1) for a in range(0, len(vectors), step)]) if len(vectors) else np.zeros(0, np.int64)


def _means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` means of the rows, from distinct rows; those that lose all rows stay where they were."""
    rows = np.unique(rows, axis=0)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(ROUNDS if len(rows) > k else 0):
        at = _nearest(rows, centres)
        held = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, column, minlength=len(centres)) for column in rows.T], axis=1)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def _vectors(memory: DataFrame) -> DataFrame:
    return memory.filter("embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))


def fit(memory: DataFrame, cells: int = CELLS, parts: int = PARTS, words: int = WORDS, sample_rows: int = SAMPLE_ROWS) -> Codebook | None:
    """The codebook of a table's vectors; None if it has none. Parts are the most up to ``parts`` that divide the length."""
    rows = _vectors(memory)
    total, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not total:
        return None
    if low != high:
        raise ValueError(f"vectors of {low} to {high} numbers cannot share an index")
    share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) * F.lit(total) < F.lit(sample_rows * (1 << 30))
    sample = np.array([r["embedding"] for r in rows.filter(share).dropDuplicates(["vec_id", "embedding"]).orderBy("vec_id", "embedding").select("embedding").collect()], dtype=np.float64)
    many = next(p for p in range(min(parts, low), 0, -1) if low % p == 0)
    split = sample.reshape(len(sample), many, -1)
    books = [_means(split[:, i], words, SEED + i) for i in range(many)]
    size = max(map(len, books))
    # A part with fewer distinct values repeats its first codeword, which ties give way to.
    return Codebook(_means(sample, cells, SEED), np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), axis=0)]) for b in books]))


def build(memory: DataFrame, codebook: Codebook | None, path: str) -> None:
    """Writes the index of ``memory`` (vec_id, embedding) to a new folder: the codebook and the rows, partitioned by cell."""
    spark = memory.sparkSession
    shared = spark.sparkContext.broadcast(codebook)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = shared.value.codes(batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)], ["cell", "vec_id", "code", "embedding"])

    rows = _vectors(memory)
    if codebook is None:
        rows = rows.limit(0)
    rows = rows.mapInArrow(coded, "cell int, vec_id long, code binary, embedding array<float>")
    # A large cell is written by several tasks.
    rows.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
    plain = None if codebook is None else {"centroids": codebook.centroids.tolist(), "words": codebook.words.tolist()}
    spark.createDataFrame([(json.dumps(plain),)], "codebook string").coalesce(1).write.parquet(f"{path}/codebook")


@dataclass(frozen=True)
class Index:
    codebook: Codebook | None
    rows: DataFrame


def opened(spark: SparkSession, path: str) -> Index:
    """The index kept in a folder."""
    plain = json.loads(spark.read.parquet(f"{path}/codebook").first()["codebook"])
    rows = spark.read.schema("vec_id long, code binary, embedding array<float>, cell int").parquet(f"{path}/rows")
    return Index(None if plain is None else Codebook(np.array(plain["centroids"]), np.array(plain["words"])), rows)


def _shortlister(block, most: int):
    def shortlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, tables, probed = block.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for q in range(len(query)):
                rows = np.flatnonzero(probed[q, cells])
                far = sum(tables[q, p, code[rows, p]] for p in range(code.shape[1]))
                best = np.lexsort((ids[rows], far))[:most] if len(rows) else rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query[q])), pa.array(ids[rows[best]]), pa.array(cells[rows[best]]), pa.array(np.asarray(far)[best] if len(rows) else [], pa.float64())], ["query_id", "vec_id", "cell", "far"])

    return shortlist


def search(index: Index, queries: DataFrame, k: int = 10, probed: float = PROBED, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, vec_id, distance and rank: the nearest ``k`` of each query's shortlist of ``k * shortlist`` rows."""
    spark, own = queries.sparkSession, _vectors(queries)
    blocks = max(1, -(-own.count() // BLOCK))
    found = spark.createDataFrame([], "query_id long, vec_id long, cell int, far double")
    for b in range(blocks if index.codebook is not None else 0):
        rows = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        vectors = np.array([r["embedding"] for r in rows], dtype=np.float64)
        near = index.codebook.probed(vectors, probed)
        block = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], dtype=np.int64), index.codebook.tables(vectors), near))
        codes = index.rows.filter(F.col("cell").isin(np.flatnonzero(near.any(axis=0)).tolist())).select("vec_id", "cell", "code")
        found = found.unionByName(codes.mapInArrow(_shortlister(block, k * shortlist), found.schema))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "vec_id"))
    short = found.withColumn("place", place).filter(F.col("place") <= k * shortlist).select("query_id", "vec_id", "cell")
    asked = own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    exact = short.join(index.rows.select("vec_id", "cell", "embedding"), ["cell", "vec_id"]).join(asked, "query_id")
    exact = exact.select("query_id", "vec_id", l2(F.col("asked"), F.col("embedding")).alias("distance")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k)
