"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios (NB-SVM).

Features are the distinct character n-grams (lengths ``GRAMS``) of a whole text with A-Z lower-cased, hashed to ``BUCKETS``. Each
feature's value is its log-count ratio between the classes, and a logistic loss with L2 weights them. The ratios, the
``FEATURES`` buckets that tell the classes apart best (by chi-square) and the weights come from at most about
``FIT_ROWS`` labelled rows, chosen by a hash of doc_id; the model therefore has a fixed size.

Defined results: a null or empty text gets the score of a text without features; without rows of both classes all
scores are 0; labels that are null or whose doc_id is null are not learned from; of several labels of a document the
largest holds; a null doc_id counts as not held out; repeated rows are scored alike; a long text is scored whole; an empty
table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.shared import discarded, texts_of, written

GRAMS = (4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
FEATURES = 2048
FIT_ROWS = 12_000
THRESHOLD = 0.7
ROUNDS = 150


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _present(data: np.ndarray, offsets: np.ndarray, index: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a chunk, sorted; features are buckets, or the places in ``index``."""
    data, found = textops.LOWER[data], []
    #: First bytes of characters, and one place more for the end.
    heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    for k in GRAMS:
        if len(heads) <= k:
            continue
        begin, end = heads[:-k], heads[k:]
        buckets = (textops.span_buckets(data, begin, end) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if index is not None:
            buckets = index[buckets]
            at = np.flatnonzero(buckets >= 0)
        else:
            at = np.arange(len(buckets))
        text = np.searchsorted(offsets, begin[at], side="right") - 1
        inside = end[at] <= offsets[text + 1]
        found.append(text[inside] * BUCKETS + buckets[at[inside]])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // BUCKETS, pairs % BUCKETS


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's (bucket, texts with it of class 1, of class 0)."""
    sums = np.zeros((2, BUCKETS), dtype=np.int32)
    for batch in textops.released(batches):
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in textops.chunks(batch.column(1)):
            text, bucket = _present(data, offsets, None)
            for k in (0, 1):
                sums[k] += np.bincount(bucket[label[a:b][text] == k], minlength=BUCKETS).astype(np.int32)
    some = np.flatnonzero(sums.any(axis=0))
    for i in range(0, len(some), 100_000):
        part = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[1, part].astype(np.int64)), pa.array(sums[0, part].astype(np.int64))], ["bucket", "p", "q"])


def _listed(index):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.released(batches):
            for a, b, data, offsets in textops.chunks(batch.column(1)):
                text, feature = _present(data, offsets, index.value)
                at = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))], ["label", "features"])

    return listed


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """The model, learned from the labelled rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    usable = marks.filter(~held_out())
    n = docs.select("doc_id").join(usable, "doc_id").count()
    # By doc_id and text, each such row once: rows with a repeated id do not come all at once.
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) * F.lit(n) < F.lit(rows * (1 << 30))
    chosen = texts_of(docs).select("doc_id", "text").filter(share).join(usable, "doc_id").dropDuplicates(["doc_id", "text"])
    sample = written(chosen.select("label", "text").repartition(spark.sparkContext.defaultParallelism * 2), "toxicity-sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        discarded(sample)
        return None
    P, Q = totals[1], totals[0]
    tally = sample.mapInArrow(_tallied, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = F.col("p"), F.col("q")
    gap = p * Q - q * P
    best = tally.filter("p + q >= 3").select("bucket", "p", "q", (gap * gap * 1.0 / ((p + q) * (F.lit(P + Q) - p - q + 1))).alias("chi")).orderBy(F.desc("chi"), "bucket").limit(FEATURES).toPandas()
    ratio = np.log((best["p"].to_numpy() + 1) / (P + 2)) - np.log((best["q"].to_numpy() + 1) / (Q + 2))
    index = np.full(BUCKETS, -1, dtype=np.int64)
    index[best["bucket"].to_numpy()] = np.arange(len(best))
    seen = sample.mapInArrow(_listed(spark.sparkContext.broadcast(index.astype(np.int16))), "label int, features array<int>").toArrow()
    discarded(sample)
    y = seen.column("label").to_numpy().astype(float)
    lists = seen.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    length, feature = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), length)
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum()))) / len(y)
    value = ratio[feature]
    w, b, m, v = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, w[feature] * value, minlength=len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(feature, err[row] * value, minlength=len(ratio)) + 1e-5 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {"index": index.astype(np.int16), "weight": w * ratio, "bias": float(b)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        index = None if frozen is None else frozen["index"].astype(np.int64)
        for batch in textops.released(batches):
            for a, b, data, offsets in textops.chunks(batch.column(1)):
                out = np.zeros(b - a)
                if frozen is not None:
                    text, feature = _present(data, offsets, index)
                    z = np.bincount(text, frozen["weight"][feature], minlength=b - a) + frozen["bias"]
                    out = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts_of(docs.select("doc_id", "text")).mapInArrow(scored, "doc_id long, score double, predicted int")
