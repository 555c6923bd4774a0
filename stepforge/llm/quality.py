"""Quality by a weak-label model.

Overlapping heuristics vote good (1), bad (0) or abstain (-1) on every text. Expectation-maximisation over the counts of
vote patterns estimates each heuristic's accuracy for good and bad texts and the share of good ones, without any true
label; the posterior of a pattern is the weak label of its texts. A linear scorer over hashed n-grams of character
classes is then trained on the posteriors of a sample of about ``FIT_ROWS`` texts (chosen by a hash of doc_id and text, each
such row once), and scores every whole text. At most ``3 ** heuristics`` patterns reach the driver, whatever the input.

Defined results: a null text counts as empty; texts without words get the pattern's posterior and the scorer's bias;
an empty table gives an empty result; repeated rows are scored alike; a null doc_id keeps its row; a long text is judged
whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.shared import texts_of

NAMES = ("case", "symbols", "tables", "word_length", "variety", "length", "lines", "sentences", "digits", "runs", "stutter")
BUCKETS = 1 << 14
FIT_ROWS = 8_000
ROUNDS = 120
KEEP = 0.3

#: Character classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 sentence end, 6 comma, 7 bar, 8 other ASCII, 9 not ASCII.
_CLASS = np.full(256, 8, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 9
_CLASS[[32, 9]], _CLASS[10], _CLASS[[46, 33, 63]], _CLASS[44], _CLASS[124] = 3, 4, 5, 6, 7


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 1, -1))


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One column for each of ``NAMES``."""
    n = len(offsets) - 1
    kinds = _CLASS[data]
    text = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(text * 10 + kinds, minlength=10 * n).reshape(n, 10).astype(float)
    size = np.maximum(count.sum(axis=1), 1)
    low = textops.LOWER[data]
    starts, ends, first = textops.words(low, offsets)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    hashes = textops.span_hashes(low, starts, ends)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], dtype=float)
    breaks = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(kinds == 4) + 1]))
    breaks = breaks[breaks < len(data)].astype(np.int64)
    of_line = np.searchsorted(offsets, breaks, side="right") - 1
    line_ends = np.minimum(np.append(breaks[1:], len(data)), offsets[of_line + 1]) if len(breaks) else breaks
    lines = textops.span_hashes(data, breaks, line_ends) if len(breaks) else np.zeros(0, np.uint64)
    of_text = np.searchsorted(of_line, np.arange(n + 1))
    unique = np.array([len(np.unique(lines[a:b])) for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist())], dtype=float)
    total = np.maximum(np.diff(of_text), 1)
    letters = np.maximum(count[:, 0] + count[:, 1], 1)
    upper, symbols, bars = count[:, 1] / letters, (count[:, 5] + count[:, 7] + count[:, 8]) / size, count[:, 7] / some
    length, variety, again = np.bincount(np.searchsorted(first, np.arange(len(starts)), side="right") - 1, ends - starts, minlength=n) / some, distinct / some, 1 - unique / total
    stops = count[:, 5] / some
    digits = count[:, 2] / size
    same = (data[2:] == data[:-2]) & (data[1:-1] == data[:-2]) & (kinds[2:] >= 5) & (kinds[2:] <= 8) if len(data) > 2 else np.zeros(0, bool)
    runs = np.bincount(text[np.flatnonzero(same)], minlength=n) / some
    of_word = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    echo = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    stutter = np.bincount(of_word[np.flatnonzero(echo)], minlength=n) / some
    out = [
        _vote(upper, upper < 0.2, upper > 0.5),
        _vote(symbols, symbols < 0.06, symbols > 0.1),
        _vote(bars, bars < 0.02, bars > 0.2),
        _vote(length, (length > 3) & (length < 9), (length < 2) | (length > 14)),
        _vote(variety, (variety > 0.4) & (words >= 10), (variety < 0.25) & (words >= 40)),
        _vote(words, words >= 20, words < 4),
        _vote(again, (again < 0.1) & (words >= 10), again > 0.35),
        _vote(stops, (stops > 0.015) & (stops < 0.4), (stops > 0.6) | (stops < 0.004) & (words > 80)),
        _vote(digits, digits < 0.05, digits > 0.2),
        _vote(runs, runs < 0.01, runs > 0.1),
        _vote(stutter, stutter < 0.02, stutter > 0.1),
    ]
    return np.stack(out, axis=1).astype(np.int64)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = 3 ** np.arange(len(NAMES))
    for batch in textops.released(batches):
        for a, b, data, offsets in textops.chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(((votes(data, offsets) + 1) * places).sum(axis=1))], ["doc_id", "pattern"])


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1): P(vote good | bad, good text) of each labeller, and each pattern's P(good)."""
    cast, good = patterns >= 0, patterns == 1
    #: The start believes every complaint, as a bad vote is meant to be rare among good texts; the rounds weigh it.
    post, weight = np.where((patterns == 0).any(axis=1), 0.2, 0.95), counts[:, None]
    rates = np.zeros((2, patterns.shape[1]))
    for _ in range(rounds):
        prior = np.clip((post * counts).sum() / max(1, counts.sum()), 0.01, 0.99)
        for c, p in ((1, post), (0, 1 - post)):
            rates[c] = ((p[:, None] * weight * good).sum(axis=0) + 1.8 * c + 0.2) / ((p[:, None] * weight * cast).sum(axis=0) + 2.2)
        logit = np.log(prior / (1 - prior)) + (cast * np.where(good, np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0])))).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return rates, post


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of hashed 3- and 5-grams of character classes, values of unit length in each text."""
    kinds, n, keys = _CLASS[data].astype(np.int64), len(offsets) - 1, []
    for k in (3, 5):
        if len(data) < k:
            continue
        code = np.zeros(len(kinds) - k + 1, dtype=np.int64)
        for i in range(k):
            code = code * 10 + kinds[i : len(kinds) - k + 1 + i]
        at = np.arange(len(code))
        text = np.repeat(np.arange(n), np.diff(offsets))[at]
        inside = at + k <= offsets[text + 1]
        keys.append(text[inside] * BUCKETS + ((code[inside] + 100_003 * k) * 2654435761 >> 7) % BUCKETS)
    pairs, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0))
    text, value = pairs // BUCKETS, np.sqrt(count)
    return text, pairs % BUCKETS, value / np.sqrt(np.maximum(np.bincount(text, value * value, minlength=n), 1e-9))[text]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.released(batches):
        for a, b, data, offsets in textops.chunks(batch.column(1)):
            text, bucket, value = _features(data, offsets)
            at = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))], ["pattern", "bucket", "value"])


def _learned(y: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing alike."""
    w, b, m, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    weight = (y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)) / 2
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, w[bucket] * value, minlength=len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(bucket, err[row] * value, minlength=BUCKETS) + 1e-6 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def assess(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, pattern, weak_label (the pattern's posterior), score (the scorer's), kept (score >= KEEP) of every row."""
    spark = docs.sparkSession
    texts = texts_of(docs.select("doc_id", "text"))
    counted = texts.mapInArrow(_voted, "doc_id long, pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()
    codes, counts = counted["pattern"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=float)
    patterns = codes[:, None] // 3 ** np.arange(len(NAMES)) % 3 - 1
    _, post = accuracies(patterns, counts)
    table = np.full(3 ** len(NAMES), 0.5)
    table[codes] = post
    # By doc_id and text, each such row once: rows with a null or repeated id do not come all at once.
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) * F.lit(int(counts.sum())) < F.lit(rows * (1 << 30))
    places = 3 ** np.arange(len(NAMES))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.released(batches):
            for a, b, data, offsets in textops.chunks(batch.column(1)):
                pattern = pa.array(((votes(data, offsets) + 1) * places).sum(axis=1))
                yield from _listed(iter([pa.RecordBatch.from_arrays([pattern, batch.column(1).slice(a, b - a)], ["pattern", "text"])]))

    seen = texts.filter(share).dropDuplicates(["doc_id", "text"]).mapInArrow(sampled, "pattern long, bucket array<int>, value array<float>").toArrow().combine_chunks()
    if seen.num_rows:
        column = lambda name: pa.concat_arrays(seen.column(name).chunks)
        row = np.repeat(np.arange(seen.num_rows), np.diff(column("bucket").offsets.to_numpy()))
        model = _learned(table[seen.column("pattern").to_numpy()], row, column("bucket").flatten().to_numpy(), column("value").flatten().to_numpy())
    else:
        model = np.zeros(BUCKETS), 0.0
    shared = spark.sparkContext.broadcast((model, table))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), labels = shared.value
        for batch in textops.released(batches):
            for a, b, data, offsets in textops.chunks(batch.column(1)):
                pattern = ((votes(data, offsets) + 1) * places).sum(axis=1)
                text, bucket, value = _features(data, offsets)
                z = np.bincount(text, weights[bucket] * value, minlength=b - a) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pattern), pa.array(labels[pattern]), pa.array(score), pa.array(score >= KEEP)], ["doc_id", "pattern", "weak_label", "score", "kept"])

    return texts.mapInArrow(scored, "doc_id long, pattern long, weak_label double, score double, kept boolean")
