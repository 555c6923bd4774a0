"""Benchmark decontamination with SimHash windows.

An item is the weighted set (multiplicities) of its 5-word shingles. In every document, windows of the item's number of
words are fingerprinted by 64-bit SimHash; a multi-index over ``BLOCKS`` blocks of 8 bits returns every item whose
fingerprint differs in at most ``RADIUS`` bits (by pigeonhole some block then differs in at most RADIUS // BLOCKS bits,
and all such block values are indexed), and the weighted Jaccard similarity of the shingles confirms each candidate.

Windows are laid only where they can reach the similarity: a window that holds fewer than ``similarity`` times the
item's shingles cannot, and this count follows from the positions of the item's shingles in the document alone. What is
skipped this way is lossless, and the work follows the number of such positions, not documents times items.

The multi-index finds every item within the radius, without a miss; a window that is as similar as asked but has a
fingerprint farther off would be dropped. ``RADIUS`` is set so wide that this does not happen: of windows at the threshold,
fingerprints differ in about 13 of 64 bits (tests count them, and compare all windows by brute force).

The items are a stated query set: they are read in blocks of at most ``ITEM_WORDS`` words (one scan of the documents a
block), so what is sent to the tasks has a fixed bound.

Defined results: null or empty texts and items match nothing; an item of fewer than five words is one shingle and
matches where its words stand in a row; a document shorter than an item is one window; null ids stay null; repeated
rows are matched alike; a long text is searched whole; an empty table on either side gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.shared import texts_of

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, RADIUS = 8, 23
ITEM_WORDS = 2_000_000
_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.array([[(a ^ b).bit_count() <= RADIUS // BLOCKS for b in range(256)] for a in range(256)])


def _signs(hashes: np.ndarray) -> np.ndarray:
    return ((textops.mixed(hashes)[:, None] >> _BITS & np.uint64(1)).astype(np.int32) << 1) - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=-1, dtype=np.uint64)


class Items:
    """The index of one block of items: shingles with their items, fingerprints, and the multi-index of each size."""

    def __init__(self, ids: list, texts: list[str | None]):
        data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
        lengths = [len((t or "").encode()) for t in texts]
        data, offsets = textops.LOWER[data], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        starts, ends, first = textops.words(data, offsets)
        hashes = textops.span_hashes(data, starts, ends)
        self.ids, self.size, self.grams, self.width = ids, np.diff(first), [], np.minimum(np.diff(first), SHINGLE)
        for a, b, k in zip(first[:-1].tolist(), first[1:].tolist(), self.width.tolist()):
            self.grams.append(np.unique(textops.rolled(hashes[a:b], k), return_counts=True) if k else (np.zeros(0, np.uint64), np.zeros(0, int)))
        prints = [_fingerprint((_signs(g) * n[:, None]).sum(axis=0)) if len(g) else np.uint64(0) for g, n in self.grams]
        self.prints = np.array(prints, dtype=np.uint64)
        self.total = np.array([n.sum() for _, n in self.grams], dtype=np.int64)
        self.by_width = {}
        for k in set(self.width.tolist()) - {0}:
            own = np.flatnonzero(self.width == k)
            gram = np.concatenate([self.grams[i][0] for i in own])
            item = np.repeat(own, [len(self.grams[i][0]) for i in own])
            order = np.argsort(gram, kind="stable")
            keys, at = np.unique(gram[order], return_index=True)
            filter_ = np.zeros(1 << 20, dtype=bool)
            filter_[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[k] = (filter_, keys, np.append(at, len(order)), item[order])
        self.of_size = {}
        for m in set(self.size.tolist()) - {0}:
            own = np.flatnonzero(self.size == m)
            blocks = self.prints[own].astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            self.of_size[m] = (own, [_NEAR[:, blocks[:, j]] for j in range(BLOCKS)])

    def within(self, prints: np.ndarray, m: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, which windows) for items of m words within the radius of the windows' fingerprints."""
        own, tables = self.of_size[m]
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        met = np.zeros((len(prints), len(own)), dtype=bool)
        for j in range(BLOCKS):
            met |= tables[j][blocks[:, j]]
        for c in np.flatnonzero(met.any(axis=0)).tolist():
            rows = np.flatnonzero(met[:, c])
            yield int(own[c]), rows[np.bitwise_count(prints[rows] ^ self.prints[own[c]]) <= RADIUS]

    def similarity(self, item: int, window: np.ndarray) -> float:
        gram, count = self.grams[item]
        mine, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(gram, mine), len(gram) - 1)
        both = np.minimum(n, count[at])[gram[at] == mine].sum()
        return float(both / (n.sum() + count.sum() - both))


def _hits(items: Items, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, item) of every shingle that an item holds."""
    filter_, keys, at, item = items.by_width[k]
    maybe = np.flatnonzero(filter_[(grams >> np.uint64(44)).astype(np.int64)])
    spot = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
    same = keys[spot] == grams[maybe]
    maybe, spot = maybe[same], spot[same]
    n = at[spot + 1] - at[spot]
    which = np.arange(n.sum()) + np.repeat(at[spot] - np.cumsum(n) + n, n)
    return np.repeat(maybe, n), item[which]


def _found(items: Items, data: np.ndarray, offsets: np.ndarray, similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, best similarity, its first word, matching windows) of a chunk."""
    data = textops.LOWER[data]
    starts, ends, first = textops.words(data, offsets)
    hashes = textops.span_hashes(data, starts, ends)
    for k in items.by_width:
        grams = textops.rolled(hashes, k)
        if not len(grams):
            continue
        place, item = _hits(items, grams, k)
        text = np.searchsorted(first, place, side="right") - 1
        inside = place + k <= first[text + 1]
        place, item, text = place[inside], item[inside], text[inside]
        least = np.ceil(similarity * items.total - 1e-9).astype(np.int64)
        group = text * len(items.size) + item
        order = np.lexsort((place, group))
        place, group = place[order], group[order]
        keys, at, n = np.unique(group, return_index=True, return_counts=True)
        wide: dict[tuple[int, int], set[int]] = {}
        for key, a, c in zip(keys.tolist(), at.tolist(), n.tolist()):
            t, i = divmod(key, len(items.size))
            if c < least[i]:
                continue
            m, spots = int(items.size[i]), place[a : a + c]
            low, high = int(first[t]), int(first[t + 1])
            reach = np.unique((spots[:, None] - np.arange(max(1, m - k + 1))).ravel())
            reach = reach[(reach >= low) & (reach + m <= high)] if high - low > m else np.array([low])
            held = np.searchsorted(spots, reach + max(1, m - k + 1)) - np.searchsorted(spots, reach)
            wide.setdefault((t, m), set()).update(reach[held >= least[i]].tolist())
        for (t, m), windows in wide.items():
            if not windows:
                continue
            begin = np.array(sorted(windows))
            stop = np.minimum(begin + m, first[t + 1]) - k + 1
            lo, hi = int(begin[0]), int(stop.max())
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(grams[lo:hi]), axis=0, dtype=np.int32)])
            prints = _fingerprint(sums[stop - lo] - sums[begin - lo])
            for i, rows in items.within(prints, m):
                values = [items.similarity(i, grams[begin[r] : stop[r]]) for r in rows.tolist()]
                good = [(v, -int(begin[r] - first[t])) for v, r in zip(values, rows.tolist()) if v >= similarity - 1e-12]
                if good:
                    v, spot = max(good)
                    yield t, i, v, -spot, len(good)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, item_words: int = ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, windows: each document with each item that it holds."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 5 / item_words))
    parts = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in textops.released(batches):
                for a, b, data, offsets in textops.chunks(batch.column(1)):
                    found = list(_found(index, data, offsets, similarity))
                    if found:
                        t, i, v, w, n = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(t)), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(v, pa.float64()), pa.array(w, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "similarity", "start_word", "windows"])

        parts.append(texts_of(docs).select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, similarity double, start_word long, windows long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
