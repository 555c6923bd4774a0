"""Vectorised byte-level text work for Arrow batches: words, word hashes and shingle sets.

Everything runs inside one Spark task on one bounded chunk of a batch; a chunk is cut at ``CHUNK`` bytes of text,
and one longer document makes a chunk of its own. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D,
which on UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64)]
_POWERS: dict[int, np.ndarray] = {}


def chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each chunk of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and idles with what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with memory released after each one's work and at the end."""
    for batch in batches:
        yield batch
        del batch
        release()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(CHUNK, n) + 1
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * CHUNK:
            _POWERS[base] = have
    return have


_INVERSE = pow(_BASE, -1, 1 << 64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (with one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, spans that overlap too. Unlike spans can be made that share it: for buckets of
    features, which bear that, and never to tell texts apart."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data) + 1, _BASE)[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(len(data) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64))


_PLACES = [mixed(np.arange(1, CHUNK, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)]


def _places(n: int) -> np.ndarray:
    """A random odd number for each place in a span."""
    if n <= len(_PLACES[0]):
        return _PLACES[0]
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, which come in order and do not overlap: a sum of products of two random numbers,
    the byte's and that of its place in the span, so that no structure of the bytes makes unlike spans meet."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    before = np.cumsum(size) - size
    total = int(before[-1] + size[-1])
    place = np.arange(total) - np.repeat(before, size)
    bytes_ = data[starts[0] : ends[-1]] if total == ends[-1] - starts[0] else data[place + np.repeat(starts, size)]
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(_BYTE[bytes_] * _places(int(size.max()))[place], out=sums[1:])
    return mixed(sums[before + size] - sums[before] + size.astype(np.uint64) * np.uint64(_BASE))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k hashes in a row, as ``len(hashes) - k + 1`` values, across texts too."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    out = hashes[:n] * _STEP[0]
    for i in range(1, k):
        out += hashes[i : n + i] * _STEP[i]
    return mixed(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole short sequence, apart from those of shingles."""
    n = len(hashes)
    return mixed(np.array([sum(int(h) * int(_STEP[i]) for i, h in enumerate(hashes)) * 3 + 0x51ED + n & (1 << 64) - 1], dtype=np.uint64))[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles (after lower-casing A-Z); with fewer words, one for the whole."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    grams = rolled(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield np.array([whole(hashes[a:b])], dtype=np.uint64)
        else:
            yield np.zeros(0, np.uint64)
