"""Token ids in binary shards with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id and sorted; each task encodes its texts and cuts its ids into shards of about
``SHARD_IDS`` ids. A shard is one binary value: a header, the Elias-Fano codes of the doc_ids and of the documents' ends,
each with the places of every ``SAMPLE``-th one of its high bits, and the ids at the vocabulary's byte width. Offsets and
doc_ids are read by select on these codes, which unpacks what lies between two samples; no table of 64-bit offsets is
stored or built for a shard. Shards are rows of a Parquet table in the shared folder, written and read by Spark alone,
so they can live in any store and a lost executor's shards are simply written again.

A text's ids depend on its pieces only: the pre-tokenizer always starts a piece at a space before a non-space, and
around a line feed between non-spaces. Cutting there is exact, and each worker encodes every distinct piece once.

Defined results: a null or empty text has the end id alone; null doc_ids come first; repeated ids stand next to each
other in either order; a long text is encoded whole, in spans of whole pieces; an empty table gives an empty one; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.shared import texts_of, written

END = 2
SHARD_IDS = 1 << 19
PIECES = 700_000
SLOT_BITS = 21
CHUNK = 1 << 19
JOINED = 256
MAGIC = 0x32464553
HEADER = 6
SAMPLE = 256
_ENCODERS: dict[str, "Encoder"] = {}

#: Bytes that may head a piece after a space or line feed: no ASCII control or space, and no byte that heads a Unicode space.
_HEAD = np.zeros(256, dtype=bool)
_HEAD[0x21:0x7F] = True
_HEAD[0xC3:0xF5] = True
_HEAD[[0xE1, 0xE2, 0xE3]] = False
_PRINT = np.zeros(256, dtype=bool)
_PRINT[0x21:0x7F] = True


class EliasFano:
    """n non-decreasing integers from 0 to ``top``: low bits packed, high bits in unary, and the place of every SAMPLE-th one."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def shape(n: int, top: int) -> tuple[int, int, int, int]:
        """Low bits of a value, bytes of all low bits and of the high bits, and the number of samples."""
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        return bits, (n * bits + 7) // 8, (n + (top >> bits) + 1 + 7) // 8, -(-n // SAMPLE)

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> "EliasFano":
        n, values = len(values), values.astype(np.uint64)
        bits, _, size, _ = cls.shape(n, top)
        low = np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1))
        high = np.zeros(8 * size, dtype=np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high), ones[::SAMPLE].astype("<u4"))

    @classmethod
    def read(cls, shard: bytes, at: int, n: int, top: int) -> tuple["EliasFano", int]:
        """The code that begins at byte ``at``, and the byte after it."""
        bits, low, high, samples = cls.shape(n, top)
        raw = np.frombuffer(shard, np.uint8, low + high, at)
        return cls(n, bits, raw[:low], raw[low:], np.frombuffer(shard, "<u4", samples, at + low + high)), at + low + high + 4 * samples

    def __bytes__(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    def select(self, wanted: np.ndarray) -> np.ndarray:
        """The values at the places ``wanted``; what is unpacked at a time lies between two samples."""
        wanted = np.asarray(wanted, dtype=np.int64)
        order = np.argsort(wanted, kind="stable")
        out, sorted_ = np.empty(len(wanted), dtype=np.int64), wanted[order]
        blocks, begins = np.unique(sorted_ // SAMPLE, return_index=True)
        for block, a, b in zip(blocks.tolist(), begins.tolist(), [*begins[1:].tolist(), len(wanted)]):
            places, first = sorted_[a:b], int(self.samples[block])
            stop = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high) - 1
            ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : stop // 8 + 1])) + first // 8 * 8
            high = ones[np.searchsorted(ones, first) :][places - block * SAMPLE] - places
            bit = places[:, None] * self.low_bits + np.arange(self.low_bits)
            low = (self.low[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(np.int64) << np.arange(self.low_bits)
            out[order[a:b]] = (high << self.low_bits) + low.sum(axis=1)
        return out


def pack(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, nulls: int, width: int) -> bytes:
    """A shard's bytes: six 64-bit header numbers, the codes of the doc_ids (less the first) and of the ends, the ids."""
    known = doc_ids[nulls:].astype(np.int64)
    base, top = (int(known[0]), int(known[-1]) - int(known[0])) if len(known) else (0, 0)
    head = np.array([MAGIC | width << 32, len(ends), len(ids), nulls, base, np.uint64(top).astype(np.int64)], dtype="<i8")
    codes = bytes(EliasFano.encode((known - np.int64(base)).view(np.uint64), top)), bytes(EliasFano.encode(ends, len(ids)))
    return b"".join((head.tobytes(), *codes, ids.astype(f"<u{width}").tobytes()))


class Shard:
    """A shard's bytes with its codes in place; nothing is decoded but what is asked for."""

    def __init__(self, data: bytes):
        magic, self.docs, count, self.nulls, self.base, top = np.frombuffer(data, "<i8", HEADER).tolist()
        if magic & 0xFFFFFFFF != MAGIC:
            raise ValueError("not a shard of token ids")
        self.names, at = EliasFano.read(data, 8 * HEADER, self.docs - self.nulls, top & (1 << 64) - 1)
        self.ends, at = EliasFano.read(data, at, self.docs, count)
        self.ids = np.frombuffer(data, f"<u{magic >> 32}", count, at)

    def bounds(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the ids of the documents at the places ``wanted``."""
        wanted = np.asarray(wanted, dtype=np.int64)
        before = np.zeros(len(wanted), dtype=np.int64)
        before[wanted > 0] = self.ends.select(wanted[wanted > 0] - 1)
        return before, self.ends.select(wanted)

    def doc_ids(self, wanted: np.ndarray) -> pa.Array:
        """doc_ids of the documents at the places ``wanted``; the first ``nulls`` are null."""
        wanted = np.asarray(wanted, dtype=np.int64)
        out, known = np.zeros(len(wanted), dtype=np.int64), wanted >= self.nulls
        out[known] = self.names.select(wanted[known] - self.nulls) + np.int64(self.base)
        return pa.array(out, mask=~known)


class Encoder:
    """The tokenizer with a bounded cache of pieces' ids; one in each Python worker."""

    def __init__(self, path: str):
        # A task has one core; threads of the library would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.forget()

    def forget(self, room: int = 0) -> None:
        #: Keys of known pieces (0 for a free place) at the places of their top bits or after, with the pieces' numbers.
        self.slot_bits = max(SLOT_BITS, (4 * room).bit_length())
        self.keys, self.numbers = np.zeros(1 << self.slot_bits, np.uint64), np.zeros(1 << self.slot_bits, np.int32)
        self.flat, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        #: The bytes of known pieces: what makes a found piece the same is its bytes, not its key.
        self.text, self.text_at, self.text_size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = self.known = self.text_used = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for new ones."""
        at = self._place(wanted)
        held = self.keys[at]
        out = np.where(held == wanted, self.numbers[at], -1)
        left = np.flatnonzero((held != wanted) & (held != 0))
        while len(left):
            at[left] = at[left] + 1 & len(self.keys) - 1
            held = self.keys[at[left]]
            same = held == wanted[left]
            out[left[same]] = self.numbers[at[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def _add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            own = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[own]], self.numbers[at[own]] = keys[own], numbers[own]
            rest = np.ones(len(keys), dtype=bool)
            rest[own] = False
            keys, numbers, at = keys[rest], numbers[rest], at[rest] + 1 & len(self.keys) - 1

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes new pieces, those that begin with a space many at a time: a piece begins anew at each of them."""
        spaced = [i for i, p in enumerate(pieces) if len(p) > 1 and p[:1] == b" " and _HEAD[p[1]]]
        alone = sorted(set(range(len(pieces))) - set(spaced))
        order = spaced + alone
        texts = [b"".join(pieces[i] for i in spaced[a : a + JOINED]).decode() for a in range(0, len(spaced), JOINED)] + [pieces[i].decode() for i in alone]
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, dtype=np.int32) for e in coded])
        #: Ids of a byte-level vocabulary stand for known numbers of bytes, so the pieces' ends give their ids' ends.
        ends = np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum([len(pieces[i]) for i in order])) + 1
        length = np.diff(ends, prepend=0)
        n, m = self.known, len(order)
        while len(self.start) < n + m:
            self.start, self.length, self.text_at, self.text_size = (np.concatenate([x, x]) for x in (self.start, self.length, self.text_at, self.text_size))
        own = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)
        while len(self.text) < self.text_used + len(own):
            self.text = np.concatenate([self.text, self.text])
        sizes = np.array([len(pieces[i]) for i in order])
        self.text[self.text_used : self.text_used + len(own)] = own
        self.text_at[n : n + m], self.text_size[n : n + m] = self.text_used + np.cumsum(sizes) - sizes, sizes
        self.text_used += len(own)
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + m] = self.used + ends - length
        self.length[n : n + m] = length
        self.used += len(flat)
        self.known += m
        self._add(keys[order], np.arange(n, n + m, dtype=np.int32))

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has."""
        bounds = np.append(starts, ends[-1:]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(coded.dictionary.cast(pa.large_binary()))[coded.indices.to_numpy()]
        length = self.length[number]
        stop = np.cumsum(length, dtype=np.int64)
        return self.flat[np.arange(stop[-1]) + np.repeat(self.start[number] - stop + length, length)], length

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, starts, ends = np.frombuffer(pieces.buffers()[2], np.uint8), offsets[:-1], offsets[1:]
        keys = textops.span_hashes(data, starts, ends) | np.uint64(1)
        if self.known + np.count_nonzero(self.find(keys) < 0) > PIECES:
            self.forget(len(keys))
        number, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(left):
            found = self.find(keys[left])
            new = np.flatnonzero(found < 0)
            if len(new):
                unique, where = np.unique(keys[left[new]], return_index=True)
                at, raw = left[new[where]], data.tobytes()
                self.learn(unique, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
                found[new] = self.find(keys[left[new]])
            number[left] = found
            # Pieces whose key another piece has take the next key of theirs.
            left = left[~self._same(data, starts[left], ends[left], found)]
            keys[left] = textops.mixed(keys[left] + np.uint64(2)) | np.uint64(1)
        return number

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the pieces' bytes are those of the known pieces."""
        size = ends - starts
        same = self.text_size[number] == size
        size = np.where(same, size, 0)
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(before, size)
        unlike = data[place + np.repeat(starts, size)] != self.text[place + np.repeat(self.text_at[number], size)]
        same[np.searchsorted(before + size, np.flatnonzero(unlike), side="right")] = False
        return same

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` after it, and the number of each text's ids."""
        docs = len(offsets) - 1
        if not len(data):
            return np.full(docs, end, np.uint32), np.ones(docs, np.int64)
        head = np.append(_HEAD[data[1:]], False)
        first = np.zeros(len(data) + 1, dtype=bool)
        first[:-1] |= (data == 0x20) & head
        feed = (data == 0x0A) & head & np.concatenate([[False], _PRINT[data[:-1]]])
        first[:-1] |= feed
        first[1:] |= feed
        inner = offsets[1:-1]
        last = inner[inner > 0] - 1
        first[last] &= ~((data[last] == 0x20) | (data[last] == 0x0A))  # what follows is another text
        first[offsets] = True
        first[-1] = False
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        #: A text beyond CHUNK is worked on in spans of whole pieces.
        ids, lengths, a = [], [], 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, side="right")))
            low, high = int(starts[a]), int(ends[b - 1])
            part, length = self._pieces(data[low:high], starts[a:b] - low, ends[a:b] - low)
            ids.append(part)
            lengths.append(length)
            a = b
        upto = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])[np.searchsorted(starts, offsets)]
        return np.insert(np.concatenate(ids), upto[1:], np.uint32(end)), np.diff(upto) + 1


def _shards(path: str, end: int, shard_ids: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []

        def flushed() -> pa.RecordBatch:
            ids, sizes, docs = (np.concatenate([h[i] for h in held]) for i in range(3))
            shard = pack(ids, np.cumsum(sizes), docs, sum(h[3] for h in held), encoder.width)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([shard], pa.binary())], ["part", "seq", "n_ids", "shard"])

        for batch in textops.released(batches):
            for a, b, data, offsets in textops.chunks(batch.column(1), CHUNK):
                ids, sizes = encoder.encode(data, offsets, end)
                own = batch.column(0).slice(a, b - a)
                held.append((ids, sizes, own.fill_null(0).to_numpy(), own.null_count))
                if sum(len(h[0]) for h in held) >= shard_ids:
                    yield flushed()
                    seq += 1
        if held:
            yield flushed()

    return shards


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.released(batches):
        for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            shard = Shard(data)
            for a in range(0, shard.docs, 1 << 16):
                wanted = np.arange(a, min(shard.docs, a + (1 << 16)))
                starts, ends = shard.bounds(wanted)
                wide = memoryview(shard.ids[starts[0] : ends[-1]].astype("<u4"))
                crc = [zlib.crc32(wide[i:j]) for i, j in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist())]
                n = len(wanted)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), shard.doc_ids(wanted), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, tokenizer_path: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """part, seq, n_ids, shard: the written shards, in ascending (part, seq) and doc_id."""
    # Rows of one doc_id, or of none, differ in the last key, so they too are dealt to many tasks.
    order = [F.col("doc_id").asc_nulls_first(), F.col("dealt")]
    ordered = texts_of(docs).select("doc_id", "text").withColumn("dealt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("dealt")
    return written(ordered.mapInArrow(_shards(tokenizer_path, end, shard_ids), "part int, seq int, n_ids long, shard binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards' bytes."""
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    #: One row for each writing task: the ids of all tasks before it.
    of_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("of_part"))
    before = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("of_seq")).join(of_part, "part").select("part", "seq", (F.col("of_part") + F.col("of_seq")).alias("before"))
    opened = shards.select("part", "seq", "shard").mapInArrow(_opened, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return opened.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
