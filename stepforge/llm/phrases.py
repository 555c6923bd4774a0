"""Phrase collocation mining with weighted acyclic automata.

Phrases of one word, then two, three and four are counted, each in one pass over all texts. A task takes a shard of a few
megabytes, sorts its distinct phrases and builds from them, in that order, a count transducer: an acyclic automaton whose
paths spell (lang, words) and whose last arcs weigh how often. The sorted paths are cut into prefix ranges, a transducer for
each, and the transducers that all shards have for a range are united: equal paths add their weights, paths below ``LEAST``
go, and states of the union with equal futures, weights included, are one. A phrase of k words is looked for only where both
phrases of k - 1 words in it are frequent, since no phrase is more frequent than its parts. Tasks know those from a bit table
of fixed size (``FILTER_BITS``); a false one costs work, never a count. The parts of candidates are looked up by composing
all distinct parts of a range with its transducers, and the answers are joined back.

Prefix ranges come from the phrases of a bounded sample of documents (``SAMPLE_DOCS``); they decide which task unites what,
and never a result.

Defined results: a null text is empty, a null lang is ``und``, as the language of that name; repeated rows count each
time; phrases of equal score and count rank by their bytes; a long text is cut between its pieces, so that it is counted
whole in parts; an empty table has no phrases; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.shared import discarded, texts_of, written

LONGEST, LEAST, FIRST = 4, 30, 2000
#: A candidate goes if a longer one around it has this share of its count.
WITHIN = 80
SCALE = 2_000_000
SHARD = 4 << 20
#: Bytes of text for each prefix range, and the most ranges.
RANGE_BYTES, RANGES = 8 << 20, 1 << 16
SAMPLE_DOCS, SAMPLE_PATHS = 2000, 32
FILTER_BITS = 26

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _bytes(labels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of labels, and their bytes one after the other."""
    labels = labels.cast(pa.large_binary())
    if not len(labels):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(labels.buffers()[1], np.int64)[labels.offset : labels.offset + len(labels) + 1]
    data = np.frombuffer(labels.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return np.diff(offsets), data[offsets[0] : offsets[-1]]


def _sorted(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in ascending order, and the place of each value among them."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()] if len(values) else np.zeros(0, np.int64)


def _ranked(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, list[tuple[np.ndarray, int, int]]]:
    """A number for each row of ``columns`` (each below its size), in the order of the rows, and how to spell it again."""
    key, room, steps = columns[0].astype(np.int64), sizes[0], []
    for column, size in zip(columns[1:], sizes[1:]):
        if room * size >= 1 << 62:
            known, key = np.unique(key, return_inverse=True)
            steps.append((known, len(known), 0))
            room = len(known)
        key, room = key * size + column, room * size
        steps.append((None, 0, size))
    return key, steps


def _spelt(key: np.ndarray, steps: list) -> np.ndarray:
    """The rows of numbers that ``_ranked`` gave."""
    columns = []
    for known, _, size in reversed(steps):
        if known is None:
            key, column = np.divmod(key, size)
            columns.append(column)
        else:
            key = known[key]
    return np.stack([key, *columns[::-1]], axis=1)


class Transducer:
    """Paths of ``depth`` labels with a weight each. Of each depth: where the arcs of a state begin, their labels (places in
    ``labels``, ascending within a state) and the states they lead to; the weights are those of the last arcs."""

    def __init__(self, labels: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray):
        self.labels, self.levels, self.weights = labels, levels, weights

    @classmethod
    def build(cls, labels: pa.Array, paths: np.ndarray, weights: np.ndarray, minimal: bool = True) -> "Transducer":
        """From distinct ``paths`` (rows of places in ``labels``) in ascending order; not ``minimal``, states stay apart."""
        known = np.zeros(len(labels), dtype=bool)
        known[paths] = True
        used, paths = np.flatnonzero(known), (np.cumsum(known) - 1)[paths]
        n, depth = paths.shape
        new = np.ones((n, depth + 1), dtype=bool)  # whether a row leaves the node of the row before at each depth
        new[1:, 0] = False
        new[1:, 1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        levels, target, weight = [], np.zeros(n, np.int64), weights.astype(np.int64)
        for d in range(depth - 1, -1, -1):
            rows = np.flatnonzero(new[:, d + 1])
            arcs = np.stack([paths[rows, d], target, weight if d == depth - 1 else np.zeros(len(rows), np.int64)], axis=1).astype(np.int64)
            begins = np.append(np.flatnonzero(new[rows, d]), len(rows))
            if not minimal:
                target = np.arange(len(begins) - 1)
                levels.append((begins, arcs[:, 0].astype(np.int32), arcs[:, 1].astype(np.int32)))
                continue
            # States whose arcs are the same bytes are one state.
            futures = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer((begins * 24).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(arcs))])
            kinds = futures.dictionary_encode()
            target = kinds.indices.to_numpy().astype(np.int64)
            size, raw = _bytes(kinds.dictionary)
            own = np.frombuffer(raw.tobytes(), np.int64).reshape(-1, 3)
            first = np.concatenate([[0], np.cumsum(size // 24)]).astype(np.int64)
            levels.append((first, own[:, 0].astype(np.int32), own[:, 1].astype(np.int32)))
            if d == depth - 1:
                weights = own[:, 2]
        return cls(labels.take(pa.array(used)), levels[::-1], weights)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in ascending order, and their weights."""
        state, out = np.zeros(1, np.int64), np.zeros((1, 0), np.int32)
        for first, label, to in self.levels:
            many = first[state + 1] - first[state]
            arc = np.arange(many.sum()) + np.repeat(first[state] - np.cumsum(many) + many, many)
            out = np.concatenate([np.repeat(out, many, axis=0), label[arc, None]], axis=1)
            state = to[arc].astype(np.int64)
        return out, self.weights[arc]

    def weigh(self, asked: list[pa.Array]) -> np.ndarray:
        """The weights of paths given as a column of labels for each depth; 0 where there is no such path."""
        state, known, arc = np.zeros(len(asked[0]), np.int64), np.ones(len(asked[0]), bool), np.zeros(len(asked[0]), np.int64)
        for (first, label, to), column in zip(self.levels, asked):
            want = pc.index_in(column, value_set=self.labels).fill_null(-1).to_numpy().astype(np.int64)
            span = len(self.labels) + 1
            keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * span + label
            arc = np.minimum(np.searchsorted(keys, state * span + want), len(keys) - 1)
            known &= (want >= 0) & (keys[arc] == state * span + want)
            state = np.where(known, to[arc], 0).astype(np.int64)
        return np.where(known, self.weights[arc], 0)

    def __bytes__(self) -> bytes:
        size, text = _bytes(self.labels)
        small = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)
        return pickle.dumps((text.tobytes(), small(size), [tuple(map(small, level)) for level in self.levels], small(self.weights)), protocol=5)

    @classmethod
    def read(cls, data: bytes) -> "Transducer":
        text, sizes, levels, weights = pickle.loads(data)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        labels = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        return cls(labels, [(a.astype(np.int64), b.astype(np.int32), c.astype(np.int32)) for a, b, c in levels], weights.astype(np.int64))

    @classmethod
    def united(cls, parts: list["Transducer"], least: int) -> "Transducer | None":
        """The union of all paths, with the sums of their weights, without those below ``least``."""
        labels, place = _sorted(pa.concat_arrays([p.labels.cast(pa.large_binary()) for p in parts]))
        rows, weights, at = [], [], 0
        for p in parts:
            paths, weight = p.paths()
            rows.append(place[at : at + len(p.labels)][paths])
            weights.append(weight)
            at += len(p.labels)
        paths, weights = np.concatenate(rows), np.concatenate(weights)
        key, steps = _ranked(list(paths.T), [len(labels)] * paths.shape[1])
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sums = np.add.reduceat(weights[order], first)
        kept = sums >= least
        return cls.build(labels, _spelt(key[first[kept]], steps), sums[kept]) if kept.any() else None


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts, with those beyond ``SHARD`` cut between pieces, and which text each one is of."""
    starts, owner = [], []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        cuts = [a]
        if b - a > SHARD:
            breaks = a + np.flatnonzero(_BREAK[data[a:b]])
            for goal in range(a + SHARD, b, SHARD):
                at = np.searchsorted(breaks, goal)
                if at < len(breaks) and breaks[at] > cuts[-1]:
                    cuts.append(int(breaks[at]))
        starts += cuts
        owner += [i] * len(cuts)
    return np.array([*starts, offsets[-1]], dtype=np.int64), np.array(owner, dtype=np.int64)


class Shard:
    """The words of some texts: each one's place among the sorted distinct words, its piece and its language."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        # One language after the other in the labels' order; words after all languages.
        self.langs, lang = _sorted(langs.cast(pa.large_binary()))
        _, _, data, offsets = next(textops.chunks(texts, 1 << 62))
        data = textops.LOWER[data]
        offsets, owner = _cut(data, offsets)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        solid = np.append(~_GAP[data], False)
        first, last = edge.copy(), edge.copy()
        first[1:] |= ~solid[:-1]
        last |= ~solid
        starts, ends = np.flatnonzero(first & solid), np.flatnonzero(last[1:] & solid[:-1]) + 1
        self.piece = np.searchsorted(np.flatnonzero(np.append(_BREAK[data], False) | edge), starts, side="right")
        self.lang = lang[owner[np.searchsorted(offsets, starts, side="right") - 1]] if len(starts) else np.zeros(0, np.int64)
        sizes = ends - starts
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[solid[:-1]])])
        self.words, self.word = _sorted(words)

    def labels(self) -> pa.Array:
        """Languages and then words: places in this array are the labels of paths. The empty word stands for all words."""
        return pa.concat_arrays([self.langs, pa.array([b""], pa.large_binary()), self.words.cast(pa.large_binary())])

    def places(self, k: int, frequent: np.ndarray | None) -> np.ndarray:
        """Where phrases of k words begin whose two phrases of k - 1 words may be frequent."""
        n = len(self.word) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        ok = self.piece[:n] == self.piece[k - 1 :]
        if frequent is not None:
            part = _held(frequent, _hashes(_hashed(self.langs)[self.lang], _hashed(self.words)[self.word], k - 1))
            ok &= part[:n] & part[1 : n + 1]
        return np.flatnonzero(ok)

    def counts(self, k: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct paths of k words, in ascending order, and their counts; for single words those of the empty word too."""
        at = self.places(k, frequent)
        low = len(self.langs)
        columns = [self.lang[at], *[self.word[at + j] + low + 1 for j in range(k)]]
        key, steps = _ranked(columns, [low, *[low + 1 + len(self.words)] * k])
        key, counts = np.unique(key, return_counts=True)
        paths = _spelt(key, steps)
        if k == 1 and len(at):
            langs, words = np.unique(self.lang, return_counts=True)
            paths, counts = np.concatenate([np.stack([langs, np.full(len(langs), low)], axis=1), paths]), np.concatenate([words, counts])
            order = np.lexsort((paths[:, 1], paths[:, 0]))
            paths, counts = paths[order], counts[order]
        return paths, counts


def _hashed(labels: pa.Array) -> np.ndarray:
    sizes, data = _bytes(labels)
    ends = np.cumsum(sizes, dtype=np.int64)
    return textops.span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if len(labels) else np.zeros(0, np.uint64)


def _hashes(langs: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """A hash of (lang, k words) at each word but the last k - 1."""
    return textops.mixed(textops.rolled(words, k) ^ (langs[: len(words) - k + 1] * np.uint64(3)))


def _held(frequent: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - FILTER_BITS)
    return frequent[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) > 0


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of about ``SHARD`` bytes of text, from batches of lang and text."""
    held, size = [], 0
    for batch in textops.released(batches):
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SHARD - size, side="right")))
            held.append((batch.column(0).slice(a, b - a), texts.slice(a, b - a)))
            size += int(ends[b - 1] - (ends[a - 1] if a else 0))
            a = b
            if size >= SHARD or a < len(ends):
                yield Shard(*(pa.concat_arrays(c) for c in zip(*held)))
                held, size = [], 0
    if held:
        yield Shard(*(pa.concat_arrays(c) for c in zip(*held)))


def _columns(labels: pa.Array, paths: np.ndarray) -> list[pa.Array]:
    return [labels.take(pa.array(paths[:, d])) for d in range(paths.shape[1])]


def _counter(k: int, bounds, frequent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            paths, counts = shard.counts(k, frequent.value if frequent else None)
            if not len(paths):
                continue
            labels = shard.labels()
            path = lambda i: tuple(labels[j].as_py() for j in paths[i].tolist())
            cuts = [0, *[bisect_left(range(len(paths)), bound, key=path) for bound in bounds.value], len(paths)]
            full = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
            parts = [bytes(Transducer.build(labels, paths[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]], minimal=False)) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(parts, pa.binary())], ["range", "part"])

    return count


def _uniter(k: int, least: int):
    def unite(parts: pa.Table) -> pa.Table:
        found = Transducer.united([Transducer.read(p) for p in parts.column("part").to_pylist()], least)
        rows = [] if found is None else [(parts.column("range")[0].as_py(), k, bytes(found))]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["range", "words", "part"])

    return unite


def _bounds(docs: DataFrame) -> list[tuple]:
    """The first paths of all prefix ranges but the first."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = min(RANGES, (size or 0) // RANGE_BYTES)
    if ranges < 2:
        return []
    every = max(1, n // SAMPLE_DOCS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            at = shard.places(1, None)
            at = at[np.argsort(textops.mixed(at.astype(np.uint64)), kind="stable")[: SAMPLE_PATHS]]
            for i in at.tolist():
                run = range(i, min(i + LONGEST, len(shard.word)))
                path = [shard.langs[shard.lang[i]].as_py(), *[shard.words[shard.word[j]].as_py() for j in run if shard.piece[j] == shard.piece[i]]]
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.list_(pa.binary()))], ["path"])

    # Each sampled document is a shard of its own.
    rows = docs.filter(F.pmod(F.xxhash64("lang", "text"), F.lit(every)) == 0).dropDuplicates(["lang", "text"]).limit(2 * SAMPLE_DOCS)
    paths = sorted({tuple(map(bytes, r["path"])) for r in rows.mapInArrow(_one_by_one(sample), "path array<binary>").collect()})
    return sorted({paths[len(paths) * i // ranges] for i in range(1, ranges)}) if paths else []


def _one_by_one(sample):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from sample(iter([batch.slice(i, 1)]))

    return run


def _frequent(found: DataFrame):
    """The bit table of the phrases of ``found``, broadcast: 2 ** ``FILTER_BITS`` bits whatever there is."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                t = Transducer.read(part)
                paths, hashes = t.paths()[0], _hashed(t.labels)
                whole = np.zeros(len(paths), np.uint64)
                for j in range(1, paths.shape[1]):
                    whole += hashes[paths[:, j]] * textops._STEP[j - 1]
                bit = textops.mixed(textops.mixed(whole) ^ (hashes[paths[:, 0]] * np.uint64(3))) >> np.uint64(64 - FILTER_BITS)
                yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((bit & np.uint64(63)).astype(np.int32))], ["word", "bit"])

    words = found.select("part").mapInArrow(bits, "word long, bit int").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return found.sparkSession.sparkContext.broadcast(table)


def transducers(docs: DataFrame, least: int = LEAST) -> tuple[list[DataFrame], object]:
    """range, words, part (a written table for each number of words), and the bounds of the ranges."""
    own = texts_of(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds, frequent, found = docs.sparkSession.sparkContext.broadcast(_bounds(own)), None, []
    for k in range(1, LONGEST + 1):
        parts = own.mapInArrow(_counter(k, bounds, frequent), "range int, part binary")
        found.append(written(parts.groupBy("range").applyInArrow(_uniter(k, least), "range int, words int, part binary"), f"phrases-{k}"))
        frequent = _frequent(found[-1])
    return found, bounds


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.column(0).to_pylist():
            t = Transducer.read(part)
            paths, weights = t.paths()
            lang, *words = _columns(t.labels, paths)
            words = pa.array([list(w) for w in zip(*(c.cast(pa.string()).to_pylist() for c in words))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), words, pa.array(weights)], ["lang", "words", "a"])


def _looked_up(key, asked: pa.Table, parts: pa.Table) -> pa.Table:
    """lang, words, f: the weights of the asked paths in the transducers of their range."""
    known = {r["words"]: Transducer.read(r["part"]) for r in parts.to_pylist()}
    out = []
    for k, t in known.items():
        own = asked.filter(pc.equal(pc.list_value_length(asked.column("words")), k)).combine_chunks()
        if own.num_rows:
            words = own.column("words").combine_chunks()
            columns = [own.column("lang").combine_chunks(), *[pc.list_element(words, j) for j in range(k)]]
            out.append(own.select(["lang", "words"]).append_column("f", pa.array(t.weigh([c.cast(pa.large_binary()) for c in columns]))))
    return pa.concat_tables(out) if out else asked.select(["lang", "words"]).slice(0, 0).append_column("f", pa.array([], pa.int64()))


def _ranger(bounds):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            at = [bisect_right(bounds.value, (lang.encode(), *[w.encode() for w in words])) for lang, words in paths]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1)], ["range", "lang", "words"])

    return place


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` phrases; docs: text, lang."""
    found, bounds = transducers(docs, least)
    spelled = [t.select("part").mapInArrow(_spelled, "lang string, words array<string>, a long") for t in found]
    candidates = written(spelled[1].unionByName(spelled[2]).unionByName(spelled[3]), "candidates")
    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail"))
    asked = cuts.select("lang", F.explode(F.array("head", "tail")).alias("words")).distinct()
    parts = found[0].unionByName(found[1]).unionByName(found[2])
    answers = asked.mapInArrow(_ranger(bounds), "range int, lang string, words array<string>").groupBy("range").cogroup(parts.groupBy("range"))
    answers = written(answers.applyInArrow(_looked_up, "lang string, words array<string>, f long"), "part-counts")
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(answers.select("lang", F.col("words").alias(side), F.col("f").alias(name)), ["lang", side])
    # A decimal of 38 digits holds the product whatever a 64-bit count is.
    score = F.expr(f"cast({SCALE} as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    around = candidates.filter(F.size("words") > 2).select("lang", F.explode(inner).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "words"], "left").filter(f"around IS NULL OR cast(around as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {WITHIN}")
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).filter(F.col("rank") <= first)
    totals = spelled[0].filter(F.col("words")[0] == "").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_WORDS = "list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '')"
#: DuckDB: all phrases of one to four words counted at once.
ORACLE_SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d), w AS (SELECT lang, {_WORDS} AS w FROM p),
g AS (SELECT lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) AS g FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY 1, 2, 3), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= {LEAST}), cuts AS (SELECT lang, g, f AS a, k, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cuts.lang, cuts.g, a, j, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:j] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[j + 1:]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS turn FROM s) WHERE turn = 1),
i AS (SELECT lang, unnest(flatten([[g[i:i + m - 1] for i in range(1, k - m + 2)] for m in range(2, k)])) AS g, f FROM c WHERE k > 2), o AS (SELECT lang, g, max(f) AS f FROM i GROUP BY 1, 2),
q AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR o.f::HUGEINT * 100 < a::HUGEINT * {WITHIN})
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q) JOIN n USING (lang) WHERE rank <= {FIRST}"""
