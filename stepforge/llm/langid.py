"""Language identification by prediction by partial matching (PPM) over byte context trees.

For each learned language a variable-order tree of byte contexts (orders 0 to 3) holds counts of the next byte, and
escape method C gives the probability of falling to the next shorter context, with the symbols already seen excluded.
The statistics are frozen after the fit, so that the code length of a byte depends on its longest known context alone,
and a text is scored by exact sums over all its bytes. Each language keeps its own tables of what its contexts have seen
(``Tree``), so its model and its orders are the same however many languages there are.

The fit uses a sample of labelled rows bounded by ``FIT_DOCS`` texts a language (expected, chosen by a hash of doc_id and text, each such row once), the
``LANGUAGES`` languages with the most rows and the ``GRAMS`` most frequent 4-byte sequences of each, so the model that is
broadcast has a fixed bound: under 2 MB a language. Bytes are read after lower-casing A-Z. The score is the weight of the
best language when each byte's gap between languages counts for at most ``EVIDENCE`` bytes of text.

Defined results: a null text and a text without a letter give ``und`` with score 0; so do all texts when nothing could
be learned; a null doc_id is never learned from and counts as not held out; repeated rows are scored alike; a long text is
scored whole; an empty table gives an empty one. ``identify`` adds its three columns in place of columns of those names;
``recognised`` gives rows back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.shared import texts_of

FIT_DOCS = 800
LANGUAGES = 200
GRAMS = 1 << 16
ORDER = 3
UNKNOWN = "und"
PAD = 10
CHUNK = 1 << 18
#: Bytes of evidence that a score counts at most: the gap between languages, a byte, is taken so many times.
EVIDENCE = 64
PREDICTED = ["lang_pred", "score", "bits_per_byte"]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts with ORDER padding bytes before each, and for each text its first byte's place."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    out = np.full(len(data) + ORDER * n, PAD, dtype=np.uint8)
    at = offsets[:-1] + ORDER * np.arange(1, n + 1)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), lengths)] = textops.LOWER[data]
    return out, at


def _grams(x: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number."""
    out = np.zeros(max(0, len(x) - ORDER), dtype=np.uint32)
    for i in range(ORDER + 1):
        out <<= np.uint32(8)
        out |= x[i : len(out) + i]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.released(batches):
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for a, b, data, offsets in textops.chunks(batch.column(1)):
            for lang in sorted(set(langs[a:b])):
                mine = np.flatnonzero(langs[a:b] == lang)
                grams = []
                for i in mine:
                    x, _ = _codes(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                    grams.append(_grams(x))
                keys, counts = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, counts, minlength=len(unique))


def _held(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands in a sorted table, and whether it does."""
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


class Tree:
    """The byte contexts of one language, as sorted tables of each order: code lengths in bits of the (context, byte) pairs
    seen, and of the escape of each context known. A pair's number is its bytes, the oldest first."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        pairs, n = _sums(grams & 0xFF, counts)
        p = np.full(256, len(n) / (n.sum() + len(n)) / max(1, 256 - len(n)))
        p[pairs] = n / (n.sum() + len(n) * (len(n) < 256))
        self.root, self.orders = -np.log2(p), []
        for order in range(1, ORDER + 1):
            pairs, n = _sums(grams & (1 << 8 * (order + 1)) - 1, counts)
            contexts, first = np.unique(pairs >> 8, return_index=True)
            total, distinct = np.add.reduceat(n, first), np.diff(np.append(first, len(pairs)))
            #: Method C: distinct / (total + distinct) escapes, to the bytes that the context has not seen.
            unseen = 1 - np.add.reduceat(np.exp2(-self.bits(pairs)), first)
            escape = np.where(unseen > 1e-9, distinct, 0)
            bits = np.log2(np.repeat(total + escape, distinct)) - np.log2(n)
            leave = np.log2(total + escape) - np.log2(np.maximum(escape, 1e-300)) + np.log2(np.maximum(unseen, 1e-300))
            self.orders.append((pairs.astype(np.uint32), bits.astype(np.float32), contexts.astype(np.uint32), leave.astype(np.float32)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(len(self.orders), 0, -1):
            pairs, bits, contexts, leave = self.orders[order - 1]
            own = (grams[left] & (1 << 8 * (order + 1)) - 1).astype(np.uint32)
            at, seen = _held(pairs, own)
            out[left[seen]] += bits[at[seen]]
            left, own = left[~seen], own[~seen]
            at, known = _held(contexts, own >> np.uint32(8))
            out[left[known]] += leave[at[known]]
        out[left] += self.root[grams[left] & 0xFF]
        return out


class Model:
    """A tree of each language; what one holds does not depend on how many there are."""

    def __init__(self, langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.langs = langs
        self.trees = [Tree(grams[lang == i], counts[lang == i].astype(float)) for i in range(len(langs))]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language, from the code lengths of the chunk's distinct grams."""
        x, at = _codes(data, offsets)
        out = np.zeros((len(at), len(self.langs)))
        if not len(data):
            return out
        grams, place = np.unique(_grams(x), return_inverse=True)
        first, last = at - ORDER, at - ORDER + np.diff(offsets)
        for i, tree in enumerate(self.trees):
            sums = np.concatenate([[0.0], np.cumsum(tree.bits(grams)[place])])
            out[:, i] = sums[last] - sums[first]
        return out


def fit(docs: DataFrame) -> Model | None:
    """The frozen model of the labelled rows of ``docs`` that are not held out; None if there are none."""
    known = texts_of(docs).select("doc_id", "lang", "text").filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # By doc_id and text, each such row once: rows with a repeated id do not come all at once.
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) * F.col("n") < F.lit(FIT_DOCS * (1 << 30))
    sample = known.join(F.broadcast(counts), "lang").filter(share).dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text")
    grams = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= GRAMS).drop("rank").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "gram"])
    langs = sorted(rows["lang"].unique())
    return Model(langs, rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), rows["gram"].to_numpy(dtype=np.int64), rows["n"].to_numpy())


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with a last column that tells whether the text holds a letter, under a name that is free."""
    name = "letters"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return texts_of(docs).withColumn(name, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def _judged(frozen: Model | None, batch: pa.RecordBatch, place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """A chunk of the batch (without its last column, the letters) with lang_pred, score and bits_per_byte."""
    letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
    for a, b, data, offsets in textops.chunks(batch.column(place), CHUNK):
        size = np.diff(offsets)
        if frozen is None:
            best, prob, rate, names = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a), np.array([UNKNOWN], dtype=object)
        else:
            bits = frozen.lengths(data, offsets)
            best = bits.argmin(axis=1)
            gap = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(size, 1)[:, None] * np.minimum(size, EVIDENCE)[:, None]
            prob = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
            rate, names = bits.min(axis=1) / np.maximum(size, 1), np.array(frozen.langs, dtype=object)
        ok = letters[a:b] & (frozen is not None)
        part = batch.slice(a, b - a)
        yield pa.RecordBatch.from_arrays(part.columns[:-1], names=batch.schema.names[:-1]), np.where(ok, names[best], UNKNOWN), np.where(ok, prob, 0.0), rate


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (of the predicted language); only the text is looked at.

    Columns of ``docs`` that have these names already are replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in PREDICTED])
    place, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.released(batches):
            for part, pred, prob, rate in _judged(shared.value, batch, place):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(prob), pa.array(rate)], [*part.schema.names, *PREDICTED])

    schema = docs.schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return _marked(docs).mapInArrow(score, schema)


def recognised(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is known with a score of ``least`` or more."""
    place, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.released(batches):
            for part, pred, prob, _ in _judged(shared.value, batch, place):
                yield part.filter(pa.array((pred != UNKNOWN) & (prob >= least)))

    return _marked(docs).mapInArrow(keep, docs.schema)
