"""Greedy leader clusters of texts by the similarity of their character sequences.

In ascending order of ids, each text that no earlier leader holds leads, and holds every later free text whose ratio (twice
the longest common subsequence over both lengths) with it is at least the threshold. Candidates come from a prefix filter
that loses none: texts at the threshold differ in at most D inserted and deleted characters, each of which breaks at most
q of a text's padded sequences of q characters, so of any two such texts the q * D + 1 rarest sequences of each share one.
q is the longest of ``GRAMS`` at which every text has so many. Rarity is counted in a table of fixed size; a shared cell
costs work, never a link. Repeated texts are one.

A round opens the smallest free texts of their sequences' groups, compares them with all later free texts there, and settles
whoever has no smaller text left that could lead or claim it; the links between opened texts are followed in ascending order
of ids within a partition. A group lets in one text, and ``WIDEN`` more for each leader that it gained in the round before.
So of a crowd of like texts the first is compared with the others and their pairs are never expanded, and a crowd of unlike
texts that share most sequences is settled by more and more at once; all its pairs are compared, as in the loop. Rounds go
on while texts are free.

Defined results: null texts and ids are left out; equal texts follow the smallest id; empty texts are equal; of a repeated
id with different texts the smallest text counts; a comparison of long texts takes the product of their lengths over a
machine word; a threshold below ``LEAST`` is refused, since no sequence would have to be shared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import batched, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from stepforge.functions.similarity import common_subsequence
from stepforge.operators.order import discarded, written

GRAMS, LEAST = (16, 8, 4), 0.9
#: Cells of the table of counts: 8 MB in each task. Parts of the table, summed one by one.
CELLS, PARTS = 1 << 20, 64
#: Texts a group opens for each leader it gained, and characters whose sequences are held at once.
WIDEN, CHARS = 3, 1 << 18
#: Rounds whose settled texts are united into one table.
FOLD = 12
_PAD = 0x110000


def gram(threshold: float) -> int:
    """The longest sequence of which any text has more than its differences from a text at the threshold can break."""
    return next(q for q in GRAMS if 2 * q * (1 - threshold) <= threshold)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each padded sequence of ``q`` characters, text by text, and how many each text has."""
    lengths = np.array([len(t) for t in texts])
    held = lengths + q - 1
    codes = np.full(int((held + q - 1).sum()), _PAD, np.uint64)
    starts = np.cumsum(held + q - 1) - held - q + 1
    own = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes[own + np.repeat(starts + q - 1, lengths)] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, width = _mixed(codes + np.uint64(1)), 1
    while width < q:
        hashes, width = _mixed(hashes[:-width] * np.uint64(31) + hashes[width:]), 2 * width
    own = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    return hashes[own + np.repeat(starts, held)], held


def _rarest(texts: list[str], q: int, most: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` rarest sequences of each text, and their text's place; the n-th of the same sequence is one of its own.

    A sequence's cell is in its low bits, so that its rarity follows from itself."""
    hashes, held = _hashes(texts, q)
    owner = np.repeat(np.arange(len(texts)), held)
    hashes = hashes[np.lexsort((hashes, owner))]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
    turn = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    low = np.uint64(CELLS - 1)
    grams = _mixed(hashes + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~low | hashes & low
    grams = grams[np.lexsort((grams, counts[(grams & low).astype(np.int64)], owner))]
    kept = np.arange(len(grams)) - np.repeat(np.cumsum(held) - held, held) < most[owner]
    return grams[kept], owner[kept]


def allowed(length: int, threshold: float) -> int:
    """Inserted and deleted characters between a text of ``length`` and any text at the threshold."""
    return math.floor(2 * (1 - threshold) / threshold * length + 1e-9)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` (id, text) in runs of about ``CHARS`` characters."""
    whole = np.cumsum([len(t) for t in batch.column(1).to_pylist()]) // CHARS
    cuts = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _tallied(q: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for run in _runs(batch):
                total += np.bincount((_hashes(run.column(1).to_pylist(), q)[0] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS)), pa.array([part.tobytes() for part in np.split(total, PARTS)], pa.binary())], ["part", "n"])

    return tally


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(n.as_buffer(), np.int64) for n in table.column("n"))
    return pa.table({"part": table.column("part")[:1], "n": pa.array([total.tobytes()], pa.binary())})


def _groups(texts: DataFrame, threshold: float) -> DataFrame:
    """id, size and gram: a row for each of the rarest sequences of each text that another text of like length has among
    its own. Of a sequence's texts in the order of their lengths, a group ends where the next one is too long for the last."""
    q = gram(threshold)
    # A text that allows no difference is like no other one.
    longer = texts.filter(F.length("text") >= math.ceil((1 - 1e-6) * threshold / (2 * (1 - threshold)))) if threshold < 1 else texts.limit(0)
    parts = longer.mapInArrow(_tallied(q), "part long, n binary").groupBy("part").applyInArrow(_summed, "part long, n binary").toArrow()
    table = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for part, n in zip(parts.column("part").to_pylist(), parts.column("n").to_pylist()):
        table[part] = np.frombuffer(n, np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(table.ravel())

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch):
                own = run.column(1).to_pylist()
                grams, owner = _rarest(own, q, np.array([q * allowed(len(t), threshold) + 1 for t in own]), shared.value)
                sizes = np.array([len(t) for t in own])
                yield pa.RecordBatch.from_arrays([pa.array(run.column(0).to_numpy()[owner]), pa.array(sizes[owner]), pa.array(grams.view(np.int64))], ["id", "size", "gram"])

    by_size = Window.partitionBy("gram").orderBy("size")
    before, after = F.lag("size").over(by_size), F.lead("size").over(by_size)
    grams = longer.mapInArrow(prefix, "id long, size long, gram long")
    grams = grams.withColumns({"joins": F.coalesce(_fits(before, F.col("size"), threshold), F.lit(False)), "joined": F.coalesce(_fits(F.col("size"), after, threshold), F.lit(False))})
    run = F.count_if(~F.col("joins")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grams.withColumn("run", run).filter("joins or joined").select("id", "size", F.xxhash64("gram", "run").alias("gram"))


def _fits(left: Column, right: Column, threshold: float) -> Column:
    """Whether two lengths leave room for the threshold."""
    return 2 * F.least(left, right) >= threshold * (left + right)


def _alike(threshold: float):
    @F.pandas_udf(BooleanType())
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> bool:
            whole = len(a) + len(b)
            return a == b or 2 * min(len(a), len(b)) >= threshold * whole and 2 * common_subsequence(a, b) >= threshold * whole

        return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="bool")

    return alike


def _opened(live: DataFrame, free: DataFrame, gained: DataFrame) -> DataFrame:
    """Ids of free texts to open: in all their groups, within the most that one of them opens."""
    place = F.row_number().over(Window.partitionBy("gram").orderBy("id"))
    most = 1 + WIDEN * F.coalesce("gained", F.lit(0))
    own = live.withColumn("place", place).join(gained, "gram", "left").groupBy("id").agg(F.max("place").alias("place"), F.max(most).alias("most"))
    return free.filter("not opened").join(own.filter("place <= most"), "id").select("id")


def _settled(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """id and leader of each text that can be settled, of rows (id, opened, wait, low, leads) in the order of id and low."""
    known: dict[int, bool] = {}
    for i, own in groupby(rows, itemgetter(0)):
        leader = None
        for _, opened, wait, low, leads in own:
            if low is None:
                continue
            if wait is not None and low > wait:
                break
            if leads or known.get(low):
                leader = low
                break
            if low not in known:
                break
        else:
            # Whoever is like it follows another.
            leader = i if opened and wait is None else None
        if leader is not None:
            known[i] = leader == i
            yield i, leader


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``low`` is a smaller like text, ``wait`` the smallest one that is not compared yet; what is found for the ids of a
    partition settles those after them."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for some in batched(_settled(rows), 10_000):
        ids, leaders = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaders, pa.int64())], ["id", "leader"])


def text_leaders(rows: DataFrame, threshold: float = 0.99) -> DataFrame:
    """id, leader for every id of ``rows`` (id, text)."""
    if threshold < LEAST:
        raise ValueError(f"a threshold below {LEAST} has no prefix filter")
    spark = rows.sparkSession
    known = rows.filter("id is not null and text is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("text").alias("text"))
    firsts = written(known.groupBy("text").agg(F.min("id").alias("first")), "distinct-texts")
    texts = firsts.select(F.col("first").alias("id"), "text")
    # Only texts that share a sequence can be alike; the others lead themselves.
    live = written(_groups(texts, threshold), "live")
    free = written(live.select("id", F.lit(False).alias("opened")).distinct(), "free")
    links = written(spark.createDataFrame([], "id long, low long, leads boolean"), "links")
    gained = written(spark.createDataFrame([], "gram long, gained long"), "gained")
    settled: list[DataFrame] = []
    while not free.isEmpty():
        new = written(_opened(live, free, gained), "opened")
        lows = live.join(new, "id").select("gram", F.col("id").alias("low"), F.col("size").alias("low_size"))
        pairs = lows.join(live, "gram").filter("low < id").filter(_fits(F.col("low_size"), F.col("size"), threshold)).select("low", "id").distinct()
        pairs = pairs.join(texts.select(F.col("id").alias("low"), F.col("text").alias("a")), "low").join(texts.withColumnRenamed("text", "b"), "id")
        more = pairs.filter(_alike(threshold)("a", "b")).select("id", "low", F.lit(False).alias("leads"))
        linked = written(links.unionByName(more), "linked")
        now = free.join(new.withColumn("new", F.lit(True)), "id", "left").select("id", (F.col("opened") | F.col("new").isNotNull()).alias("opened"))
        least = live.join(now.filter("not opened"), "id", "left_semi").groupBy("gram").agg(F.min("id").alias("least"))
        waits = live.join(least, "gram").filter("least < id").groupBy("id").agg(F.min("least").alias("wait"))
        state = now.join(waits, "id", "left").join(linked, "id", "left").select("id", "opened", "wait", "low", "leads")
        done = written(state.repartitionByRange("id").sortWithinPartitions("id", "low").mapInArrow(_swept, "id long, leader long"), "settled")
        settled.append(done)
        if len(settled) > FOLD:
            settled = [written(reduce(DataFrame.unionByName, settled), "settled")]
        old = [free, live, links, gained, linked, new]
        gained = written(live.join(done.filter("id = leader"), "id", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("gained")), "gained")
        free, live = written(now.join(done, "id", "left_anti"), "free"), written(live.join(done, "id", "left_anti"), "live")
        # Of the links of free texts, those to leaders and to other free texts stay.
        of_low = done.select(F.col("id").alias("low"), F.col("leader").alias("of_low"))
        links = linked.join(done, "id", "left_anti").join(of_low, "low", "left").filter("of_low is null or of_low = low")
        links = written(links.select("id", "low", (F.col("leads") | F.col("of_low").isNotNull()).alias("leads")), "links")
        discarded(*old)
    leaders = texts.select("id")
    if settled:
        leaders = leaders.join(reduce(DataFrame.unionByName, settled), "id", "left")
    else:
        leaders = leaders.withColumn("leader", F.col("id"))
    found = leaders.select(F.col("id").alias("first"), F.coalesce("leader", "id").alias("leader"))
    return known.join(firsts, "text").join(found, "first").select("id", "leader")
