"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Each text becomes its set of distinct word shingles, a 128-bit identity of that set, and ``trees`` signature orders
   of ``VALUES`` MinHash values each. Texts with one identity form a class and go on as one representative.
2. Every order is sorted over all texts, by a range partitioning whose last key is the text, so that no region of it can
   fill one task. The longest common prefix of neighbours is measured: neighbours are candidates if they share ``LEAST``
   values, and a text also meets the hub of its region, at a depth that follows the region (the shortest prefix that
   ``REGION`` texts at most share, of those that a task holds at once) and at a fixed ``SHALLOW`` depth. A region's hub
   has the signature that most of its texts have.
3. Candidates are confirmed on the full shingle sets, and components follow the confirmed links.
4. What the forest missed is found by an exact prefix-filter join of texts in different components. A shingle is common
   when it stands in about ``COMMON`` texts or more (estimated from a sample; any choice gives the same links). A linked
   pair either shares one of the others within both prefixes, or reaches the threshold by common shingles alone. The
   first are met in short lists; for the second, texts with one set of common shingles link through their smallest, and
   the smallest of different sets are compared block by block within crowds, texts that share a rare one of their common
   shingles, unless a crowd is one component already. A task gives back only how components are joined.

Forest candidates grow in proportion to texts times trees. The join adds the pairs of different components that share
prefix shingles in lists of bounded length; a crowd of different common sets that the forest has not joined is compared
text by text, in blocks, which costs its square.

Defined results: a text without words (or null) has no shingles and links with nothing; a text with fewer words than a
shingle is one shingle of the whole; equal sets always link; a null doc_id keeps its row, with its class's component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.components import components
from stepforge.llm.shared import discarded, sized, texts_of, written

TREES = 12
#: Values of a signature order, of 16 bits each: two 64-bit numbers that sort as the values do.
VALUES = 8
#: Shared values that make neighbours candidates, that make a region with a hub, and texts of a region at its own depth.
LEAST, SHALLOW, REGION = 2, 4, 64
COMMON = 256
#: Beyond so many times COMMON texts, the limit grows with the texts, which bounds the broadcast of common shingles.
SPREAD = 4000
SEEN = 8
#: Texts and common shingles of a block of a crowd, and shingles that are counted at once.
CELL_TEXTS, CELL_SHINGLES, COLUMNS = 512, 1 << 19, 1024
_LAST = np.iinfo(np.int64).max

_RNG = np.random.default_rng(7)


def _identity(joined: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set of ``joined``, whose sets begin at ``at``."""
    return tuple(np.add.reduceat(textops.mixed(x), at) for x in (joined ^ np.uint64(0xA5A5), joined + np.uint64(0x1234567)))


def _signer(shingle_words: int, trees: int):
    count = trees * VALUES
    factors = _RNG.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = _RNG.integers(0, 2**32, count, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.released(batches):
            ids = batch.column(0)
            for a, b, data, offsets in textops.chunks(batch.column(1)):
                sets = list(textops.shingle_sets(data, offsets, shingle_words))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                labels = np.zeros((b - a, count), dtype=np.uint16)
                one, two = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                if len(full):
                    joined = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    one[full], two[full] = _identity(joined, at)
                    small = (joined >> np.uint64(32)).astype(np.uint32)
                    for p in range(0, len(full), 64):
                        part = small[at[p] : at[p + 64] if p + 64 < len(full) else len(small)]
                        cuts = at[p : p + 64] - at[p]
                        for j in range(count):
                            # A minimum is near zero; its low bits are as good as random.
                            labels[full[p : p + 64], j] = np.minimum.reduceat(part * factors[j] + shifts[j], cuts)
                orders = labels.astype(">u2").reshape(-1).view(">i8").astype(np.int64)
                packed = pa.FixedSizeListArray.from_arrays(pa.array(orders), trees * 2).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), packed], ["doc_id", "n_shingles", "one", "two", "keys"])

    return sign


def _shared_values(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many leading values rows of (tree, first, second) share; 0 in different trees."""
    unlike = ((left[:, 1:] ^ right[:, 1:]).astype(">i8").view(np.uint8).view(">u2").reshape(len(left), VALUES) != 0)
    return np.where(left[:, 0] != right[:, 0], 0, np.where(unlike.any(axis=1), unlike.argmax(axis=1), VALUES))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of a sorted part of the orders (tree, first, second, id).

    Each row meets the next one, if they share LEAST values; the hub of its region of SHALLOW values; and the hub of the
    region at its own depth, the shortest shared prefix that REGION rows at most (of a batch) have. A hub is a row of the
    label that most rows of the region have. A shallow region that a batch boundary cuts has its hubs linked."""
    last, hub = None, None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
        if not len(rows):
            continue
        before = rows[:1] if last is None else last
        shared = _shared_values(np.concatenate([before, rows[:-1]])[:, :3], rows[:, :3])
        shared[0] = 0 if last is None else shared[0]
        first, ids, pairs = shared[0], rows[:, 3], []
        near = np.flatnonzero(shared >= LEAST)
        pairs.append((np.concatenate([before[:, 3], ids[:-1]])[near], ids[near]))
        shared[0] = 0
        runs = {d: np.cumsum(shared < d) - 1 for d in range(LEAST, VALUES + 1)}
        sizes = {d: np.bincount(run) for d, run in runs.items()}
        depth = np.full(len(rows), VALUES)
        for d in range(VALUES, LEAST - 1, -1):
            depth[sizes[d][runs[d]] <= REGION] = d
        equal = sizes[VALUES][runs[VALUES]]
        for d in range(LEAST, VALUES + 1):
            own = np.flatnonzero((depth == d) | (d == SHALLOW))
            order = np.lexsort((np.arange(len(rows)), -equal, runs[d]))
            hubs = order[np.searchsorted(runs[d][order], np.arange(runs[d][-1] + 1))]
            pairs.append((ids[hubs[runs[d][own]]], ids[own]))
            if d == SHALLOW:
                if first >= SHALLOW:
                    pairs.append((np.array([hub]), ids[hubs[:1]]))
                hub = hub if first >= SHALLOW and runs[d][-1] == 0 else ids[hubs[-1]]
        last = rows[-1:]
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        some = a != b
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[some]), pa.array(np.maximum(a, b)[some])], ["a", "b"])


def _shingler(shingle_words: int):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.released(batches):
            for a, b, data, offsets in textops.chunks(batch.column(1)):
                sets = list(textops.shingle_sets(data, offsets, shingle_words))
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets)
                name = np.array([int(textops.mixed(s ^ np.uint64(0xA5A5)).sum().view(np.int64)) if len(s) else 0 for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(name), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], ["id", "one", "shingles"])

    return shingle


def _prefixer(shingle_words: int, percent: int, common):
    """Each text's prefix among the shingles that are not common, and among its common ones if they may suffice."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = common.value
        for batch in textops.released(batches):
            for a, b, data, offsets in textops.chunks(batch.column(1)):
                rows = []
                for own in textops.shingle_sets(data, offsets, shingle_words):
                    n, at = len(own), np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                    often = known[at] == own if len(known) else np.zeros(n, bool)
                    least = -(-percent * n // 100)
                    keep = min(n, n - least + 1)
                    other, shared = own[~often], np.sort(ranks[at[often]])
                    # Flipped, so that signed numbers have the order of the unsigned ones.
                    head = (other[:keep] ^ np.uint64(1 << 63)).view(np.int64)
                    end = int(head[-1]) if len(other) >= keep and keep else _LAST
                    top = shared[: len(shared) - least + 1] if len(shared) >= least else shared[:0]
                    one, two = (int(textops.mixed(x).sum().view(np.int64)) for x in (own[often] ^ np.uint64(0xA5A5), own[often] + np.uint64(0x1234567)))
                    rows.append((n, head, n - len(head), end, top, shared if len(top) else top, len(shared), one, two))
                columns = list(zip(*rows))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[i]])]).astype(np.int32)), pa.array(np.concatenate(columns[i]).astype(np.int64))) for i in (1, 4, 5)]
                numbers = [pa.array(columns[i], pa.int64()) for i in (0, 2, 3, 6, 7, 8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists, *numbers], ["id", "head", "top", "common", "n", "rest", "end", "n_common", "one", "two"])

    return prefix


def _candidates(orders: DataFrame) -> DataFrame:
    """a < b: neighbours and hubs in each of the sorted signature orders (tree, first, second, id)."""
    keys = ["tree", "first", "second", "id"]
    return orders.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_neighbours, "a long, b long").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those with 100 * intersection >= percent * union on the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    sizes = F.size("left") + F.size("right")
    met = pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(100 * F.least(F.size("left"), F.size("right")) >= percent * F.greatest(F.size("left"), F.size("right")))
    return met.filter(100 * both >= percent * (sizes - both)).select("a", "b")


def _common(texts: DataFrame, nodes: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in about COMMON texts or more, sorted, and their ranks from the rarest on."""
    often = max(COMMON, nodes.count() // SPREAD)
    some = sized(written(nodes.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(often)) < SEEN).select("doc_id"), "sampled"))
    counts = texts.join(some, "doc_id", "left_semi").mapInArrow(_shingler(shingle_words), "id long, one long, shingles array<long>")
    found = counts.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN).toPandas()
    shingles, n = found["s"].to_numpy(dtype=np.int64).view(np.uint64), found["n"].to_numpy(dtype=np.int64)
    ranks = np.empty(len(n), dtype=np.int64)
    ranks[np.lexsort((shingles, n))] = np.arange(len(n))
    order = np.argsort(shingles)
    return shingles[order], ranks[order]


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """a < b, c: how many of the ``members`` (arrays of id, shift to its component and n) hold a pair of two components and
    of sizes that may link."""
    pairs = lists.select("members", F.explode("members").alias("x"))
    other = F.filter("members", lambda y: (y["id"] > F.col("x.id")) & (y["id"] + y["shift"] != F.col("x.id") + F.col("x.shift")) & (100 * F.least(y["n"], F.col("x.n")) >= percent * F.greatest(y["n"], F.col("x.n"))))
    pairs = pairs.select(F.col("x.id").alias("a"), F.explode(F.transform(other, lambda y: y["id"])).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def _reaching(met: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Of ``met`` those that can still reach the threshold: beyond the earlier prefix end, one text's rest may be shared."""
    for side in ("a", "b"):
        met = met.join(facts.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("rest").alias(f"rest{side}"), F.col("end").alias(f"end{side}")), side)
    rest = F.when(F.col("enda") < F.col("endb"), F.col("resta")).when(F.col("enda") > F.col("endb"), F.col("restb")).otherwise(F.least("resta", "restb"))
    return met.filter((100 + percent) * (F.col("c") + rest) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _crowds(firsts: DataFrame) -> DataFrame:
    """crowd, component, id, n, common: texts that share a shingle of ``top`` that stands in several components are in one
    crowd; texts without one are in none, as nothing outside their component can link with them by common shingles alone.

    Crowds are components of shingles, linked where they follow each other in a text's ``top``; only these links, which are
    few where many texts have them, are shuffled."""
    spots = firsts.select("id", "component", F.explode("top").alias("s"))
    live = spots.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("s")
    kept = spots.join(sized(written(live, "live")), "s", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("live"))
    firsts = written(firsts.drop("top").join(kept, "id"), "live-texts")
    after = F.arrays_zip(F.slice("live", 1, F.size("live") - 1).alias("a"), F.slice("live", 2, F.size("live") - 1).alias("b"))
    shingles = components(firsts.filter(F.size("live") > 1).select(F.explode(after).alias("x")).select("x.a", "x.b").distinct())
    named = firsts.withColumn("node", F.col("live")[0]).join(shingles.withColumnRenamed("component", "crowd"), "node", "left")
    return named.select(F.coalesce("crowd", "node").alias("crowd"), "component", "id", "n", "common")


def _cell(percent: int):
    def cell(rows: pa.Table) -> pa.Table:
        """Components of a cell's texts that links join, as a spanning tree of each group of them."""
        sizes = rows.column("n").to_numpy()
        names, own = np.unique(rows.column("component").to_numpy(), return_inverse=True)
        if len(names) == 1:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        lists = rows.column("common").combine_chunks()
        flat, text = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), np.diff(lists.offsets.to_numpy()))
        _, column = np.unique(flat, return_inverse=True)
        both = np.zeros((len(sizes), len(sizes)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        text, column = text[order], column[order]
        for a in range(0, int(column[-1]) + 1, COLUMNS):
            low, high = np.searchsorted(column, (a, a + COLUMNS))
            part = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
            part[text[low:high], column[low:high] - a] = 1
            both += part @ part.T
        joined = np.zeros((len(names), len(names)), dtype=bool)
        for i in range(0, len(sizes), 64):
            left, right = np.nonzero((100 + percent) * both[i : i + 64].astype(np.int64) >= percent * (sizes[i : i + 64, None] + sizes[None]))
            joined[own[i + left], own[right]] = True
        seen, edges = np.zeros(len(names), dtype=bool), []
        for start in range(len(names)):
            reached = [] if seen[start] else [start]
            seen[start] = True
            while reached:
                at = reached.pop()
                new = np.flatnonzero(joined[at] & ~seen)
                seen[new] = True
                reached += new.tolist()
                edges += [(names[at], names[i]) for i in new.tolist()]
        a, b = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def released(rows: pa.Table) -> pa.Table:
        found = cell(rows)
        textops.release()
        return found

    return released


def _bridges(crowds: DataFrame, percent: int) -> DataFrame:
    """a, b: components that links by common shingles alone join, enough of them to join all that are.

    A crowd is cut into blocks of bounded texts and shingles, a large component into blocks of its own, and two blocks meet
    in one task unless they are of one component; a task counts what all its texts share as a matrix product and gives no
    pairs of texts, only a tree of components."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_TEXTS), F.ceil(F.sum(F.size("common")) / CELL_SHINGLES))
    large = crowds.groupBy("crowd", "component").agg(parts.alias("own_parts")).filter("own_parts > 1").withColumn("large", F.col("component"))
    named = crowds.join(sized(written(large, "large")), ["crowd", "component"], "left").withColumn("large", F.coalesce("large", F.lit(_LAST)))
    rest = named.filter(F.col("large") == _LAST).groupBy("crowd").agg(parts.alias("parts"))
    named = named.join(sized(written(rest, "rest")), "crowd", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("own_parts", "parts")))
    blocks = named.select("crowd", "large", "salt").distinct()
    blocks = written(blocks.withColumn("block", F.row_number().over(Window.partitionBy("crowd").orderBy("large", "salt"))), "blocks")
    others = blocks.select("crowd", F.col("large").alias("other"), F.col("block").alias("met"))
    placed = named.join(sized(blocks), ["crowd", "large", "salt"]).join(sized(others), "crowd").filter((F.col("large") == _LAST) | (F.col("large") != F.col("other")))
    cells = placed.select("crowd", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), "component", "n", "common")
    return cells.groupBy("crowd", "low", "high").applyInArrow(_cell(percent), "a long, b long")


def _missed(texts: DataFrame, nodes: DataFrame, joined: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """a, b: links of ``nodes`` (doc_id) whose components in ``joined`` differ, enough of them to connect all that are linked."""
    spark = texts.sparkSession
    # Spark deletes shuffle files once the driver has collected their plans; the forest's are not read again.
    spark.sparkContext._jvm.System.gc()
    common = spark.sparkContext.broadcast(_common(texts, nodes, shingle_words))
    schema = "id long, head array<long>, top array<long>, common array<long>, n long, rest long, end long, n_common long, one long, two long"
    heads = texts.join(sized(nodes), "doc_id", "left_semi").mapInArrow(_prefixer(shingle_words, percent, common), schema)
    heads = heads.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = heads_table = written(heads, "prefixes")
    again = written(heads.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"), "repeated")
    if not again.isEmpty():
        again = sized(again)
        heads = heads.join(again, "id", "left_anti").union(heads.join(again, "id", "left_semi").select(*heads.columns).distinct())
    member = F.struct("id", "shift", "n")
    # Dealt as plain rows of small numbers, which take less disk than partial lists of one text each.
    lists = heads.select("id", (F.col("component") - F.col("id")).alias("shift"), "n", F.explode("head").alias("s")).repartition("s").groupBy("s").agg(F.collect_list(member).alias("members"), F.min(F.col("id") + F.col("shift")).alias("low"), F.max(F.col("id") + F.col("shift")).alias("high")).filter("low <> high")
    pairs = _reaching(_met(lists, percent), heads.select("id", "n", "rest", "end"), percent)

    # By common shingles alone: whoever reaches the threshold with any text of its common set does so with the smallest.
    full = heads.filter(F.size("top") > 0)
    least = written(full.groupBy("one", "two", "n_common").agg(F.min(F.struct("n", "id")).alias("s")).select("one", "two", "n_common", F.col("s.n").alias("least_n"), F.col("s.id").alias("least")), "common-sets")
    stars = full.select("id", "n", "one", "two", "n_common").join(least, ["one", "two", "n_common"]).filter("id <> least")
    stars = stars.filter((100 + percent) * F.col("n_common") >= percent * (F.col("n") + F.col("least_n"))).select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b"))
    firsts = full.join(least.select(F.col("least").alias("id")), "id", "left_semi").select("id", "component", "n", "common", "top")
    crowds = written(_crowds(firsts), "crowds")
    bridges = _bridges(crowds, percent)

    pairs = written(pairs.distinct(), "missed")
    wanted_table = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "missed-ids")
    sets = texts.join(sized(wanted_table), "doc_id", "left_semi").mapInArrow(_shingler(shingle_words), "id long, one long, shingles array<long>").dropDuplicates(["id", "one"])
    parts = {side: joined.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")) for side in ("a", "b")}
    stars = stars.join(parts["a"], "a", "left").join(parts["b"], "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    links = written(_linked(pairs, sets, percent).union(stars).union(bridges), "missed-links")
    discarded(heads_table, least, crowds, pairs, wanted_table)
    return links


def near_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    texts = texts_of(docs.select("doc_id", "text"))
    signed = written(texts.mapInArrow(_signer(shingle_words, trees), "doc_id long, n_shingles long, one long, two long, keys array<long>"), "signatures")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("one", "two", "n_shingles").agg(F.min(F.struct("doc_id", "keys")).alias("rep"))
    classes = written(classes.select("one", "two", "n_shingles", F.col("rep.doc_id").alias("rep"), F.col("rep.keys").alias("keys")), "classes")
    order = F.expr(f"transform(sequence(0, {trees - 1}), t -> struct(t AS tree, keys[2 * t] AS first, keys[2 * t + 1] AS second))")
    pairs = written(_candidates(classes.select(F.col("rep").alias("id"), F.explode(order).alias("o")).select("o.*", "id")), "candidates")
    paired = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "paired")
    sets = written(texts.join(sized(paired), "doc_id", "left_semi").mapInArrow(_shingler(shingle_words), "id long, one long, shingles array<long>").dropDuplicates(["id", "one"]), "shingles")
    links = written(_linked(pairs, sets, percent), "links")
    discarded(pairs, paired, sets)
    joined = components(links)
    missed = _missed(texts, classes.select(F.col("rep").alias("doc_id")), joined, shingle_words, percent)
    if not missed.isEmpty():
        joined = components(links.union(missed))
    reps = classes.select("one", "two", "n_shingles", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    reps = written(reps.select("one", "two", "n_shingles", F.coalesce("component", "rep").alias("component")), "class-components")
    discarded(links, missed, classes)
    out = signed.select("doc_id", "n_shingles", "one", "two").join(reps, ["one", "two", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
