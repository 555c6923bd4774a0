"""Merkle dataset manifest by bitmap-rank indexing.

Every row is a leaf of its source's tree, and the sources' roots are the leaves of one more tree; a node is the digest of
``RUN`` children in a row. Where a leaf stands is not found by sorting leaves. Each source's doc_ids are a compressed bitmap:
only the 64-bit words that hold an id are kept, merged from the tasks' own words by a bitwise or. A popcount directory counts
the rows before each word: containers of ``FAN`` words, containers of ``FAN`` such containers, and so on up to one a source,
each a prefix sum of at most ``FAN`` numbers. A leaf's place is the directory's number of its word and the popcount of the
word's lower bits. Leaves then go to the slots of arrays keyed by (source, place / 256), and an array of 256 slots is reduced
by two levels where it stands, so a shuffle carries a 256th of the nodes of the one before. Paths of siblings go down again
one for each array, and a leaf adds those of its own array.

Defined results: a null source is a source of its own, before all others; null fields count as ``-``; rows with a null doc_id
come first in their source; rows that share a doc_id stand in the order of their leaves, and rows equal in all fields in
either order; long texts are digested whole; an empty table has no rows (and no root); other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.dedup_exact import folded
from stepforge.llm.shared import discarded, numbered, written

RUN = 16
#: Slots of an array: two levels of the tree.
ARRAY_BITS = 8
#: Words (or containers) of a container of the directory, as a power of 2.
FAN_BITS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The word of rows without a doc_id: before those of all 64-bit ids.
NAMELESS = -(1 << 57) - 1


def digest(text: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(text, 256)


def _part(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """A row's leaf with ``text`` in the place of its text."""
    return digest(F.concat(*[_part(text if c == "text" else F.col(c)) for c in FIELDS]))


def tampered() -> Column:
    """Whether a row's text is lower-cased in the test of tampering."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _leaves(docs: DataFrame) -> DataFrame:
    """name (of the source: empty for null, else with s before it), doc_id, leaf, changed (the leaf of the tampered row), the
    word and bit of the doc_id and a number of the row."""
    lower = F.when(F.col("text").isNotNull(), folded(F.col("text")))
    rows = docs.select(*[F.col(c) for c in FIELDS]).withColumn("row", F.monotonically_increasing_id())
    return rows.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("name"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("text")).alias("leaf"),
        F.when(tampered(), leaf(lower)).alias("changed"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 6), F.lit(NAMELESS)).alias("word"),
        F.coalesce(F.col("doc_id").cast("long").bitwiseAND(F.lit(63)).cast("int"), F.lit(64)).alias("bit"),
        "row",
    )


def bitmaps(leaves: DataFrame) -> DataFrame:
    """name, word, bits, held: the words of each source's bitmap, and the rows of each word."""
    bits = F.expr("bit_or(CASE WHEN bit < 64 THEN shiftleft(1L, bit) ELSE 0L END)")
    return leaves.groupBy("name", "word").agg(bits.alias("bits"), F.count(F.lit(1)).alias("held"))


def directory(words: DataFrame) -> DataFrame:
    """name, word, before: the rows of the source before each word."""
    low, high = words.agg(F.min("word"), F.max("word")).first()
    return _before(words.select("name", "word", "held"), low or 0, high or 0)


def _before(counts: DataFrame, low: int, high: int) -> DataFrame:
    earlier = lambda *by: F.coalesce(F.sum("held").over(Window.partitionBy(*by).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if high - low < 1 << FAN_BITS:
        return counts.select("name", "word", earlier("name").alias("before"))
    own = counts.withColumn("up", F.shiftright("word", FAN_BITS))
    containers = own.groupBy("name", F.col("up").alias("word")).agg(F.sum("held").alias("held"))
    above = _before(containers, low >> FAN_BITS, high >> FAN_BITS).select("name", F.col("word").alias("up"), F.col("before").alias("above"))
    inside = own.withColumn("inside", earlier("name", "up"))
    return inside.join(above, ["name", "up"]).select("name", "word", (F.col("inside") + F.col("above")).alias("before"))


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (a written table) with ``idx``, the place of each in its source."""
    words = written(bitmaps(leaves), "bitmap-words")
    ranked = words.join(directory(words), ["name", "word"])
    crowded = words.filter("held <> bit_count(bits)").select("name", "word")
    shared = leaves.join(crowded, ["name", "word"], "left_semi").groupBy("name", "word", "bit").agg(F.count(F.lit(1)).alias("n"))
    shared = written(shared.filter("n > 1 OR bit = 64"), "shared-ids")
    lower = F.expr("bit_count(bits & ~shiftleft(-1L, bit))").cast("long")
    if shared.isEmpty():
        return leaves.join(ranked, ["name", "word"]).select("name", "doc_id", "leaf", "changed", (F.col("before") + lower).alias("idx"))
    # A word has at most 64 ids with more than one row.
    more = shared.groupBy("name", "word").agg(F.collect_list(F.struct("bit", (F.col("n") - 1).alias("more"))).alias("extra"))
    ranked = ranked.join(more, ["name", "word"], "left")
    extra = F.expr("aggregate(filter(coalesce(extra, array()), x -> x.bit < bit), 0L, (s, x) -> s + x.more)")
    tied = numbered(leaves.join(shared, ["name", "word", "bit"], "left_semi"), "name", "word", "bit", "leaf", "row")
    first = tied.groupBy("name", "word", "bit").agg(F.min("place").alias("first"))
    turns = tied.join(first, ["name", "word", "bit"]).withColumn("turn", F.col("place") - F.col("first")).drop("place", "first")
    alone = leaves.join(shared, ["name", "word", "bit"], "left_anti").withColumn("turn", F.lit(0).cast("long"))
    every = alone.unionByName(turns).join(ranked, ["name", "word"])
    own = F.when(F.col("bit") < 64, lower + extra).otherwise(0)
    return every.select("name", "doc_id", "leaf", "changed", (F.col("before") + own + F.col("turn")).alias("idx"))


def _arrays(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """name, array, slots (slot, hash and ``carried``), runs (the nodes a level up) and top (the node two levels up) of
    ``nodes`` (name, idx, hash). A source's only array has as many levels as its slots need."""
    slot = F.struct((F.col("idx") % (1 << ARRAY_BITS)).cast("int").alias("slot"), "hash", *carried)
    arrays = nodes.groupBy("name", F.shiftright("idx", ARRAY_BITS).alias("array")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    hashes = F.transform("slots", lambda x: x["hash"])
    depth = F.when(F.col("array") > 0, 2).when(F.size("slots") == 1, 0).when(F.size("slots") <= RUN, 1).otherwise(2)
    arrays = arrays.withColumn("hashes", hashes).withColumn("depth", depth)
    runs = F.expr(f"transform(sequence(0, (size(hashes) - 1) div {RUN}), j -> sha2(array_join(slice(hashes, cast(j * {RUN} + 1 as int), {RUN}), ''), 256))")
    arrays = arrays.withColumn("runs", F.when(F.col("depth") > 0, runs).otherwise(F.array().cast("array<string>")))
    top = F.when(F.col("depth") == 0, F.col("hashes")[0]).when(F.col("depth") == 1, F.col("runs")[0]).otherwise(digest(F.array_join("runs", "")))
    return arrays.withColumn("top", top).drop("hashes")


def _tree(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The written arrays of each two levels, up to one array a name."""
    levels = [written(_arrays(nodes, carried), "manifest-arrays")]
    while (levels[-1].agg(F.max("array")).first()[0] or 0) > 0:
        nodes = levels[-1].select("name", F.col("array").alias("idx"), F.col("top").alias("hash"))
        levels.append(written(_arrays(nodes, []), "manifest-arrays"))
    return levels


#: Siblings of slot i on its one or two levels in the array.
_OWN = f"""CASE WHEN depth = 0 THEN array() WHEN depth = 1 THEN array(named_struct('l', {{left}}, 'r', {{right}}))
    ELSE array(named_struct('l', {{left}}, 'r', {{right}}), named_struct('l', array_join(slice(runs, 1, run), ''), 'r', array_join(slice(runs, run + 2, {RUN}), ''))) END""".format(
    left=f"array_join(slice(hashes, run * {RUN} + 1, s.slot - run * {RUN}), '')", right=f"array_join(slice(hashes, s.slot + 2, {RUN - 1} - s.slot + run * {RUN}), '')"
)


def _slots(arrays: DataFrame, above: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each slot, with ``path``: the siblings left and right of it and of the nodes above it, level by level.

    above: name, array, path and ``fields``."""
    rows = arrays.join(above, ["name", "array"]).withColumn("hashes", F.transform("slots", lambda x: x["hash"]))
    rows = rows.select("name", "array", "runs", "depth", "hashes", F.col("path").alias("upper"), *fields, F.explode("slots").alias("s"))
    rows = rows.withColumn("run", F.floor(F.col("s.slot") / RUN).cast("int"))
    return rows.withColumn("path", F.concat(F.expr(_OWN), "upper")).withColumn("idx", F.col("array") * (1 << ARRAY_BITS) + F.col("s.slot"))


def _down(levels: list[DataFrame], above: DataFrame, fields: list[str]) -> DataFrame:
    """The slots of the lowest of ``levels``; above: the path over each name's only array of the highest."""
    for arrays in reversed(levels[1:]):
        above = _slots(arrays, above, fields).select("name", F.col("idx").alias("array"), "path", *fields)
    return _slots(levels[0], above, fields)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; docs: ``FIELDS``."""
    leaves = written(_leaves(docs), "manifest-leaves")
    sources = _tree(placed(leaves).withColumnRenamed("leaf", "hash"), ["doc_id", "changed"])
    discarded(leaves)
    ends = numbered(sources[-1].select("name", "top"), "name")
    whole = _tree(ends.select(F.lit("").alias("name"), F.col("place").alias("idx"), F.col("top").alias("hash"), F.col("name").alias("of")), ["of"])
    found = whole[-1].select("top").first()  # one array in all
    root = F.lit(found["top"] if found else None).cast("string")
    empty = F.array().cast("array<struct<l:string,r:string>>")
    roots = _down(whole, whole[-1].select("name", "array", empty.alias("path")), [])
    subroots = roots.select(F.col("s.of").alias("name"), F.lit(0).cast("long").alias("array"), "path", F.col("s.hash").alias("subroot"))
    rows = _down(sources, subroots, ["subroot"])
    proof = digest(F.aggregate("path", F.lit(""), lambda a, p: F.concat(a, p["l"], p["r"])))
    fold = F.aggregate("path", F.coalesce("s.changed", "s.hash"), lambda a, p: digest(F.concat(p["l"], a, p["r"])))
    out = rows.select(F.col("s.doc_id").alias("doc_id"), F.col("s.hash").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_PARTS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: xor(t >> 1, (t & 1) * 3988292384)), 4294967295), 4294967295)"
#: DuckDB: trees level by level, siblings by joins, and folds step by step. For distinct doc_ids.
ORACLE_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce('s' || source, '') AS src, sha256({_PARTS}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_PARTS.replace("text::", f"translate(text, {_AZ})::")}) END AS changed FROM documents),
s AS (SELECT 0 AS lev, src, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST) - 1 AS idx, leaf AS hash, count(*) OVER (PARTITION BY src) AS n, doc_id FROM l
    UNION ALL SELECT lev + 1, src, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(n) + 15) // 16, NULL FROM s WHERE n > 1 GROUP BY lev, src, idx // 16),
ends AS (SELECT src, hash FROM s WHERE n = 1),
r AS (SELECT 0 AS lev, row_number() OVER (ORDER BY src) - 1 AS idx, hash, count(*) OVER () AS n, src FROM ends
    UNION ALL SELECT lev + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(n) + 15) // 16, NULL FROM r WHERE n > 1 GROUP BY lev, idx // 16),
a AS (SELECT doc_id, src, idx, 1 + lev AS step, idx >> (4 * lev)::BIGINT AS own, lev FROM (SELECT doc_id, src, idx, n FROM s WHERE lev = 0) x, (SELECT DISTINCT lev FROM s) v WHERE EXISTS (SELECT 1 FROM s WHERE s.src = x.src AND s.lev = v.lev AND s.n > 1)),
b AS (SELECT x.src, 100 + lev AS step, x.idx >> (4 * lev)::BIGINT AS own, lev FROM (SELECT src, idx FROM r WHERE lev = 0) x, (SELECT DISTINCT lev FROM r WHERE n > 1) v),
steps AS (SELECT a.doc_id, a.src, step, coalesce(string_agg(hash, '' ORDER BY s.idx) FILTER (s.idx < own), '') AS lft, coalesce(string_agg(hash, '' ORDER BY s.idx) FILTER (s.idx > own), '') AS rgt
        FROM a JOIN s ON s.src = a.src AND s.lev = a.lev AND s.idx // 16 = own // 16 GROUP BY a.doc_id, a.src, step
    UNION ALL SELECT l.doc_id, l.src, u.step, u.lft, u.rgt FROM l JOIN (SELECT b.src, step, coalesce(string_agg(hash, '' ORDER BY r.idx) FILTER (r.idx < own), '') AS lft, coalesce(string_agg(hash, '' ORDER BY r.idx) FILTER (r.idx > own), '') AS rgt
        FROM b JOIN r ON r.lev = b.lev AND r.idx // 16 = own // 16 GROUP BY b.src, step) u ON u.src = l.src),
o AS (SELECT doc_id, lft, rgt, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS turn, step FROM steps),
f AS (SELECT doc_id, 0 AS turn, coalesce(changed, leaf) AS h FROM l UNION ALL SELECT f.doc_id, f.turn + 1, sha256(o.lft || f.h || o.rgt) FROM f JOIN o ON o.doc_id = f.doc_id AND o.turn = f.turn + 1),
g AS (SELECT doc_id, arg_max(h, turn) AS folded_root FROM f GROUP BY 1), p AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY turn)) AS proof_sha256 FROM o GROUP BY 1),
t AS (SELECT hash AS root FROM r WHERE n = 1 ORDER BY lev DESC LIMIT 1)
SELECT l.doc_id, leaf, ends.hash AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM l JOIN ends USING (src) JOIN g USING (doc_id) LEFT JOIN p USING (doc_id), t"""
