"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of characters. All distinct blocks are sorted and named by
integers; then adjacent names are paired and the distinct pairs sorted and named again, until each document holds one
name. Equal (number of blocks, name) means equal text. A text of n blocks takes log2(n) levels.

The order is that of a 64-bit hash and then of the value itself, so that a name is a place in one order of all values,
the same however Spark deals them out. The distinct blocks are found on their whole texts; rows then look their names up
by the hash, with the text too where blocks share a hash, so that texts are shuffled once (each block once a task) and no
collision can join two texts. All other exchanges carry numbers. Lookups are joins of written tables, whose hot keys Spark's adaptive skew join splits.

Defined results: a null text is the empty text; the row with the largest doc_id of a group stays, and of rows that
repeat that doc_id too, exactly one; a null doc_id ranks below all others; other columns, whatever their names, are
ignored; a long text only has more blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.shared import numbered, sized, written

BLOCK_CHARS = 4096


def folded(text: Column) -> Column:
    """The text with A-Z (and no other letters) in lower case; null becomes empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _hashed(*values: str) -> Column:
    return F.xxhash64(*values)


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """The distinct rows ``keys`` (hash and ``by``) with ``name``: the place of each in the order of hash and ``by``."""
    return numbered(keys.select("hash", *by), "hash", *by).withColumnRenamed("place", "name")


def _block_names(blocks: DataFrame) -> DataFrame:
    """``blocks`` (block and others) with ``name`` in place of ``block``."""
    hashed = blocks.withColumn("hash", _hashed("block"))
    keys = written(hashed.groupBy("hash", "block").agg(F.count(F.lit(1)).alias("rows")).select("hash"), "block-hashes")
    shared = written(keys.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "shared-hashes")
    if shared.isEmpty():
        keys, hashed = keys.withColumn("turn", F.lit(0)), hashed.withColumn("turn", F.lit(0))
    else:
        # Distinct texts of one hash take turns in their own order.
        texts = hashed.join(sized(shared.select("hash")), "hash", "left_semi").select("hash", "block").distinct()
        texts = written(texts.withColumn("turn", F.row_number().over(Window.partitionBy("hash").orderBy("block")) - 1), "shared-texts")
        keys = keys.join(sized(shared.select("hash")), "hash", "left_anti").withColumn("turn", F.lit(0)).unionByName(texts.select("hash", "turn"))
        hashed = hashed.join(sized(texts), ["hash", "block"], "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    return hashed.drop("block").join(_named(keys, ["turn"]), ["hash", "turn"]).drop("hash", "turn")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    text = folded(F.col("text"))
    blocks = F.when(F.length("body") <= block_chars, F.array("body")).otherwise(F.regexp_extract_all("body", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    cut_up = docs.select("doc_id", text.alias("body")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("body", 256).alias("sha"), blocks.alias("blocks"))
    cut_up = cut_up.select("row", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    cut_up = cut_up.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha"))).withColumn("left", F.col("n"))
    level = written(_block_names(cut_up), "block-names")
    most = level.agg(F.max("n")).first()[0] or 1
    done = level.filter("left = 1")
    for _ in range((most - 1).bit_length()):
        pairs = (
            level.filter("left > 1")
            .groupBy("row", "n", F.expr("pos div 2").cast("int").alias("pos"), F.ceil(F.col("left") / 2).cast("int").alias("left"))
            .agg(
                F.max("doc_id").alias("doc_id"),
                F.max("sha").alias("sha"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
            )
        )
        pairs = written(pairs.withColumn("hash", _hashed("first", "second")), "pairs")
        names = _named(pairs.select("hash", "first", "second").distinct(), ["first", "second"])
        level = written(pairs.join(names, ["hash", "first", "second"]).drop("hash", "first", "second"), "pair-names")
        done = done.unionByName(level.filter("left = 1"))
    groups = written(done.groupBy("n", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")), "text-groups")
    return done.join(groups, ["n", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
