"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at ``CEILING``
times its source's words and the excess is shared again by weight. Within a source each document is expected
``target / source words`` times. Documents stand by falling size, so that the words taken stay within one longest
document of the target; the expected copies are prefix-summed along that order, one random offset (seeded by the
source's name) is added, and a document is emitted once for each integer boundary its interval crosses.

As all documents of a source are expected equally often, the prefix sum is the document's place in its source times that
number. Places come from one range partitioning of all rows by source, size and doc_id, and one number for each source
in each partition, so a source of any size is spread over many tasks.

Defined results: a null or empty text has size 0 and is taken 0 words; null sources are one source, the last; a null
doc_id sorts before the others of its size; rows that repeat a doc_id are rows of their own, in the order of their texts'
hashes; a long text counts whole; an empty table gives an empty one. ``mix`` reads doc_id, text and source and ignores
other columns; ``emitted`` gives all columns back as they came, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.shared import numbered, sized, written

CEILING = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, size), written.

    The shares are a water level: every source gets ``least(weight * level, cap)``. The level that spends all words rises
    from the one without caps, each time by what the sources at their caps leave, until no other source reaches its cap.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = written(numbered(sources, F.col("source").asc_nulls_last()).select("source", "source_size", (F.col("place") % 3 + 1).alias("weight")), "sources")
    cap, level, capped = CEILING * F.col("source_size"), 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = weighed.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if row[3] == capped:
            break
        capped, level = row[3], ((row[0] or 0) - (row[1] or 0)) / row[2] if row[2] else level
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def offset(source):
    """A number in [0, 1) that only depends on the source and the seed."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _placed(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row, with ``row`` (all columns of ``docs``) if ``whole``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    own = docs.select(*row, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    if not whole:
        own = written(own, "sizes")  # so that texts are read once
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    # Rows equal in all else differ in the last key, so they too are dealt to many tasks; which is which makes no difference.
    own = own.withColumn("key", key).withColumn("dealt", F.monotonically_increasing_id())
    order = [F.col("key"), F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("dealt")]
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "dealt").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered, "ordered").withColumn("part", F.shiftright("at", 33))
    spans = written(ordered.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"), F.first("source").alias("source")), "spans")
    shares = targets(spans.select("source", F.col("words").alias("size"))).withColumn("key", key).drop("source")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("key", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift")).join(shares, "key")
    placed = ordered.join(sized(written(spans, "shifts")), ["key", "part"])
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    at = F.col("at") + F.col("shift")
    copies = F.floor((at + 1) * rate + offset(F.col("source"))) - F.floor(at * rate + offset(F.col("source")))
    return placed.select(*["row"] * whole, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs`` (doc_id, text, source); 0 copies too."""
    return _placed(docs, False)


def emitted(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves, one row for each copy, with the columns of ``docs`` as they are."""
    chosen = _placed(docs, True).filter("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
      coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
      sum(source_size) OVER () AS total FROM s),
t AS (SELECT source, source_size, least(weight * (max((total - below)::DOUBLE / above) OVER ()), (3 * source_size)::DOUBLE) AS target,
      ('0x' || substr(md5('{SEED}' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
      row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(i * rate + u) - floor((i - 1) * rate + u)) * size)::BIGINT AS taken FROM r
"""
