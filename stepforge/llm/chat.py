"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue (each distinct speaker but the system), the dialogue is rendered with that speaker
as the assistant and all others as named users; the mask marks the assistant's contents (and their end marks), which
are the only trained characters of that rendering. A rendering is one string with the spans of its mask.

A rendering that is longer than ``part_chars`` comes in several rows: its parts, of whole turns, make the rendering when
they are joined in order, and each part's spans count from its own start. So no group is collected beyond that bound and
one turn more, however long a dialogue is. Turns are put in order by a range partitioning of all rows and placed by
prefix sums in two levels (runs of ``RUN`` rows, rows of a run), so a dialogue that holds a third of all turns is spread
over many tasks. All steps are DataFrame operations.

Defined results: turns sort by number (null first), then speaker and text; a null speaker is ``unknown``; a null text is
empty; repeated rows are turns of their own; a null conversation is one conversation; a dialogue with only system turns
has no participant and no rendering; an empty table gives no rendering; other columns, whatever their names, are
ignored. ``<|`` in contents and names, and ``|>`` and line feeds in names, are written apart (a zero-width space between
the two characters, a space), so that neither ever makes a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.shared import written

PART_CHARS = 1 << 20
RUN = 1024
SYSTEM = "system"
HEAD_ASSISTANT = "<|assistant|>\n"
HEAD_SYSTEM = "<|system|>\n"
END = "<|end|>\n"


def _apart(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit("​".join(mark)))


def rotate(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, speaker, n_turns, rendered, mask (array of start, length in characters)."""
    role = F.coalesce("role", F.lit("unknown"))
    clean = turns.select("conv_id", "turn", role.alias("role"), _apart(F.coalesce("text", F.lit("")), "<|").alias("text"))
    name = F.replace(_apart(_apart(F.col("role"), "<|"), "|>"), F.lit("\n"), F.lit(" "))
    mine = F.lit(HEAD_ASSISTANT)
    other = F.when(F.col("role") == SYSTEM, F.lit(HEAD_SYSTEM)).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    clean = clean.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))).withColumn("other", other)
    clean = clean.withColumn("size", (F.length("other") + F.length("text") + len(END)).cast("long"))
    # Equal rows differ in the last key alone, so they too are dealt to many tasks; which is which makes no difference.
    order = ["conv_id", "turn", "role", "text", "dealt"]
    dealt = clean.withColumn("dealt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("dealt")
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.floor(F.col("at") / RUN)), "turns")

    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("conv", "run").agg(F.sum("size").alias("chars")).withColumn("before_run", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    runs = written(runs.select("conv", "run", "before_run"), "runs")
    inside = Window.partitionBy("conv", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(runs, ["conv", "run"]).withColumn("before", F.col("before_run") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.withColumn("part", F.floor(F.col("before") / part_chars))

    #: A turn's contents begin, in its own speaker's rendering, after all turns before it, of which those of that speaker
    #: have the assistant's head. Both windows and the grouping use one partitioning.
    of_part = Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv", "part", "role").orderBy("at")
    start = F.coalesce(F.sum("size").over(of_part), F.lit(0)) + (F.row_number().over(own) - 1) * (F.length(mine) - F.length("other")) + F.length(mine)
    placed = placed.withColumn("start", start.cast("int")).withColumn("length", (F.length("text") + len(END)).cast("int"))
    parts = placed.groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("at", "role", "text", "start", "length", "other"))).alias("turns"))
    speakers = clean.select("conv", F.col("role").alias("speaker")).filter(F.col("speaker") != SYSTEM).distinct()
    rows = written(parts, "parts").join(written(speakers, "speakers"), "conv")
    rendered = F.array_join(F.transform("turns", lambda x: F.concat(F.when(x.role == F.col("speaker"), mine).otherwise(x.other), x.text, F.lit(END))), "")
    mask = F.transform(F.filter("turns", lambda x: x.role == F.col("speaker")), lambda x: F.struct(x.start.alias("start"), x["length"].alias("length")))
    return rows.select("conv_id", "part", "speaker", F.size("turns").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))


def digests(rendered: DataFrame) -> DataFrame:
    """What identifies a rendering: its size, the trained characters and spans, and digests of the text and the mask."""
    spans = F.expr("array_join(transform(mask, m -> concat(m.start, ':', m.length)), ',')")
    return rendered.select(
        "conv_id",
        "part",
        "speaker",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.length("rendered").cast("long").alias("n_chars"),
        F.expr("aggregate(mask, 0L, (s, m) -> s + m.length)").alias("trained_chars"),
        spans.alias("mask_spans"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text FROM conversations),
h AS (SELECT *, CASE WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || replace(replace(replace(role, '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>'), chr(10), ' ') || '|>' || chr(10) END AS other,
             text || '<|end|>' || chr(10) AS body FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM h),
b AS (SELECT *, coalesce(sum(length(other) + length(body)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {PART_CHARS} AS part FROM o),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT b.*, s.speaker, CASE WHEN b.role = s.speaker THEN '<|assistant|>' || chr(10) ELSE other END AS head FROM b JOIN s ON b.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM r)
SELECT conv_id, part, speaker, count(*) AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars,
       coalesce(sum(CASE WHEN role = speaker THEN length(body) END), 0)::BIGINT AS trained_chars,
       coalesce(string_agg(CASE WHEN role = speaker THEN start::BIGINT::VARCHAR || ':' || length(body)::VARCHAR END, ',' ORDER BY pos), '') AS mask_spans,
       sha256(string_agg(head || body, '' ORDER BY pos)) AS rendered_sha256
FROM p GROUP BY conv_id, part, speaker
"""
