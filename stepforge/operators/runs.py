"""Filters, sums and lookups over runs: what counts as a success, which rows are used, and how rows are aligned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.order import numbered


def unflagged(steps: Column, flag: str) -> Column:
    """No step carries the flag; null flags count as unset."""
    return ~F.exists(steps, lambda s: F.coalesce(s[flag], F.lit(False)))


def last_succeeded(steps: Column) -> Column:
    """The last step is done with success 1; false without steps."""
    last = F.try_element_at(steps, F.lit(-1))
    return F.coalesce(last["done"] & (last["success"] == 1), F.lit(False))


def unrepeated(actions: Column, once: Column, last: Column) -> Column:
    """``actions`` without the last action taken, if it is one of those that may not follow themselves."""
    return F.filter(actions, lambda a: ~F.coalesce((a == last) & F.array_contains(once, a), F.lit(False)))


def succeeded(environment: Column, score: Column) -> Column:
    """Environment A succeeds at exactly 1, any other at 1 or more."""
    return F.coalesce(F.when(environment == "A", score == 1).otherwise(score >= 1), F.lit(False))


def problem(steps: Column, record: Column, key: str = "trajectory") -> Column:
    """An episode without steps, or whose record (VARIANT) has ``key`` with an explicit null; an absent key is none."""
    value = F.try_variant_get(record, f"$.{key}", "variant")
    return (F.coalesce(F.size(steps), F.lit(0)) <= 0) | F.coalesce(F.is_variant_null(value), F.lit(False))


def sliced(rows: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """Rows [start, end) in ``order``; an end of -1 is the end of the table."""
    placed = numbered(rows, *order)
    return placed.filter((F.col("place") >= start) & (F.lit(end == -1) | (F.col("place") < end)))


def totals(rows: DataFrame, groups: list[str], success: Column, skipped: Column) -> DataFrame:
    """Runs, how many succeeded, failed and were skipped, and the success rate of those that ran (0 for none)."""
    ran = ~skipped
    out = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("runs"), F.count_if(ran & success).alias("succeeded"), F.count_if(ran & ~success).alias("failed"), F.count_if(skipped).alias("skipped"))
    return out.withColumn("success_rate", F.round(F.col("succeeded") / F.greatest(F.col("succeeded") + F.col("failed"), F.lit(1)), 6))


def metrics(rows: DataFrame, groups: list[str], score: str, success: Column, length: str) -> DataFrame:
    """Best, worst and mean score, success rate and mean retrieved length; sums over at least one row."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    mean = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / n, 6)
    return rows.groupBy(*groups).agg(F.max(score).alias("max_score"), F.min(score).alias("min_score"), mean(score).alias("mean_score"), F.round(F.count_if(success) / n, 6).alias("success_rate"), mean(length).alias("mean_retrieved_length"))


def aligned(rows: DataFrame, index: DataFrame, keys: list[str], task: str, variation: str, document: str, place: str) -> DataFrame:
    """``rows`` with status, mode, picked_document and picked_place of the index row that shares ``keys``.

    Of the rows that share the keys, those of the same task are preferred, then those of the same variation, each only if
    there are some; of the rest a single one is ``unique``, else one of the same document (``same_document``), else the
    ``first`` by document and place. The index is summed up for each level before the lookups, so a key that many rows
    share is never expanded into pairs."""
    levels = {"task_variation": [task, variation], "task": [task], "variation": [variation], "any": []}
    out, last = rows, {}
    for name, more in levels.items():
        first = F.min(F.struct(F.col(document).alias("d"), F.col(place).alias("p")))
        for kind, extra in (("of", []), ("own", [document])):
            by = [*keys, *more, *extra]
            found = index.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{kind}_{name}"), first.alias(f"f_{kind}_{name}"))
            out = out.join(found, by, "left")
        last[name] = F.coalesce(F.col(f"n_of_{name}"), F.lit(0))
    pick = lambda make: F.coalesce(*[F.when(last[name] > 0, make(name)) for name in levels])
    mode = pick(lambda name: F.when(last[name] == 1, "unique").when(F.col(f"n_own_{name}") > 0, "same_document").otherwise("first"))
    chosen = pick(lambda name: F.when((last[name] > 1) & (F.col(f"n_own_{name}") > 0), F.col(f"f_own_{name}")).otherwise(F.col(f"f_of_{name}")))
    status = F.when(last["any"] == 0, "missing").when(mode == "unique", "matched").otherwise("ambiguous")
    return out.select(*rows.columns, status.alias("status"), F.coalesce(mode, F.lit("none")).alias("mode"), chosen["d"].alias("picked_document"), chosen["p"].alias("picked_place"))


def status_counts(found: DataFrame) -> DataFrame:
    """Rows of each status and mode, and in all rows the share of those that were matched."""
    out = found.groupBy("status", "mode").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # a row for each status and mode
    matched = F.sum(F.when(F.col("status") != "missing", F.col("n")).otherwise(0)).over(everything)
    return out.withColumn("match_rate", F.round(matched / F.sum("n").over(everything), 6))


def first_match(rows: DataFrame, table: DataFrame, keys: list[str], order: list[str], wanted: list[str]) -> DataFrame:
    """``rows`` with ``wanted`` of the first table row, in ``order``, that shares ``keys``; nulls where there is none."""
    first = table.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in wanted if c not in order])).alias("first"))
    return rows.join(first.select(*keys, *[F.col(f"first.{c}").alias(c) for c in wanted]), keys, "left")


def containing(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, words: int = 5) -> DataFrame:
    """doc_key, item_key: the documents whose lower-cased words hold all words of an item in a row.

    Documents and items meet on the rarest run of ``words`` words of an item (all of a shorter one's): an item's runs are
    counted over all documents first. What is exploded is a hash of each run, never a text; texts are fetched for the pairs
    that met alone, and compared whole. Items without words are in no document."""
    split = lambda: F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    whole = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    runs_of = lambda k: F.expr(f"transform(sequence(1, greatest(size(w) - {k} + 1, 1)), i -> xxhash64(slice(w, i, {k})))")
    asked = items.select(item_key, split().alias("w")).filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(words)))
    sizes = sorted(r["k"] for r in asked.select("k").distinct().collect())  # at most ``words`` numbers
    if not sizes:
        return docs.select(doc_key, F.lit(None).cast(dict(items.dtypes)[item_key]).alias(item_key)).limit(0)
    own = F.coalesce(*[F.when(F.col("k") == k, runs_of(k)) for k in sizes])
    wanted = asked.select(item_key, F.explode(F.array_distinct(own)).alias("run"))
    held = docs.select(doc_key, split().alias("w")).select(doc_key, F.explode(F.array_distinct(F.concat(*[runs_of(k) for k in sizes]))).alias("run"))
    # Only runs of items are kept; each is counted where it lies first.
    met = held.join(wanted.select("run").distinct(), "run", "left_semi")
    counts = met.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "run", "left").groupBy(item_key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r"))
    pairs = met.join(rarest.filter("r.n > 0").select(item_key, F.col("r.run").alias("run")), "run").select(doc_key, item_key).distinct()
    texts = docs.select(doc_key, whole(split()).alias("text")).join(pairs, doc_key).join(asked.select(item_key, whole(F.col("w")).alias("item")), item_key)
    return texts.filter(F.contains(F.col("text"), F.col("item"))).select(doc_key, item_key)


def stage_merge(reranked: DataFrame, rest: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, rank of the reranked prefix and then the others, each key where it is first seen (both with rank)."""
    both = reranked.select(group, key, F.lit(0).alias("part"), "rank").unionByName(rest.select(group, key, F.lit(1).alias("part"), "rank"))
    first = both.groupBy(group, key).agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("at.part", "at.rank", key)).alias("rank"))


#: Causes of a warning about an action, in order of priority, and the words before a chosen letter.
MISMATCH, PARTIAL, SIMILAR, UNSURE = "trajectory context", "incomplete/partial", "similar words", "not sure"
CHOICE_WORDS = ("PASSAGE", "OPTION", "ANSWER")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def cause(action: Column, context: Column, admissible: Column) -> Column:
    """Why an action is not admissible: the retrieved context holds it, an admissible one holds it, or one shares two of
    its words; cases do not matter."""
    low, retrieved = F.lower(F.coalesce(action, F.lit(""))), F.lower(F.coalesce(context, F.lit("")))
    options = F.transform(F.coalesce(admissible, F.array().cast("array<string>")), lambda x: F.lower(x))
    close = F.exists(options, lambda x: F.size(F.array_intersect(_words(low), _words(x))) >= 2)
    return F.when((retrieved != "") & F.contains(retrieved, low), MISMATCH).when(F.exists(options, lambda x: F.contains(x, low)), PARTIAL).when(close, SIMILAR).otherwise(UNSURE)


def choice(answer: Column) -> Column:
    """A or B of an answer: the letter after one of ``CHOICE_WORDS``, in their order, else the only one of the two letters
    that stands alone; '' if that does not tell."""
    text = F.upper(F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"\s+", " "))
    told = [F.when(text.rlike(rf"\b{word}\s*{'[:-]?' if word == 'ANSWER' else ''}\s*{letter}\b"), letter) for word in CHOICE_WORDS for letter in "AB"]
    alone = {letter: text.rlike(rf"\b{letter}\b") for letter in "AB"}
    return F.coalesce(*told, F.when(alone["A"] & ~alone["B"], "A").when(alone["B"] & ~alone["A"], "B"), F.lit(""))


def shared_rows(evaluation: DataFrame, index: DataFrame, field: str, limit: int = 10) -> DataFrame:
    """field, value and side of at most ``limit`` rows of the evaluation whose value the index has too. Values are text; null
    and empty ones are none. A report, in the values' order."""
    own = lambda d: d.select(F.nullif(F.col(field).cast("string"), F.lit("")).alias("value")).filter("value is not null")
    left, right = own(evaluation), own(index)
    return left.join(right.distinct(), "value", "left_semi").orderBy("value").limit(limit).select(F.lit(field).alias("field"), "value", F.lit("evaluation").alias("side"))


def provenance(rows: DataFrame, gold: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    """``rows`` with ``wanted`` (of gold's columns) of the gold record of their ``keys``; a row with a null or empty key, or
    without a record, has nulls. Of repeated records the one with the smallest values counts."""
    named = gold.select(*[F.col(k).cast("string").alias(f"gold_{k}") for k in keys], *[c.alias(n) for n, c in wanted.items()])
    known = named.groupBy(*[f"gold_{k}" for k in keys]).agg(F.min(F.struct(*wanted)).alias("found"))
    same = [F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) == F.col(f"gold_{k}") for k in keys]
    return rows.join(known, same, "left").select(*rows.columns, *[F.col(f"found.{n}").alias(n) for n in wanted])


def in_answer_order(answer: DataFrame, candidates: DataFrame, group: str, key: str) -> DataFrame:
    """The candidates that a reranker's ``answer`` (group, place, key) names, with ``rank`` by place: an unknown or empty key is
    passed over, and of candidates that share a key the last by rank counts. A key named twice stands twice."""
    last = candidates.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(group, key).agg(F.max_by(F.struct(*[c for c in candidates.columns if c not in (group, key)]), "rank").alias("own"))
    rest = [c for c in candidates.columns if c not in (group, key, "rank")]
    rank = F.row_number().over(Window.partitionBy(group).orderBy("place"))
    return answer.select(group, "place", key).join(last, [group, key]).select(group, key, *[F.col(f"own.{c}").alias(c) for c in rest], rank.alias("rank"))


def with_ranks(rows: DataFrame, group: str, order: list) -> DataFrame:
    """``rows`` with retrieved_rank and final_rank, those that are missing filled by the place in ``order``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).withColumns({c: F.coalesce(F.col(c).cast("long"), F.col("_place").cast("long")) for c in ("retrieved_rank", "final_rank")}).drop("_place")


def usage(calls: DataFrame, groups: list[str], hit: Column, size: Column) -> DataFrame:
    """Calls, how many a cache answered, its hit rate, and the mean size of the batches that were run (0 for none)."""
    out = calls.groupBy(*groups).agg(F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("hits"), F.coalesce(F.avg(F.when(~hit, size)), F.lit(0.0)).alias("mean_batch"))
    return out.withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.col("calls"), F.lit(1)), 6)).withColumn("mean_batch", F.round("mean_batch", 6))
