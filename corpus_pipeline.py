"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of their input as they came, whatever their names; the operators' own columns
never reach them. All judge every row by its whole text, whatever its length, rows that repeat a document too; an empty
table passes through all of them as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import decontam, dedup_near, langid, mixing, shared, tokens
from stepforge.llm.queries import tokenizer_path

#: Below this the language is not clear: no language has more than half of the weight.
LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; those whose text is null or without a letter go.

    The model is learned from the labelled rows of ``docs`` itself; where there are none, no language is recognised and
    no row stays."""
    return langid.recognised(docs, langid.fit(docs), LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates.

    A row with a null doc_id is a document of its own that comes after all others, so of a group of such rows one stays;
    rows of one doc_id stay or go together; a text without words is in no group and stays."""
    keyed = shared.keyed(docs)
    groups = dedup_near.near_groups(keyed.select(F.col(keyed.columns[-1]).alias("doc_id"), "text"))
    return shared.without(keyed, groups.filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows with a null doc_id are searched too. Without items all rows stay."""
    keyed = shared.keyed(docs)
    found = decontam.contaminated(keyed.select(F.col(keyed.columns[-1]).alias("doc_id"), "text"), shared.table(spark, sf_dir, "benchmark"))
    return shared.without(keyed, found)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their targets; a document stands once for each copy. Empty texts have no words and are not taken."""
    return mixing.emitted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token ids in binary shards, listed from the shards; null doc_ids come first."""
    return tokens.read_shards(tokens.write_shards(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: SQL cannot express the models, signatures and tokenizer; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
