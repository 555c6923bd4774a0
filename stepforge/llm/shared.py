"""Helpers for written intermediate tables in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators.order import discarded, numbered, shared_dir, written

__all__ = ["discarded", "keyed", "numbered", "shared_dir", "sized", "table", "texts_of", "without", "written"]


#: Texts in an Arrow batch where the session has Spark's default of 10,000: texts are long, and a task holds whole batches.
BATCH_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(docs: DataFrame) -> DataFrame:
    """``docs``, about to be sent to Python, with batches of ``BATCH_ROWS`` unless the session says otherwise."""
    if docs.sparkSession.conf.get(_ARROW_ROWS) == "10000":
        docs.sparkSession.conf.set(_ARROW_ROWS, str(BATCH_ROWS))
    return docs


#: Rows of ids that may be broadcast: about 32 MB in each executor.
BROADCAST_ROWS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """A written table of ids with the join it is fit for: broadcast up to ``BROADCAST_ROWS``, a sort-merge join beyond."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")


#: Where the keys of rows without a doc_id begin: after all doc_ids in use.
UNNAMED = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a last column, under a free name, of each row's key: its doc_id, or a number from ``UNNAMED`` on that no
    other row has. Rows without a doc_id are written once with their keys, so keys agree however often they are read."""
    name = "key"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    named = docs.filter("doc_id is not null").withColumn(name, F.col("doc_id").cast("long"))
    return named.unionAll(written(docs.filter("doc_id is null").withColumn(name, F.lit(UNNAMED) + F.monotonically_increasing_id()), "unnamed"))


def without(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``rows`` (made by ``keyed``) whose key is not among ``found`` (doc_id), with their own columns alone."""
    key = rows.columns[-1]
    gone = sized(written(found.select(F.col("doc_id").alias(key)).distinct(), "dropped"))
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns[:-1]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
