"""Append of finished steps to a memory table without repeats, batch and streaming, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose keys (null-safe) are not in ``table``, each key once."""
    held = table.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return batch.dropDuplicates(keys).join(held, same, "left_anti")


def push_stream(stream: DataFrame, table_path: str, checkpoint: str, keys: list[str]):
    """A single-writer stream into ``table_path``; a replayed batch finds its own keys there and adds nothing."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            table = spark.read.schema(batch.schema).parquet(table_path)
        except Exception as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            table = batch.limit(0)
        new_rows(batch, table, keys).write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
