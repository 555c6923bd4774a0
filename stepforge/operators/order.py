"""Written tables in the folder all executors share, and places in a global order without a task that holds all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new one, which only a session without executors may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discarded(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``place``, each row's place (from 0) in ``order``: a range partitioning, and one number for each part.

    A column ``place`` of ``rows`` is replaced; all others stay, whatever their names."""
    taken = {c.lower() for c in rows.columns}
    at, part, shift = (next(name for name in (f"{base}{'_' * i}" for i in range(len(taken) + 1)) if name not in taken) for base in ("at", "part", "shift"))
    own = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy(F.shiftright(at, 33).alias(part)).agg(F.min(at).alias("first_"), F.count(F.lit(1)).alias("held_"))
    parts = parts.select(part, (F.coalesce(F.sum("held_").over(before), F.lit(0)) - F.col("first_")).alias(shift))
    # One row for each partition of the shuffle is broadcast.
    placed = own.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(parts), part).withColumn("place", F.col(at) + F.col(shift))
    return placed.drop(part, at, shift)
