"""Readers and writers of trajectories, memory tables, feature tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRAJECTORY = "task_id string, task_type string, split string, floor_plan string, goal string, game_file string, num_steps int, trajectory array<struct<observation string, action string>>"


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def read_trajectories(spark: SparkSession, path: str, schema: str | StructType = TRAJECTORY, manifest: DataFrame | None = None) -> DataFrame:
    """One row for each JSON file with its path; with a manifest (path), only its files, else only the train split."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    df = df.withColumn("path", F.col("_metadata.file_path"))
    return df.join(manifest.select("path").distinct(), "path", "left_semi") if manifest is not None else df.filter("split = 'train'")


def in_name_order(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with name_order, to sort files by the number that their name is, and names that are no number after those."""
    name = F.regexp_extract(F.col(path), r"([^/]+?)(?:\.json)?$", 1)
    number = name.try_cast("long")
    return df.withColumn("name_order", F.struct(number.isNull().alias("named"), number.alias("number"), name.alias("name")))


def read_configs(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One row for each JSON object that has a task_id and an intent_template_id, with its task_name; other files are left out."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    some = F.col("task_id").isNotNull() & F.col("intent_template_id").isNotNull()
    return df.filter(some).withColumn("task_name", F.concat(F.lit("intent_template_id_"), F.col("intent_template_id").cast("string")))


#: Endings of run logs, the first that a run has is read.
LOG_NAMES = ("_trajectories_rag", "_trajectories", "_trajectories_agentic")


def read_runs(spark: SparkSession, root: str, prefix: str, schema: str | StructType) -> DataFrame:
    """The logs of all run folders of ``root`` whose names begin with ``prefix``, with run and path; of each run's logs the
    one whose name ends first among ``LOG_NAMES``."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/{prefix}*/*.json").withColumn("path", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.col("path"), r"\.json$", "")
    priority = F.coalesce(*[F.when(F.endswith(stem, F.lit(name)), i) for i, name in enumerate(LOG_NAMES)])
    logs = df.withColumn("run", F.try_element_at(F.split("path", "/"), F.lit(-2))).withColumn("priority", priority).filter("priority is not null")
    best = logs.groupBy("run").agg(F.min("priority").alias("best"))  # a row for each run
    return logs.join(best, "run").filter("priority = best").drop("priority", "best")


def replay_steps(records: DataFrame, order: str) -> DataFrame:
    """task_name, variation, step_index, step: the steps of the last record, by ``order``, of each task and variation."""
    last = records.groupBy("task_name", F.col("variation").cast("string").alias("variation")).agg(F.max_by("trajectory", order).alias("trajectory"))
    return last.select("task_name", "variation", F.posexplode("trajectory").alias("step_index", "step"))


def path_keys(path: Column) -> list[Column]:
    """task, variation and id of .../{task}/{variation}/{id}.json."""
    part = lambda i: F.try_element_at(F.split(path, "/"), F.lit(i))
    return [part(-3).alias("task_name"), part(-2).alias("variation"), F.regexp_replace(part(-1), r"\.json$", "").alias("trajectory_id")]


def exploded(df: DataFrame, drop_last: bool = False) -> DataFrame:
    """One row for each step, with its 0-based index; ``drop_last`` leaves the last step out."""
    steps = F.expr("slice(trajectory, 1, greatest(size(trajectory) - 1, 0))") if drop_last else F.col("trajectory")
    return df.select(*[c for c in df.columns if c != "trajectory"], F.posexplode(steps).alias("step_index", "step"))


def read_features(spark: SparkSession, path: str, schema: str | StructType, labelled: bool = True) -> DataFrame:
    """A tab-separated feature table with header, for training or, without labels, for a test; its order is by qid.

    The columns must be there; a missing label or qid of a row is an error when the row is read."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    for name in ("qid", "label") if labelled else ("qid",):
        if name not in df.columns:
            raise ValueError(f"a feature table needs {name}")
        df = df.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.lit(f"a row has no {name}")).cast(dict(df.dtypes)[name])))
    return df.sort("qid")


def read_capabilities(spark: SparkSession, path: str, key: str = "model") -> DataFrame:
    """A small tab-separated dimension: its key and its numbers, the header's names as feature names, other values null."""
    from stepforge.functions.text import feature_name

    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = spark.createDataFrame([(c,) for c in raw.columns], "c string").select("c", feature_name(F.col("c")).alias("n")).collect()
    plain = {r["c"]: r["n"] for r in names}
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) if n == key else F.trim(F.col(f"`{c}`")).try_cast("double").alias(n) for c, n in plain.items()])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("qid", "label", "docid", "folder_nativeid")]


def write_features(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_qid_map(df: DataFrame, query: str, path: str) -> None:
    """The queries of a feature table with their qids, as a tab-separated table."""
    write_features(df.select("qid", query).distinct(), path)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Records as JSON lines, in a folder for each value of ``by``; refuses to write over a table."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_splits(df: DataFrame, path: str, part: str, order: list[str]) -> None:
    """A folder of JSON lines for each value of ``part``, each sorted by ``order``."""
    df.repartitionByRange(part, *order).sortWithinPartitions(part, *order).write.mode("errorifexists").partitionBy(part).json(path)


def write_runs(df: DataFrame, path: str, kinds: dict[str, list[str]]) -> None:
    """For each kind of output its columns as JSON lines, in a folder for each task: ``path/kind/task_name=...``."""
    for kind, columns in kinds.items():
        write_json(df.select("task_name", *columns), f"{path.rstrip('/')}/{kind}", ["task_name"])


def report(summary: DataFrame, title: str) -> str:
    """A text report of a small summary (a row for each task): a line for each row, numbers with four digits."""
    shown = [F.format_string("%.4f", c) if kind in ("double", "float") else F.col(c).cast("string") for c, kind in summary.dtypes]
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("-"))) for name, c in zip(summary.columns, shown)]
    lines = summary.select(F.concat_ws("  ", *parts).alias("line")).orderBy("line").collect()
    return "\n".join([title, "=" * len(title), *[r["line"] for r in lines], ""])


def create_memory(df: DataFrame, path: str, force: bool = False, partition: str = "environment") -> None:
    """Creates the memory table, or replaces it if forced; raises where it stands already."""
    df.write.mode("overwrite" if force else "errorifexists").partitionBy(partition).parquet(path)


def append_memory(df: DataFrame, path: str, partition: str = "environment") -> None:
    """Adds rows to the memory table, which may have fewer columns than it has by now, but none of another type."""
    spark = df.sparkSession
    held = dict(spark.read.option("mergeSchema", True).parquet(path).dtypes)
    unlike = [c for c, kind in df.dtypes if c in held and held[c] != kind]
    if unlike:
        raise ValueError(f"columns have other types in the table: {unlike}")
    df.write.mode("append").partitionBy(partition).parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    numbers = [F.format_string("%.4f", c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*numbers).write.mode("append").option("header", True).csv(path)
