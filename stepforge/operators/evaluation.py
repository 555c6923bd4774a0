"""Outcome disagreements, episode evaluation and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.order import numbered


def disagreements(runs: DataFrame) -> DataFrame:
    """Score of each simulation: +1 for each opposite outcome if it succeeded, else -1 each; 0 opponents give no row.

    runs: comp, cluster, run_id, baseline boolean, success boolean. Opponents are simulations of the same (cluster, comp)
    and baselines of the same comp. Counts replace the pairs: one aggregate for each side.
    """
    sims = runs.filter("not baseline")
    of_cluster = sims.groupBy("comp", "cluster").agg(F.count_if("success").alias("won"), F.count_if(~F.col("success")).alias("lost"))
    base = runs.filter("baseline").groupBy("comp").agg(F.count_if("success").alias("b_won"), F.count_if(~F.col("success")).alias("b_lost"))
    joined = sims.join(of_cluster, ["comp", "cluster"]).join(base, "comp", "left")
    against = F.when(F.col("success"), F.col("lost") + F.coalesce("b_lost", F.lit(0))).otherwise(F.col("won") + F.coalesce("b_won", F.lit(0)))
    return joined.withColumn("score", F.when(F.col("success"), against).otherwise(-against)).filter("score <> 0").select("comp", "cluster", "run_id", "score")


def group_stats(scores: DataFrame) -> DataFrame:
    sizes = scores.groupBy("comp", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") == 1).alias("single"), F.round(F.avg("n"), 6).alias("mean_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("std_size"))


def episodes(steps: DataFrame, max_steps: int) -> DataFrame:
    """One row for each episode of steps (task, episode, at, action, score): lengths, scores and class."""
    order = F.struct("at", "score")
    out = steps.groupBy("task", "episode").agg(F.count(F.lit(1)).alias("total_steps"), F.count_distinct("action").alias("unique_actions"), F.min(order).alias("first"), F.max(order).alias("last"))
    final = F.col("last.score")
    label = F.when(final >= 1, "success").when(final <= 0, "failure").otherwise("in_progress")
    return out.select("task", "episode", "total_steps", "unique_actions", F.col("first.score").alias("initial_score"), final.alias("final_score"), F.round(final - F.col("first.score"), 6).alias("improvement"), (F.col("total_steps") >= max_steps).alias("reached_max"), label.alias("class"))


def evaluation(found: DataFrame) -> DataFrame:
    """Per task and over all tasks (null task), in one rollup."""
    share = lambda name: F.round(F.avg((F.col("class") == name).cast("double")), 6)
    ok = F.when(F.col("class") != "failure", F.col("total_steps"))
    return found.rollup("task").agg(
        F.count(F.lit(1)).alias("episodes"),
        share("success").alias("success_rate"),
        share("failure").alias("failure_rate"),
        F.round(F.avg("total_steps"), 6).alias("mean_steps"),
        F.round(F.stddev_pop("total_steps"), 6).alias("std_steps"),
        F.min("total_steps").alias("min_steps"),
        F.max("total_steps").alias("max_steps"),
        F.round(F.avg("final_score"), 6).alias("mean_score"),
        F.round(F.avg(ok), 6).alias("mean_steps_not_failed"),
        F.count_if("reached_max").alias("at_limit"),
    )


def qids(df: DataFrame, query: str) -> DataFrame:
    """qid of each distinct query, 1-based in sorted order, joined back; the distinct values are numbered where they lie."""
    ids = numbered(df.select(query).distinct(), query).select(query, (F.col("place") + 1).alias("qid"))
    return df.join(ids, query)


#: Texts that name a message's type or a warning's cause, in order of priority.
WARNING_TYPES = (("non-admissible action", "non_admissible_action"),)
ERROR_TYPES = (("json parsing failed", "json_parsing_failed"), ("llm call failed", "llm_call_failed"))
CAUSES = (
    ("trajectory context", "retrieval_trajectory_mismatch"),
    ("incomplete/partial", "partial_incomplete_action"),
    ("similar words", "similar_word_confusion"),
)


def _named(column, names, otherwise: str):
    """The name of the first text that ``column`` holds, in any case."""
    low = F.lower(F.coalesce(column, F.lit("")))
    return F.coalesce(*[F.when(low.contains(text), F.lit(name)) for text, name in names], F.lit(otherwise))


def messages(log: DataFrame) -> DataFrame:
    """``log`` (task, episode, kind, structured, fallback, message, cause) as counted messages with type and cause.

    Kinds are warning, error and planner. A structured warning counts only after the last fallback; one that is a plain
    string always does, as type other and cause not_sure. Null flags count as false.
    """
    plain = ~F.coalesce(F.col("structured"), F.lit(False))
    counted = (F.col("kind") != "warning") | plain | F.coalesce(F.col("fallback"), F.lit(False))
    kind = F.when(F.col("kind") == "planner", "planner_failed").when(F.col("kind") == "error", _named(F.col("message"), ERROR_TYPES, "other"))
    kind = kind.otherwise(F.when(plain, "other").otherwise(_named(F.col("message"), WARNING_TYPES, "other")))
    cause = F.when(F.col("kind") == "warning", F.when(plain, "not_sure").otherwise(_named(F.col("cause"), CAUSES, "not_sure")))
    return log.filter(counted).select("task", "episode", (F.col("kind") == "warning").alias("warning"), kind.alias("type"), cause.alias("cause"))


def message_rollup(counted: DataFrame) -> DataFrame:
    """Warnings, errors, types and causes of each episode, each task (episode null) and all (both null)."""
    of_type = {f"type_{name}": F.count_if(~F.col("warning") & (F.col("type") == name)) for _, name in ERROR_TYPES}
    of_cause = {f"cause_{name}": F.count_if(F.col("cause") == name) for name in [n for _, n in CAUSES] + ["not_sure"]}
    columns = {"warnings": F.count_if("warning"), "errors": F.count_if(~F.col("warning")), "type_non_admissible_action": F.count_if(F.col("type") == "non_admissible_action"), "type_planner_failed": F.count_if(F.col("type") == "planner_failed")}
    return counted.rollup("task", "episode").agg(*[c.alias(name) for name, c in (columns | of_type | of_cause).items()])


def episode_class(environment: Column, score: Column, steps: Column) -> Column:
    """success, failure or in_progress of a final score: exactly 1 and 0 in environment A, at least 1 and at most 0 elsewhere;
    unknown without steps or score."""
    exact = environment == "A"
    won, lost = F.when(exact, score == 1).otherwise(score >= 1), F.when(exact, score == 0).otherwise(score <= 0)
    return F.when((F.coalesce(steps, F.lit(0)) <= 0) | score.isNull(), "unknown").when(won, "success").when(lost, "failure").otherwise("in_progress")


def class_blocks(found: DataFrame) -> DataFrame:
    """task (null for all), block, episodes, share, and mean, deviation, least and most of steps and scores: a block for each
    class, one for all that did not fail and one for all episodes. found: task, class, total_steps, final_score."""
    blocks = F.array_compact(F.array("class", F.when(F.col("class") != "failure", "not_failed"), F.lit("all")))
    rows = found.select("task", "total_steps", "final_score", F.explode(blocks).alias("block"))
    numbers = [f(c).alias(f"{n}_{c.split('_')[1]}") for c in ("total_steps", "final_score") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))]
    out = rows.rollup("block", "task").agg(F.count(F.lit(1)).alias("episodes"), F.grouping("block").alias("whole"), F.grouping("task").alias("every"), *numbers).filter("whole = 0")
    # A row for each task and block.
    of_task = F.max(F.when(F.col("block") == "all", F.col("episodes"))).over(Window.partitionBy("task", "every"))
    rounded = [F.round(c, 6).alias(c) for c in out.columns if c[:4] in ("mean", "std_")]
    return out.select("task", "block", "episodes", F.round(F.col("episodes") / of_task, 6).alias("share"), *rounded, "min_steps", "max_steps", "min_score", "max_score")


def outcomes(steps: DataFrame, trajectory: str, order: list[str], success: Column) -> DataFrame:
    """``steps`` with trajectory_length and trajectory_success, of the last step, on every row; a trajectory is summed first,
    and its rows are never gathered."""
    last = steps.groupBy(trajectory).agg(F.count(F.lit(1)).alias("trajectory_length"), F.max(F.struct(*order, F.coalesce(success, F.lit(False)).alias("won"))).alias("last"))
    return steps.join(last.select(trajectory, "trajectory_length", F.col("last.won").alias("trajectory_success")), trajectory)


def stage_ranks(rows: DataFrame, group: str, stages: dict[str, list]) -> DataFrame:
    """``rows`` with a rank from 1 for each stage, by its own order within a group."""
    return rows.withColumns({name: F.row_number().over(Window.partitionBy(group).orderBy(*order)) for name, order in stages.items()})


def rank_gain(before: str, after: str) -> Column:
    """What a rank gained over the one before, in reciprocal ranks; 0 where one is missing."""
    return F.round(F.coalesce(1 / F.col(after) - 1 / F.col(before), F.lit(0.0)), 6)
