"""Records as they are written and read: adapted memory rows, staged steps, labels of sources and splits, paths and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Benchmark scores by the folder below ``webarena/data``, and the folder before a split's name.
BENCHMARK_SCORES = {"agentoccam-judge": 45.7, "2405_all_tasks_step_webarena_bugfix": 33.5, "webarena_clean_trajectory": 48.0}
SPLIT_FOLDER = "json_2.1.1"
GUIDANCE = "array<struct<action:string,observation:string,inventory:string,score:double>>"


def _filled(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def trajectory_of(guidance: Column, row: dict[str, Column]) -> Column:
    """A memory row as a trajectory: its guidance (JSON) as steps with defaults, and what it is of. Text that is no list of
    steps has none; row: goal, task, variation, id, success."""
    steps = _or_empty(F.from_json(guidance, GUIDANCE))
    steps = F.transform(steps, lambda s: F.struct(_or(s["action"], "").alias("action"), _or(s["observation"], "").alias("observation"), _or(s["inventory"], "").alias("inventory"), _or(s["score"], 0.0).alias("score")))
    return F.struct(steps.alias("steps"), _or(row["goal"], "").alias("description"), _or(row["task"], "").alias("task"), _or(row["variation"].cast("string"), "").alias("variation"), _or(row["id"].cast("string"), "").alias("id"), _or(row["success"], False).alias("successful"))


def _or_empty(steps: Column) -> Column:
    return F.filter(F.coalesce(steps, F.array().cast(GUIDANCE)), lambda s: s.isNotNull())


def source_label(environment: str, metadata: Column, model: Column, agent: Column) -> Column:
    """Who made a row. In environment A the model named in the metadata (JSON), else the model column; in B the agent's kind;
    else unknown."""
    if environment == "A":
        return F.coalesce(_filled(F.get_json_object(metadata, "$.model_name")), _filled(model), F.lit("unknown"))
    return F.coalesce(_filled(agent), F.lit("unknown")) if environment == "B" else F.lit("unknown")


def benchmark_score(source: Column) -> Column:
    """The score of the benchmark a source file belongs to: by the folder below the first ``webarena``, if ``data`` follows."""
    parts = F.split(source, "/")
    at = F.array_position(parts, "webarena")
    folder = F.when((at > 0) & (F.try_element_at(parts, (at + 1).cast("int")) == "data"), F.try_element_at(parts, (at + 2).cast("int")))
    known = [F.when(folder == name, score) for name, score in BENCHMARK_SCORES.items()]
    return F.coalesce(*known)


def gold_step(objective: Column, step: Column, last: Column) -> Column:
    """A logged action as a step of a gold trajectory: done and successful where it was completed or is the last."""
    done = _or(step["completed"], False) | last
    text = {"url": "url", "observation": "observation", "action": "action", "reason": "reasoning"}
    numbers = [_or(step[c], 0.0).alias(c) for c in ("reward", "score")]
    return F.struct(_or(objective, "").alias("objective"), *[_or(step[old], "").alias(new) for new, old in text.items()], done.alias("done"), done.cast("double").alias("success"), *numbers)


def staged_record(task: Column, variation: Column, source: Column, steps: Column, extra: dict[str, Column]) -> Column:
    """A staged trajectory: an id of its task, variation and source, where it came from, its steps and metadata."""
    name = F.concat_ws("/", _or(task.cast("string"), ""), _or(variation.cast("string"), ""), _or(source.cast("string"), ""))
    about = F.struct(F.size(steps).alias("total_steps"), *[c.alias(n) for n, c in extra.items()])
    return F.struct(F.md5(name).alias("id"), task.alias("task"), variation.alias("variation"), source.alias("source_file"), steps.alias("trajectory"), about.alias("metadata"))


def nested_config(metadata: Column) -> Column:
    """Metadata (retrieval_config and search_config, both structs, the first with a search_config of its own) with the search
    settings inside the retrieval settings, where there are both and none are nested yet."""
    nested, own = metadata["retrieval_config"], metadata["search_config"]
    both = nested.isNotNull() & own.isNotNull() & nested["search_config"].isNull()
    inside = F.when(both, nested.withField("search_config", own)).otherwise(nested)
    return F.when(metadata.isNotNull(), metadata.withField("retrieval_config", inside).withField("search_config", F.when(~both, own)))


def split_of(path: Column) -> Column:
    """The folder after the data's, train where there is none."""
    return F.coalesce(_filled(F.regexp_extract(path, rf"(?:^|/){SPLIT_FOLDER.replace('.', '[.]')}/([^/]+)(?:/|$)", 1)), F.lit("train"))


def first_retrieval(steps: Column, field: str = "retrieved") -> Column:
    """What the first step that retrieved something got; null where none did."""
    return F.try_element_at(F.filter(steps, lambda s: F.coalesce(F.size(s[field]), F.lit(0)) > 0), F.lit(1))[field]


def rooted(path: Column, root: str) -> Column:
    """The path's file under another root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_extract(path, r"[^/]*$", 0))


def first_number(nested: Column, depth: int) -> Column:
    """The first scalar of lists nested ``depth`` deep as a number: 0 for none, or for what is no number."""
    for _ in range(depth):
        nested = F.try_element_at(nested, F.lit(1))
    return F.coalesce(nested.cast("string").try_cast("double"), F.lit(0.0))


def first_flag(nested: Column, depth: int) -> Column:
    """The first scalar of nested lists as a flag: false for none, for 0 and for ''."""
    for _ in range(depth):
        nested = F.try_element_at(nested, F.lit(1))
    text = nested.cast("string")
    return F.coalesce((text != "") & (F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0) & (text != "false"), F.lit(False))


def normal_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, and with ``..`` taken back where a part stands before it; null for an empty one.
    Exactly two slashes at the start stay."""
    rooted_ = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = (part == "..") & last.isNotNull() & (last != "..")
        lost = (part == "..") & last.isNull() & rooted_
        return F.when(back, F.slice(done, 1, F.size(done) - 1)).when(lost, done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    root = F.when(F.startswith(path, F.lit("//")) & ~F.startswith(path, F.lit("///")), "//").when(rooted_, "/").otherwise("")
    joined = F.concat(root, F.array_join(kept, "/"))
    return F.when(path != "", F.when(joined == "", ".").otherwise(joined))


def prompt_entry(place: Column, row: dict[str, Column]) -> Column:
    """What a prompt's ranking keeps of a row: id, task, variation, retrieved_rank, final_rank, distance, success."""
    text = [_or(row[c].cast("string"), "").alias(c) for c in ("id", "task", "variation")]
    return F.struct(place.alias("rank_in_prompt"), *text, row["retrieved_rank"].alias("retrieved_rank"), row["final_rank"].alias("final_rank"), _or(row["distance"].cast("double"), 0.0).alias("distance"), _or(row["success"], False).alias("is_successful"))


def step_log(strategy: str, steps: Column, context: Column, found: dict[str, Column], planner: Column | None = None) -> Column:
    """The retrieval part of a step's log; found: id, task, variation, score, length, rank, top_k, mean, deviation, count and
    query. The statistics keep their names whatever the number of rows they are of."""
    defaults = {"id": "", "task": "", "variation": "", "score": 0.0, "length": 0, "rank": 1, "top_k": 100, "mean": 0.0, "deviation": 0.0, "count": 0, "query": ""}
    names = {"id": "thought_id", "task": "task_name", "variation": "variation_idx", "score": "similarity_score", "length": "trajectory_length", "rank": "rank_retrieve", "mean": "top_100_mean_distance", "deviation": "top_100_std_distance", "count": "top_100_count"}
    asked = [F.lit(True).alias("triggered_by_planner"), planner.alias("planner_decision")] if planner is not None else [F.lit(strategy).alias("strategy")]
    values = [_or(found[n] if n in found else F.lit(None), d).alias(names.get(n, n)) for n, d in defaults.items()]
    return F.struct(*asked, steps.alias("retrieved_actions_observations"), (F.trim(_or(context, "")) != "").alias("context_provided"), *values)


def candidate_text(fields: dict[str, Column]) -> Column:
    """``field: value`` of each field, in order, between bars; nulls are left out, empty values stay."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields.items()])


def reranker_query(goal: Column, history: Column, observation: Column, inventory: Column, reasoning: Column) -> Column:
    """Goal, last observation, the last two actions of the history's lines, inventory and analysis; blank ones are left out."""
    blank = lambda c: F.nullif(F.regexp_replace(_or(c, ""), r"^\s+|\s+$", ""), F.lit(""))
    lines = F.split(_or(history, ""), "\n")
    taken = F.transform(lines, lambda line: blank(F.regexp_extract(line, r"\| ACTION: (.*?) \| REWARD: ", 1)))
    taken = F.filter(taken, lambda a: a.isNotNull())
    recent = F.nullif(F.array_join(F.slice(taken, F.greatest(F.size(taken) - 1, F.lit(1)), 2), " | "), F.lit(""))
    named = {"Goal": blank(goal), "Last observation": blank(observation), "Recent action history": recent, "Inventory": blank(inventory), "Analysis": blank(reasoning)}
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{name}: "), value) for name, value in named.items()])
