"""Registered queries over records, paths, prompts and provenance, with DuckDB SQL for the same rows; stand-ins as in the
catalogue: conversations are trajectories, pages hold the paths, parts and orders are runs and their gold records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepforge.catalog import query, read
from stepforge.functions import records
from stepforge.operators import evaluation, runs


@query("""WITH s AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1 AS last FROM conversations)
SELECT conv_id, turn, role, role AS action, md5(text) AS observation, role = 'assistant' OR last AS done, (role = 'assistant' OR last)::INT::DOUBLE AS success, (turn % 3)::DOUBLE AS reward, '' AS url FROM s""")
def gold_steps(spark, sf_dir):
    v = read(spark, sf_dir, "conversations")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))) == 1
    step = F.struct(F.lit(None).cast("string").alias("url"), F.col("text").alias("observation"), (F.col("role") == "assistant").alias("completed"), F.when(F.col("turn") % 3 > 0, (F.col("turn") % 3).cast("double")).alias("reward"), F.lit(None).cast("double").alias("score"), F.col("role").alias("action"), F.lit("").alias("reasoning"))
    made = v.withColumn("last", last).select("conv_id", "turn", "role", records.gold_step(F.lit("goal"), step, F.col("last")).alias("g"))
    return made.select("conv_id", "turn", "role", "g.action", F.md5("g.observation").alias("observation"), "g.done", "g.success", "g.reward", "g.url")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, n AS steps, last AS last_action, conv_id::VARCHAR AS variation, md5('conv/' || conv_id || '/') AS staged_id, n AS total_steps FROM c""")
def adapted_trajectories(spark, sf_dir):
    """A conversation's turns as a memory row's guidance, adapted back into steps and staged."""
    one = F.struct("turn", F.col("role").alias("action"), F.col("text").alias("observation"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    rows = rows.withColumn("guidance", F.to_json(F.transform("s", lambda x: F.struct(x["action"].alias("action"), x["observation"].alias("observation")))))
    row = {"goal": F.lit("goal"), "task": F.lit("conv"), "variation": F.col("conv_id"), "id": F.lit(None).cast("string"), "success": F.lit(None).cast("boolean")}
    rows = rows.withColumn("t", records.trajectory_of(F.col("guidance"), row))
    staged = records.staged_record(F.col("t.task"), F.col("conv_id"), F.lit(""), F.col("t.steps"), {"goal": F.col("t.description")})
    rows = rows.withColumn("staged", staged)
    return rows.select("conv_id", F.size("t.steps").cast("long").alias("steps"), F.try_element_at("t.steps", F.lit(-1))["action"].alias("last_action"), "t.variation", F.col("staged.id").alias("staged_id"), F.col("staged.metadata.total_steps").cast("long").alias("total_steps"))


_HOST = "split_part(split_part(url, '//', 2), '/', 1)"


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {_HOST} ELSE 'train' END AS split, '/conf/' || regexp_extract(url, '[^/]*$') AS config, CASE page_id % 4 WHEN 0 THEN 45.7 WHEN 1 THEN 48.0 END::DOUBLE AS score,
CASE WHEN page_id % 2 = 0 THEN '/a/' || {_HOST} || '/b' ELSE '../' || {_HOST} END AS normal, CASE page_id % 3 WHEN 0 THEN {_HOST} WHEN 1 THEN 'm' ELSE 'unknown' END AS source FROM pages""")
def path_labels(spark, sf_dir):
    """Splits, configs, benchmark scores, normal paths and sources, of paths made with each page's host."""
    i, host = F.col("page_id"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    path = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    split = F.when(i % 3 == 0, path("/x/json_2.1.1/", host, "/t/0.json")).otherwise(path("/x/json_2x1.1/", host))
    benchmark = F.when(i % 4 == 0, path("/r/webarena/data/agentoccam-judge/", host)).when(i % 4 == 1, path("webarena/data/webarena_clean_trajectory/x")).when(i % 4 == 2, path("/webarena/other/agentoccam-judge/", host)).otherwise(path("/r/data/agentoccam-judge/", host))
    normal = F.when(i % 2 == 0, path("/..//a/./x/../", host, "//b/")).otherwise(path("q/../../", host, "/."))
    metadata = F.when(i % 3 == 0, path('{"model_name": "', host, '"}')).when(i % 3 == 1, '{"model_name": ""}').otherwise("no json")
    source = records.source_label("A", metadata, F.when(i % 3 == 1, "m").otherwise(""), F.lit("agent"))
    return read(spark, sf_dir, "pages").select("page_id", records.split_of(split).alias("split"), records.rooted(F.col("url"), "/conf/").alias("config"), records.benchmark_score(benchmark).alias("score"), records.normal_path(normal).alias("normal"), source.alias("source"))


@query("""SELECT event_id, value AS number, value <> 0 AS flag, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS first_found, CASE WHEN event_id % 2 = 0 THEN 'inner' ELSE event_type END AS search, event_id % 2 = 0 AS kept_outside,
'type: ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' | user: ' || user_id ELSE '' END || ' | empty: ' AS candidate FROM events""")
def record_fields(spark, sf_dir):
    """Nested scalars, the first retrieval of an episode, nested settings, and a candidate's text."""
    i, e = F.col("event_id"), read(spark, sf_dir, "events")
    step = lambda found: F.struct(found.alias("retrieved"))
    none = F.array().cast("array<string>")
    steps = F.array(step(none), step(F.lit(None).cast("array<string>")), step(F.when(i % 3 == 0, none).otherwise(F.array("event_type"))), step(F.when(i % 3 > 0, F.array(F.lit("later"))).otherwise(none)))
    config = F.struct(F.struct(F.when(i % 2 == 0, "inner").alias("search_config")).alias("retrieval_config"), F.col("event_type").alias("search_config"))
    moved = records.nested_config(config)
    text = records.candidate_text({"type": F.col("event_type"), "user": F.when(i % 2 == 0, F.col("user_id")), "empty": F.lit("")})
    nested = F.array(F.array("value", F.lit(9.0)))
    return e.select("event_id", records.first_number(nested, 2).alias("number"), records.first_flag(nested, 2).alias("flag"), F.try_element_at(records.first_retrieval(steps), F.lit(1)).alias("first_found"), moved["retrieval_config"]["search_config"].alias("search"), moved["search_config"].isNotNull().alias("kept_outside"), text.alias("candidate"))


@query("""SELECT conv_id, turn, role, 'Goal: g | Last observation: ' || trim(text) || CASE WHEN turn >= 1 THEN ' | Recent action history: ' || CASE WHEN turn >= 2 THEN 'a' || (turn - 2) || ' | ' ELSE '' END || 'a' || (turn - 1) ELSE '' END AS reranker_query FROM conversations""")
def reranker_queries(spark, sf_dir):
    line = "concat('STEP ', j, ' | ACTION: a', j, ' | REWARD: 0')"
    history = F.expr(f"array_join(transform(filter(sequence(0, 40), j -> j < turn), j -> {line}), '\n')")
    v = read(spark, sf_dir, "conversations")
    return v.select("conv_id", "turn", "role", records.reranker_query(F.lit(" g "), history, F.col("text"), F.lit(" "), F.lit(None).cast("string")).alias("reranker_query"))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations)
SELECT conv_id, turn, role, place::BIGINT AS rank_in_prompt, CASE WHEN turn % 2 = 0 THEN 100 + turn ELSE place END::BIGINT AS retrieved_rank, place::BIGINT AS final_rank, turn / 2.0 AS distance, 'top' AS strategy, turn > 0 AS context_provided, 100 AS top_k FROM c""")
def prompt_log(spark, sf_dir):
    """Missing ranks filled, and what the prompt's ranking and the step's log keep of a row."""
    v = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, 100 + F.col("turn")).alias("retrieved_rank"), F.lit(None).cast("long").alias("final_rank"))
    rows = runs.with_ranks(v, "conv_id", ["turn", "role"])
    row = {"id": F.col("role"), "task": F.lit("t"), "variation": F.col("conv_id"), "retrieved_rank": F.col("retrieved_rank"), "final_rank": F.col("final_rank"), "distance": F.col("turn") / 2, "success": F.lit(None).cast("boolean")}
    entry = records.prompt_entry(F.col("final_rank"), row)
    log = records.step_log("top", F.array(F.col("role")), F.when(F.col("turn") > 0, F.col("role")).otherwise(" "), {"id": F.col("role"), "score": F.col("turn") / 2})
    return rows.select("conv_id", "turn", "role", entry.alias("e"), log.alias("l")).select("conv_id", "turn", "role", "e.rank_in_prompt", "e.retrieved_rank", "e.final_rank", "e.distance", "l.strategy", "l.context_provided", "l.top_k")


@query("""WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey::VARCHAR END AS k FROM customer), g AS (SELECT o_custkey::VARCHAR AS k, min(o_totalprice) AS score FROM orders GROUP BY 1) SELECT c_custkey, score FROM o LEFT JOIN g USING (k)""")
def provenance_scores(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey")).alias("k"))
    gold = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return runs.provenance(asked, gold, ["k"], {"score": F.col("o_totalprice")}).select("c_custkey", "score")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, 8 - l_linenumber AS place FROM lineitem WHERE l_linenumber % 3 > 0) SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS rank FROM a""")
def answer_order(spark, sf_dir):
    """An answer that names two of three candidates backwards, and one that is not there."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("rank"))
    named = lines.filter("l_linenumber % 3 > 0").select("l_orderkey", (8 - F.col("l_linenumber")).alias("place"), "l_linenumber")
    unknown = lines.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("place"), F.lit(99).alias("l_linenumber"))
    return runs.in_answer_order(named.unionByName(unknown), lines, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "rank")


@query("""SELECT 'source' AS field, source AS value, 'evaluation' AS side FROM documents WHERE doc_id % 3 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 3 = 1) ORDER BY source LIMIT 10""")
def overlap_sample(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return runs.shared_rows(docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1"), "source")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (user_id % 4 = 0) AS hits, round(coalesce(avg(CASE WHEN user_id % 4 <> 0 THEN value END), 0.0), 6) AS mean_batch, round(count(*) FILTER (user_id % 4 = 0) / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY 1")
def cache_usage(spark, sf_dir):
    return runs.usage(read(spark, sf_dir, "events"), ["event_type"], F.col("user_id") % 4 == 0, F.col("value"))


_NUMBERS = ", ".join(f"round(avg({c}), 6) AS mean_{n}, round(stddev_pop({c}), 6) AS std_{n}, min({c}) AS min_{n}, max({c}) AS max_{n}" for c, n in (("total_steps", "steps"), ("final_score", "score")))


@query(f"""WITH e AS (SELECT event_type AS task, user_id, count(*) AS total_steps, round(arg_max(value, (ts, event_id)) / 50, 0) AS final_score FROM events GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN task = 'click' THEN CASE final_score WHEN 1 THEN 'success' WHEN 0 THEN 'failure' ELSE 'in_progress' END WHEN final_score >= 1 THEN 'success' WHEN final_score <= 0 THEN 'failure' ELSE 'in_progress' END AS class FROM e),
b AS (SELECT task, total_steps, final_score, unnest(CASE WHEN class = 'failure' THEN [class, 'all'] ELSE [class, 'not_failed', 'all'] END) AS block FROM c),
r AS (SELECT task, block, count(*) AS episodes, grouping(task) AS every, {_NUMBERS} FROM b GROUP BY GROUPING SETS ((task, block), (block)))
SELECT task, block, episodes, round(episodes / (max(CASE WHEN block = 'all' THEN episodes END) OVER (PARTITION BY task, every))::DOUBLE, 6) AS share, mean_steps, std_steps, min_steps, max_steps, mean_score, std_score, min_score, max_score FROM r""")
def class_blocks(spark, sf_dir):
    last = F.max(F.struct("ts", "event_id", "value"))
    found = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), "user_id").agg(F.count(F.lit(1)).alias("total_steps"), last.alias("last"))
    found = found.withColumn("final_score", F.round(F.col("last.value") / 50, 0))
    environment = F.when(F.col("task") == "click", "A").otherwise("B")
    found = found.withColumn("class", evaluation.episode_class(environment, F.col("final_score"), F.col("total_steps")))
    return evaluation.class_blocks(found)


@query("""SELECT event_id, count(*) OVER w AS trajectory_length, first_value(value >= 50) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS trajectory_success FROM events WINDOW w AS (PARTITION BY user_id)""")
def trajectory_outcomes(spark, sf_dir):
    return evaluation.outcomes(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") >= 50).select("event_id", "trajectory_length", "trajectory_success")


@query("""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS retrieved_rank, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS stage1_rank, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS stage2_rank FROM events)
SELECT *, round(1.0::DOUBLE / stage2_rank - 1.0::DOUBLE / retrieved_rank, 6) AS gain FROM r""")
def stage_ranks(spark, sf_dir):
    """A user's events as a candidate list: ranked by time, by value and by type."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    ranked = evaluation.stage_ranks(rows, "user_id", {"retrieved_rank": ["ts", "event_id"], "stage1_rank": [F.desc("value"), "event_id"], "stage2_rank": ["event_type", "event_id"]})
    ranks = [F.col(c).cast("long").alias(c) for c in ("retrieved_rank", "stage1_rank", "stage2_rank")]
    return ranked.select("event_id", *ranks, evaluation.rank_gain("retrieved_rank", "stage2_rank").alias("gain"))
