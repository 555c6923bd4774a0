"""Registered queries over runs, keys, samples and sets, with DuckDB SQL for the same rows; stand-ins as in the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.catalog import candidates, query, read
from stepforge.functions import responses
from stepforge.functions.documents import find_key
from stepforge.functions import text as tx
from stepforge.operators import chunks, ranking, runs, splits

# ---- keys and names ----------------------------------------------------------------------------------------------

KEYS = """k AS (SELECT doc_id, trim(coalesce(lang, '')) AS goal, trim(coalesce(text, '')) AS state, CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(coalesce(source, '')) END AS context, 'step_till_now: ' || (doc_id % 9) AS progress FROM documents),
f AS (SELECT *, 'goal: ' || goal || ' | state: ' || state || ' | context: ' || context || ' | progress: ' || progress AS "full" FROM k)"""


def keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    docs = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return docs, tx.components(F.col("lang"), F.col("text"), F.when(i % 3 > 0, F.col("source")), F.concat(F.lit("step_till_now: "), (i % 9).cast("string")))


@query("WITH " + KEYS + ' SELECT doc_id, md5("full") AS full_md5, goal, length(state) AS state_chars, context, progress FROM f')
def text_components(spark, sf_dir):
    docs, parts = keyed(spark, sf_dir)
    return docs.select("doc_id", F.md5(parts["full"]).alias("full_md5"), parts["goal"].alias("goal"), F.length(parts["state"]).cast("long").alias("state_chars"), parts["context"].alias("context"), parts["progress"].alias("progress"))


@query("WITH " + KEYS + """ SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN 'kept key' ELSE "full" END) AS raw_md5, CASE WHEN doc_id % 10 = 0 THEN 'id' || doc_id ELSE 'set_' || md5(CASE WHEN doc_id % 4 = 0 THEN 'kept key' ELSE "full" END) END AS document,
CASE WHEN doc_id % 5 = 0 THEN 'run' || doc_id ELSE (doc_id % 7) || '|||' || coalesce(source, '') || '|||' || coalesce(lang, '') END AS entry FROM f JOIN documents USING (doc_id)""")
def document_ids(spark, sf_dir):
    docs, parts = keyed(spark, sf_dir)
    i = F.col("doc_id")
    raw = tx.raw_key(F.when(i % 4 == 0, F.lit(" kept key ")), parts)
    own = tx.document_id(F.when(i % 10 == 0, F.concat(F.lit("id"), i.cast("string"))), "set", raw)
    entry = tx.entry_id(F.when(i % 5 == 0, F.concat(F.lit("run"), i.cast("string"))), i % 7, F.col("source"), F.col("lang"))
    return docs.select("doc_id", F.md5(raw).alias("raw_md5"), own.alias("document"), entry.alias("entry"))


@query("""SELECT conv_id, turn, md5('goal: ' || role || ' | state: observation: ' || text || ' | context: ' || context || ' | progress: step_till_now: ' || turn) AS plain, md5('goal: ' || role || ' | state: observation: ' || text || ' | context: ' || context || ' | progress: step_till_now: ' || turn || ' | current_reward: ' || (turn % 2)) AS rewarded
FROM (SELECT *, coalesce(string_agg('observation: ' || text || ' | action: ' || role, ' ; ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations)""")
def query_texts(spark, sf_dir):
    entry = F.concat(F.lit("observation: "), "text", F.lit(" | action: "), "role")
    turn, w = F.col("turn").cast("string"), chunks.steps_window("conv_id", "turn")
    progress = F.concat(F.lit("step_till_now: "), turn)
    make = lambda p: F.md5(tx.full_key(F.col("role"), F.concat(F.lit("observation: "), "text"), F.col("context"), p))
    rewarded = F.concat(progress, F.lit(" | current_reward: "), (F.col("turn") % 2).cast("string"))
    return read(spark, sf_dir, "conversations").withColumn("context", chunks.context(entry, w)).select("conv_id", "turn", make(progress).alias("plain"), make(rewarded).alias("rewarded"))


@query("""SELECT page_id, 'variation_id_' || md5(CASE WHEN page_id % 2 = 0 THEN 'json_2.1.1/' || url ELSE url END) AS variation, CASE page_id % 4 WHEN 0 THEN 'unseen' WHEN 1 THEN 'seen' WHEN 2 THEN 'unseen' ELSE 'other' END AS tag,
CASE page_id % 3 WHEN 0 THEN 7 WHEN 1 THEN floor((page_id % 50) * 1.5)::BIGINT ELSE page_id % 50 END AS max_steps FROM pages""")
def path_names(spark, sf_dir):
    i, url = F.col("page_id"), F.col("url")
    path = F.concat(F.when(i % 2 == 0, F.lit("/data/json_2.1.1/")).otherwise(F.lit("")), url)
    where = F.when(i % 4 == 0, "/data/valid_unseen/x").when(i % 4 == 1, "/data/valid_seen/x").when(i % 4 == 2, "/x_Unseen").otherwise("/train/x")
    limit = F.when(i % 3 == 0, F.lit("7")).when(i % 3 == 1, F.lit("1.5_given"))
    return read(spark, sf_dir, "pages").select("page_id", tx.variation_id(path, "json_2.1.1").alias("variation"), tx.split_tag(where).alias("tag"), tx.step_limit(i % 50, limit).alias("max_steps"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS agent, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE -1 END::BIGINT AS whole, CASE WHEN p_partkey % 3 = 1 THEN p_size + 0.5 END::DOUBLE AS number, CASE WHEN p_partkey % 3 = 2 THEN p_name END AS word FROM part""")
def tagged_scalars(spark, sf_dir):
    i = F.col("p_partkey")
    stored = F.when(i % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).when(i % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_name"))
    whole, number, word = tx.tagged_scalar(stored)
    return read(spark, sf_dir, "part").select("p_partkey", tx.sanitised(F.col("p_brand")).alias("agent"), F.coalesce(whole, F.lit(-1)).cast("long").alias("whole"), number.alias("number"), word.alias("word"))


@query("SELECT conv_id, string_agg('Step ' || (turn + 1) || ': ' || role || ' ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations WHERE turn < 3 GROUP BY 1")
def prompt_steps(spark, sf_dir):
    """The first three steps of each dialogue as numbered lines."""
    line = F.concat(F.lit("Step "), (F.col("turn") + 1).cast("string"), F.lit(": "), "role", F.lit(" "), "text")
    first = read(spark, sf_dir, "conversations").filter("turn < 3")
    return first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines")).select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS combo FROM lineitem GROUP BY 1")
def site_combos(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("combo"))


@query("SELECT event_id, coalesce(regexp_extract(props, '\"k\": *(\\d+)', 1), '')::BIGINT AS k, length(props) AS chars FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.length("props").cast("long").alias("chars"))


@query("SELECT event_id, event_id % 3 < 2 AS found, CASE WHEN event_id % 3 = 0 THEN regexp_extract(props, '\"k\": *(\\d+)', 1) END AS value FROM events")
def json_search(spark, sf_dir):
    """A key at any depth: in nested lists, with an explicit null, and not at all."""
    i = F.col("event_id")
    made = F.when(i % 3 == 0, F.concat(F.lit('{"a": 1, "b": [{"c": {}}, '), "props", F.lit(', {"k": 0}]}'))).when(i % 3 == 1, '{"x": {"k": null}, "y": {"k": 1}}').otherwise('{"a": [1, "k"]}')
    return read(spark, sf_dir, "events").select("event_id", find_key(made, "k").alias("f")).select("event_id", "f.found", "f.value")


# ---- filters over runs -------------------------------------------------------------------------------------------

EPISODE = "e AS (SELECT event_type AS task, user_id, arg_max(value, (ts, event_id)) AS last, bool_or(event_id % 50 = 0) AS flagged, count(*) AS n FROM events GROUP BY 1, 2)"


@query("WITH " + EPISODE + " SELECT task, user_id, NOT flagged AS convertible, last >= 50 AS last_succeeded, n AS steps FROM e")
def success_filters(spark, sf_dir):
    step = F.struct("ts", "event_id", (F.col("event_id") % 50 == 0).alias("flag"), F.lit(True).alias("done"), (F.col("value") >= 50).cast("int").alias("success"))
    episodes = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), "user_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return episodes.select("task", "user_id", runs.unflagged(F.col("steps"), "flag").alias("convertible"), runs.last_succeeded(F.col("steps")).alias("last_succeeded"), F.size("steps").cast("long").alias("steps"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN floor(value / 50) = 1 ELSE floor(value / 50) >= 1 END AS success, event_id % 3 = 0 OR event_id % 5 = 0 AS problem FROM events")
def episode_filters(spark, sf_dir):
    i, score = F.col("event_id"), F.floor(F.col("value") / 50)
    record = F.parse_json(F.when(i % 3 == 0, '{"trajectory": null}').when(i % 3 == 1, '{"trajectory": [1]}').otherwise("{}"))
    steps = F.when(i % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return read(spark, sf_dir, "events").select("event_id", runs.succeeded(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"), score).alias("success"), runs.problem(steps, record).alias("problem"))


@query("SELECT l_partkey % 500 AS comp, count(*) FILTER (l_linenumber > 1) AS simulations FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber > 1) > 0")
def comparison_prefilter(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("comp")).agg(F.count_if(F.col("l_linenumber") > 1).alias("simulations")).filter("simulations > 0")


@query("SELECT lang, count(*) AS total, count(*) FILTER (text IS NULL OR trim(text) = '') AS failed, count(*) FILTER (NOT (text IS NULL OR trim(text) = '') AND n_chars < 200) AS missing, count(*) FILTER (NOT (text IS NULL OR trim(text) = '') AND n_chars >= 200) AS kept FROM documents GROUP BY 1")
def row_skips(spark, sf_dir):
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    short = F.col("n_chars") < 200
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(blank).alias("failed"), F.count_if(~blank & short).alias("missing"), F.count_if(~blank & ~short).alias("kept"))


@query("SELECT page_id, url FROM pages WHERE NOT (url LIKE '%a%' AND url LIKE '%en%') AND url NOT LIKE '%net/z%'")
def site_exclusion(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").filter(~(F.contains(url, F.lit("a")) & F.contains(url, F.lit("en"))) & ~F.contains(url, F.lit("net/z"))).select("page_id", "url")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 100 AND i < 1200")
def eval_slice(spark, sf_dir):
    return runs.sliced(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 1200).select("o_orderkey", "o_totalprice")


@query("WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id, i AS step FROM s WHERE i < least(user_id % 7 + 2, 6)")
def step_cutoffs(spark, sf_dir):
    i = F.row_number().over(chunks.steps_window("user_id", "ts", "event_id")) - 1
    steps = read(spark, sf_dir, "events").withColumn("step", i.cast("long"))
    return steps.filter(F.col("step") < F.least(F.col("user_id") % 7 + 2, F.lit(6))).select("event_id", "step")


# ---- sums over runs ----------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS skipped,
round(count(*) FILTER (o_orderstatus = 'F') / greatest(count(*) FILTER (o_orderstatus IN ('F', 'O')), 1)::DOUBLE, 6) AS success_rate FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def run_totals(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("skip", ~F.col("o_orderstatus").isin("F", "O"))
    success, skipped = F.col("o_orderstatus") == "F", F.col("skip")
    each = runs.totals(orders, ["o_orderpriority"], success, skipped)
    return each.unionByName(runs.totals(orders, [], success, skipped).withColumn("o_orderpriority", F.lit(None).cast("string")))


@query("SELECT event_type, max(value) AS max_score, min(value) AS min_score, round(sum(value) / greatest(count(*), 1), 6) AS mean_score, round(count(*) FILTER (value >= 50) / greatest(count(*), 1)::DOUBLE, 6) AS success_rate, round(sum(length(props)) / greatest(count(*), 1)::DOUBLE, 6) AS mean_retrieved_length FROM events GROUP BY 1")
def enhanced_metrics(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("length", F.length("props"))
    return runs.metrics(events, ["event_type"], "value", F.col("value") >= 50, "length")


@query("""SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS completed, round(avg((o_orderstatus = 'F')::INT), 4) AS rate, round(avg(o_totalprice), 2) AS mean_score, round(avg(o_custkey % 40), 1) AS mean_steps, round(avg(o_orderkey % 100), 2) AS mean_seconds,
string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS variations FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def run_table(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.count_if(done).alias("completed"), F.round(F.avg(done.cast("double")), 4).alias("rate"), F.round(F.avg("o_totalprice"), 2).alias("mean_score"), F.round(F.avg(F.col("o_custkey") % 40), 1).alias("mean_steps"),
        F.round(F.avg(F.col("o_orderkey") % 100), 2).alias("mean_seconds"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("variations"),
    )


@query("WITH t AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)) SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE trim(text) <> '') AS non_empty, count(DISTINCT term) AS vocabulary FROM t")
def corpus_metadata(spark, sf_dir):
    from stepforge.operators.ranking import terms

    docs = read(spark, sf_dir, "documents")
    n, some = docs.agg(F.count(F.lit(1)), F.count_if(F.trim("text") != "")).first()
    words = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    return words.agg(F.lit(n).cast("long").alias("documents"), F.lit(some).cast("long").alias("non_empty"), F.count(F.lit(1)).alias("vocabulary"))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS kinds, median(p_size)::DOUBLE AS median_steps FROM part GROUP BY 1")
def distribution_medians(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("kinds"), F.median("p_size").alias("median_steps"))


@query("""WITH u AS (SELECT 'p_brand' AS attribute, p_brand AS v, p_partkey % 10 = 0 AS held FROM part UNION ALL SELECT 'p_type', p_type, p_partkey % 10 = 0 FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR, p_partkey % 10 = 0 FROM part),
c AS (SELECT attribute, v, count(*) FILTER (held) AS a, count(*) FILTER (NOT held) AS b FROM u GROUP BY 1, 2) SELECT attribute, round(sum(abs(a / ta - b / tb)) / 2, 6) AS tvd FROM (SELECT *, (sum(a) OVER w)::DOUBLE AS ta, (sum(b) OVER w)::DOUBLE AS tb FROM c WINDOW w AS (PARTITION BY attribute)) GROUP BY 1""")
def shift_metrics(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    held = F.col("p_partkey") % 10 == 0
    return splits.shifts(part.filter(held), part.filter(~held), ["p_brand", "p_type", "p_size"])


@query("""WITH s AS (SELECT p_brand, p_type FROM part WHERE p_partkey % 10 = 0), r AS (SELECT count(*) AS combos FROM (SELECT DISTINCT p_brand, p_type FROM part)), g AS (SELECT count(*) AS covered FROM (SELECT DISTINCT p_brand, p_type FROM s)),
m AS (SELECT max(n) / sum(n)::DOUBLE AS top FROM (SELECT count(*) AS n FROM s GROUP BY p_brand)) SELECT combos, covered, combos - covered AS missing, round(covered / combos::DOUBLE, 6) AS rate, covered / combos::DOUBLE >= 0.35 AS enough, top <= 0.12 AS even FROM r, g, m""")
def coverage_checks(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    sample = part.filter("p_partkey % 10 = 0")
    combos = part.groupBy("p_brand", "p_type").agg(F.max((F.col("p_partkey") % 10 == 0).cast("int")).alias("held")).agg(F.count(F.lit(1)).alias("combos"), F.coalesce(F.sum("held"), F.lit(0)).alias("covered"))
    top = sample.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("top")).first()[0]
    share = F.col("covered") / F.col("combos")
    return combos.select("combos", "covered", (F.col("combos") - F.col("covered")).alias("missing"), F.round(share, 6).alias("rate"), (share >= 0.35).alias("enough"), (F.lit(top) <= 0.12).alias("even"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, string_agg(DISTINCT source, '|' ORDER BY source) AS names FROM documents GROUP BY 1")
def site_intents(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.array_join(F.sort_array(F.collect_set("source")), "|").alias("names"))


@query("SELECT conv_id, round(coalesce(avg(CASE WHEN role = 'assistant' THEN length(text) END), 0), 4) AS mean_length, CASE WHEN count(*) FILTER (turn % 2 = 1) > 0 THEN round(count(*) FILTER (turn % 4 = 1) / count(*) FILTER (turn % 2 = 1)::DOUBLE, 6) END AS coverage FROM conversations GROUP BY 1")
def retrieved_lengths(spark, sf_dir):
    """Mean length of what was retrieved in an episode (0 for nothing), and the share of attempts that were covered (null for none)."""
    tried, met = F.count_if(F.col("turn") % 2 == 1), F.count_if(F.col("turn") % 4 == 1)
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("role") == "assistant", F.length("text"))), F.lit(0.0)), 4).alias("mean_length"), F.round(F.try_divide(met, tried), 6).alias("coverage"))


# ---- alignment and lookups ---------------------------------------------------------------------------------------

ALIGN = """l AS (SELECT conv_id, turn, role, length(text) % 50 AS signature, conv_id % 5 AS task, turn % 3 AS variation FROM conversations WHERE conv_id % 2 = 1),
i AS (SELECT conv_id AS c, turn AS t, role AS r, length(text) % 50 AS s, conv_id % 5 AS task, turn % 3 AS variation FROM conversations WHERE conv_id % 3 > 0),
j AS (SELECT l.*, i.c, i.t, i.task = l.task AS st, i.variation = l.variation AS sv, i.c = l.conv_id AS same FROM l LEFT JOIN i ON r = role AND s = signature),
a AS (SELECT *, bool_or(st) OVER w AS any_t, bool_or(st AND sv) OVER w AS any_tv, bool_or(sv) OVER w AS any_v FROM j WINDOW w AS (PARTITION BY conv_id, turn)),
b AS (SELECT * FROM a WHERE c IS NULL OR CASE WHEN any_tv THEN st AND sv WHEN any_t THEN st WHEN any_v THEN sv ELSE true END),
n AS (SELECT conv_id, turn, count(c) AS n, bool_or(same) AS own, min(CASE WHEN same THEN c * 100000 + t END) AS first_own, min(c * 100000 + t) AS first_any FROM b GROUP BY 1, 2),
f AS (SELECT conv_id, turn, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'unique' WHEN own THEN 'same_document' ELSE 'first' END AS mode, CASE WHEN n > 1 AND own THEN first_own ELSE first_any END AS picked FROM n)"""


def aligned_turns(spark, sf_dir) -> DataFrame:
    v = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") % 50).alias("signature"), (F.col("conv_id") % 5).alias("task"), (F.col("turn") % 3).alias("variation"))
    return runs.aligned(v.filter("conv_id % 2 = 1"), v.filter("conv_id % 3 > 0"), ["role", "signature"], "task", "variation", "conv_id", "turn")


@query("WITH " + ALIGN + " SELECT conv_id, turn, status, mode, coalesce(picked // 100000, -1) AS picked_document, coalesce(picked % 100000, -1) AS picked_place FROM f")
def align_cascade(spark, sf_dir):
    picked = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("picked_document", "picked_place")]
    return aligned_turns(spark, sf_dir).select("conv_id", "turn", "status", "mode", *picked)


@query("WITH " + ALIGN + ", g AS (SELECT status, mode, count(*) AS n FROM f GROUP BY 1, 2) SELECT status, mode, n, round(sum(CASE WHEN status <> 'missing' THEN n ELSE 0 END) OVER () / (sum(n) OVER ())::DOUBLE, 6) AS match_rate FROM g")
def alignment_counts(spark, sf_dir):
    return runs.status_counts(aligned_turns(spark, sf_dir))


@query("WITH r AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1) SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, o_totalprice FROM customer LEFT JOIN r ON c_custkey = o_custkey")
def run_lookup(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select("c_custkey")
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = runs.first_match(asked, orders, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return found.withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1).cast("long")))


@query("SELECT user_id, event_type, string_agg(round(value, 2)::VARCHAR, ' ' ORDER BY ts, event_id) AS scores, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 4) AS gain FROM events GROUP BY 1, 2")
def score_progression(spark, sf_dir):
    step = F.struct("ts", "event_id", "value")
    out = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(step)).alias("s"))
    return out.select("user_id", "event_type", F.array_join(F.transform("s", lambda x: F.round(x["value"], 2).cast("string")), " ").alias("scores"), F.round(F.try_element_at("s", F.lit(-1))["value"] - F.try_element_at("s", F.lit(1))["value"], 4).alias("gain"))


@query(r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) || ' ' AS text FROM documents), b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) || ' ' AS item FROM benchmark WHERE trim(text) <> '')
SELECT doc_id, item_id FROM d JOIN b ON contains(d.text, item)""")
def leakage_items(spark, sf_dir):
    """Benchmark items that stand word by word in a document."""
    return runs.containing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")


# ---- sets and samples --------------------------------------------------------------------------------------------


@query("SELECT min(vec_id) AS vec_id, count(*) AS copies FROM embeddings GROUP BY embedding")
def vector_dedup(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")).select("vec_id", "copies")


@query("SELECT min(conv_id) AS conv_id, count(*) AS copies FROM (SELECT conv_id, string_agg(role || chr(1) || text, chr(2) ORDER BY turn) AS body FROM conversations GROUP BY 1) GROUP BY body")
def staging_dedup(spark, sf_dir):
    """Whole trajectories of equal content, without their ids: the first of each stays."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))))
    bodies = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(body.alias("body"))
    return bodies.groupBy("body").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).select("conv_id", "copies")


@query("SELECT event_type, count(*) AS episodes, count(DISTINCT user_id) AS users FROM (SELECT event_type, user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, user_id FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def union_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    both = e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 3 = 0"), allowMissingColumns=True)
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("episodes"), F.count_distinct("user_id").alias("users"))


@query("SELECT source, lang FROM documents WHERE doc_id % 10 = 0 INTERSECT SELECT source, lang FROM documents WHERE doc_id % 10 = 1")
def overlap_fields(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.filter("doc_id % 10 = 0").select("source", "lang").intersect(docs.filter("doc_id % 10 = 1").select("source", "lang"))


def _share(level: str, up: str, of: str) -> str:
    return f"""{level}1 AS (SELECT *, quota * cap / (sum(cap) OVER w)::DOUBLE AS raw FROM {of} WINDOW w AS ({up})),
{level}2 AS (SELECT *, floor(raw) AS low, round(raw - floor(raw), 9) AS fraction FROM {level}1),
{level}3 AS (SELECT *, quota - sum(low) OVER ({up}) AS spare, row_number() OVER ({up} ORDER BY fraction DESC, cap DESC, {level} DESC) AS turn FROM {level}2)"""


NESTED = f"""WITH c AS (SELECT p_brand, p_type, count(*) AS cap FROM part GROUP BY 1, 2), b0 AS (SELECT p_brand, sum(cap) AS cap, 150 AS quota FROM c GROUP BY 1),
{_share('p_brand', '', 'b0')}, q AS (SELECT p_brand, low + (turn <= spare)::INT AS got FROM p_brand3),
t0 AS (SELECT c.*, got AS quota FROM c JOIN q USING (p_brand)), {_share('p_type', 'PARTITION BY p_brand', 't0')},
f AS (SELECT p_brand, p_type, cap, (low + (turn <= spare)::INT)::BIGINT AS quota FROM p_type3)"""


@query(NESTED + " SELECT p_brand, p_type, quota FROM f")
def nested_quotas(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("cap"))
    return splits.nested_quotas(counts, ["p_brand", "p_type"], 150)


@query(NESTED + ", k AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY md5('h1' || p_partkey), p_partkey) AS pick FROM part) SELECT p_partkey, p_brand, p_type FROM k JOIN f USING (p_brand, p_type) WHERE pick <= quota")
def hierarchical_sample(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("stratum", F.concat_ws("|", "p_brand", "p_type"))
    counts = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("cap"))
    quotas = splits.nested_quotas(counts, ["p_brand", "p_type"], 150).select(F.concat_ws("|", "p_brand", "p_type").alias("stratum"), "quota")
    return splits.stratified(part, "stratum", "p_partkey", quotas, "h1").select("p_partkey", "p_brand", "p_type")


@query("WITH c AS (SELECT p_type, greatest(1, floor(0.1::DOUBLE * count(*)))::BIGINT AS quota FROM part GROUP BY 1), k AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5('v' || p_partkey), p_partkey) AS pick FROM part) SELECT p_partkey, p_type FROM k JOIN c USING (p_type) WHERE pick <= quota")
def proportional_split(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    quotas = splits.proportional(part.groupBy("p_type").agg(F.count(F.lit(1)).alias("cap")), "p_type", 0.1)
    return splits.stratified(part, "p_type", "p_partkey", quotas, "v").select("p_partkey", "p_type")


@query("WITH b AS (SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'easy' WHEN p_size <= 17 THEN 'medium' ELSE 'hard' END AS band FROM part) SELECT p_partkey, band, CASE WHEN row_number() OVER (PARTITION BY band ORDER BY md5('s2' || p_partkey), p_partkey) <= 100 THEN 'validation' ELSE 'test' END AS part FROM b")
def band_split(spark, sf_dir):
    band = F.when(F.col("p_size") <= 10, "easy").when(F.col("p_size") <= 17, "medium").otherwise("hard")
    return splits.held_out(read(spark, sf_dir, "part").select("p_partkey", band.alias("band")), "band", "p_partkey", "s2", 100)


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) FILTER (role <> last OR last <> 'user') AS left_over FROM (SELECT *, last_value(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM conversations) GROUP BY 1")
def unrepeated_actions(spark, sf_dir):
    spoken = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.max_by("role", "turn").alias("last"))
    rest = F.array_join(runs.unrepeated(F.col("roles"), F.array(F.lit("user")), F.col("last")), ",")
    return spoken.select("conv_id", F.nullif(rest, F.lit("")).alias("left_over"))


# ---- ranks, answers and causes -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey AS q, l_partkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS rank FROM lineitem),
u AS (SELECT q, d, 0 AS part, rank FROM r WHERE rank <= 3 AND d % 2 = 0 UNION ALL SELECT q, d, 1, rank FROM r), m AS (SELECT q, d, min(part * 1000 + rank) AS pos FROM u GROUP BY 1, 2) SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY pos, d) AS rank FROM m""")
def stage_merge(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_linenumber")
    ranked = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("d"), F.row_number().over(order).alias("rank"))
    return runs.stage_merge(ranked.filter("rank <= 3 and d % 2 = 0"), ranked, "q", "d")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN '' ELSE 'B' END AS choice, least(p_partkey, p_size) || '|' || greatest(p_partkey, p_size) AS pair, p_partkey > p_size AS flipped FROM part")
def pair_choices(spark, sf_dir):
    i = F.col("p_partkey")
    answer = F.when(i % 6 == 0, "Passage\n A").when(i % 6 == 1, "the answer: b").when(i % 6 == 2, " a ").when(i % 6 == 3, "I take b.").when(i % 6 == 4, "A or B?").otherwise("option b, not option a... OPTION B")
    answer = F.when(i % 6 == 5, "choose B now").otherwise(answer)
    low, high = F.least(i, F.col("p_size")), F.greatest(i, F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", runs.choice(answer).alias("choice"), F.concat_ws("|", low.cast("string"), high.cast("string")).alias("pair"), (i > F.col("p_size")).alias("flipped"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'trajectory context' WHEN 1 THEN 'incomplete/partial' WHEN 2 THEN 'similar words' ELSE 'not sure' END AS cause FROM events")
def action_causes(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    action = F.when(i % 4 == 1, F.concat(F.lit("Open "), kind)).when(i % 4 == 2, F.concat(F.lit("take red "), kind, F.lit(" now"))).otherwise(F.concat(F.lit("go to "), kind))
    context = F.when(i % 4 == 0, F.concat(F.lit("step 3: GO to "), kind, F.lit(" then stop"))).otherwise(F.lit(""))
    options = F.when(i % 4 == 3, F.array(F.lit("sleep"))).otherwise(F.array(F.concat(F.lit("open "), kind, F.lit(" door")), F.concat(F.lit("red "), kind, F.lit(" stays"))))
    return read(spark, sf_dir, "events").select("event_id", runs.cause(action, context, options).alias("cause"))


# ---- answers, quotas under capacities, comparison passes ---------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, role, text, turn % 4 AS form FROM conversations),
p AS (SELECT *, CASE form WHEN 0 THEN 'fenced' WHEN 3 THEN 'none' ELSE 'json' END AS kind, CASE WHEN form < 3 THEN role END AS action, CASE form WHEN 0 THEN trim(text, chr(9) || chr(10) || chr(13) || ' ') WHEN 1 THEN text WHEN 2 THEN 'go {on}' ELSE '' END AS reasoning FROM t)
SELECT conv_id, turn, role, kind AS form, action, md5(reasoning) AS reasoning, CASE WHEN kind = 'none' THEN 'json_parse' WHEN action = 'user' THEN 'ok' ELSE 'invalid_action' END AS status FROM p""")
def parsed_responses(spark, sf_dir):
    """Answers made of each turn: fenced, a JSON object in prose, one after braces that are none, and neither."""
    v, form = read(spark, sf_dir, "conversations"), F.col("turn") % 4
    as_json = F.to_json(F.struct(F.col("text").alias("reasoning"), F.col("role").alias("action")))
    fenced = F.concat("text", F.lit("\nIn summary, the next action I will perform is ```"), "role", F.lit("``` or ```none```"))
    broken = F.concat(F.lit("a {set} of {x: "), F.to_json(F.struct(F.lit("go {on}").alias("reasoning"), F.col("role").alias("action"))), F.lit(" and more"))
    answer = F.when(form == 0, fenced).when(form == 1, F.concat(F.lit("Sure: "), as_json, F.lit(" }"))).when(form == 2, broken).otherwise(F.regexp_replace("text", "[{}]", ""))
    made = v.select("conv_id", "turn", "role", responses.parsed_response(answer).alias("p")).select("conv_id", "turn", "role", "p.*")
    status = responses.response_status(F.col("form"), F.col("action"), responses.listed_action(F.col("action"), F.array(F.lit("user"))))
    return made.select("conv_id", "turn", "role", "form", "action", F.md5("reasoning").alias("reasoning"), status.alias("status"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN user_id % 2 = 0 WHEN 2 THEN false ELSE false END AS element_valid, user_id % 3 = 0 AS listed FROM events""")
def action_validity(spark, sf_dir):
    """Standard verbs, verbs of elements that are on the page or not, other verbs, and no verb; and plain membership."""
    e, i, u = read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id").cast("string")
    action = F.when(i % 4 == 0, F.concat(F.lit(" scroll ["), u, F.lit("] "))).when(i % 4 == 1, F.concat(F.lit("click ["), u, F.lit("] fast"))).when(i % 4 == 2, F.concat(F.lit("drag ["), u, F.lit("]"))).otherwise("type")
    elements = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("x"), u)).otherwise(F.array(F.lit("x")))
    admissible = F.when(F.col("user_id") % 3 == 0, F.array("event_type", F.lit("x")))
    return e.select("event_id", responses.element_action(action, elements).alias("element_valid"), responses.listed_action(F.col("event_type"), admissible).alias("listed"))


CAPPED = """WITH c AS (SELECT p_type, count(*) AS cap FROM part GROUP BY 1), g AS (SELECT *, least(cap, 1) AS first FROM c), t AS (SELECT floor(0.6 * sum(cap)) AS total, sum(first) AS given FROM g),
r AS (SELECT *, cap - first AS room, total - given AS rest, sum(cap - first) OVER () AS rooms FROM g, t), f AS (SELECT *, floor(rest * room / rooms)::BIGINT AS low FROM r),
q AS (SELECT *, rest - sum(low) OVER () AS spare, row_number() OVER (ORDER BY room > low DESC, rest * room - low * rooms DESC, cap DESC, p_type DESC) AS turn FROM f)
SELECT p_type, cap, (first + low + (turn <= spare)::INT)::BIGINT AS quota FROM q"""


@query(CAPPED.replace("rest * room / rooms", "(rest * room)::HUGEINT // rooms"))
def capped_quotas(spark, sf_dir):
    strata = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("cap"))
    return splits.capped_quotas(strata, "p_type", int(read(spark, sf_dir, "part").count() * 0.6), 1)


@query("SELECT 'test' AS part, least(100, (SELECT count(*) FROM part))::BIGINT AS n UNION ALL SELECT 'validation', (SELECT count(*) FROM part) - 100")
def split_sizes(spark, sf_dir):
    """A test split of exactly 100 rows over the brands, each of which is in it."""
    out = splits.split_sample(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 100, "s2")
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_TVD = "SELECT '{0}' AS attribute, 'variation' AS kind, round(sum(abs(coalesce(a.n, 0) / (SELECT count(*) FROM l)::DOUBLE - coalesce(b.n, 0) / (SELECT count(*) FROM r)::DOUBLE)) / 2, 6) AS distance FROM (SELECT {1} AS k, count(*) AS n FROM l GROUP BY 1) a FULL JOIN (SELECT {1} AS k, count(*) AS n FROM r GROUP BY 1) b USING (k)"
_GROUPS = {"p_brand": "p_brand", "p_container": "p_container", "p_mfgr": "p_mfgr", "p_brand+p_container": "p_brand || p_container", "p_brand+p_mfgr": "p_brand || p_mfgr", "p_container+p_mfgr": "p_container || p_mfgr", "p_brand+p_container+p_mfgr": "p_brand || p_container || p_mfgr"}


@query(f"""WITH l AS (SELECT p_brand, coalesce(p_type, '') AS p_container, split_part(p_type, ' ', 1) AS p_mfgr, p_size FROM part WHERE p_partkey % 5 = 0), r AS (SELECT p_brand, coalesce(p_type, '') AS p_container, split_part(p_type, ' ', 1) AS p_mfgr, p_size FROM part)
{' UNION ALL '.join(_TVD.format(n, e) for n, e in _GROUPS.items())} UNION ALL SELECT 'p_size', 'median_gap', round(abs((SELECT quantile_cont(p_size, 0.5) FROM l) - (SELECT quantile_cont(p_size, 0.5) FROM r)), 6)""")
def shift_distances(spark, sf_dir):
    """A fifth of the parts against all: seven distances and the gap of the medians."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.coalesce("p_type", F.lit("")).alias("p_container"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("p_mfgr"), "p_size")
    return splits.shift_report(part.filter("p_partkey % 5 = 0"), part, ["p_brand", "p_container", "p_mfgr"], "p_size")


@query(None)
def pass_sorted(spark, sf_dir):
    """The candidates of each query by five passes of comparisons that contradict each other."""
    better = F.expr("(l.vec_id * 7 + r.vec_id * 3) % 5 < 2")
    return ranking.pass_sorted(candidates(spark, sf_dir), "query_id", "vec_id", better, 5).select("query_id", "vec_id", "rank", "final_rank")
