"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can say it.

Stand-ins: embeddings are memory rows (label is the task, vec_id % 4 the variation); conversations are trajectories of
turns; events are episodes of a user and day; lineitem rows are runs; part sizes are step counts. Searches take every
row whose id is divisible by 100 as a query, or every benchmark item, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions import similarity
from stepforge.functions import text as tx
from stepforge.operators import boosting, chunks, clusters, evaluation, ivf, models, pq, ranking, retrieval, splits, text_clusters
from stepforge.operators.order import shared_dir
from stepforge.streaming import push, triggers, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def counted(df: DataFrame) -> DataFrame:
    """Ranks and numbers as long, as SQL counts them."""
    return df.withColumns({c: F.col(c).cast("long") for c in df.columns if c in ("rank", "final_rank", "qid", "pick", "llm_rank")})


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: counted(f(spark, sf_dir))
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- retrieval ---------------------------------------------------------------------------------------------------

PAIRS = """m AS (SELECT vec_id, label AS task, vec_id % 4 AS variation, embedding FROM embeddings),
p AS (SELECT q.vec_id AS query_id, m.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
      FROM m q, m WHERE q.vec_id % 100 = 0 AND {0}),
r AS (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)"""
TOP = "WITH " + PAIRS + " SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 10"
WHERE = {
    "none": "true",
    "different_task_or_variation": "NOT (q.task = m.task AND q.variation = m.variation)",
    "different_task": "q.task <> m.task",
    "same_task": "q.task = m.task",
    "same_task_different_variation": "q.task = m.task AND q.variation <> m.variation",
    "same_task_same_variation": "q.task = m.task AND q.variation = m.variation",
}


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("task"), (F.col("vec_id") % 4).alias("variation"), "embedding")


def top(spark: SparkSession, sf_dir: str, diversity: str = "none", k: int = 10, only=None) -> DataFrame:
    m = memory(spark, sf_dir)
    return retrieval.vector_topk(m if only is None else m.filter(only), m.filter("vec_id % 100 = 0"), k, diversity)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


for _kind, _where in WHERE.items():
    query(TOP.format(_where), "vec_topk_l2" if _kind == "none" else f"vec_topk_{_kind}")(lambda spark, sf_dir, kind=_kind: rounded(top(spark, sf_dir, kind)))


@query(TOP.format("m.vec_id % 2 = 1"))
def vec_topk_base_filter(spark, sf_dir):
    return rounded(top(spark, sf_dir, only=F.col("vec_id") % 2 == 1))


@query("WITH " + PAIRS.format("true") + " SELECT query_id, round(avg(d), 6) AS mean_distance, round(stddev_pop(d), 6) AS std_distance, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1")
def vec_topk_stats(spark, sf_dir):
    return retrieval.topk_stats(top(spark, sf_dir))


@query("WITH " + PAIRS.format(WHERE["same_task_same_variation"]) + ", n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE rank <= 10) SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM n WHERE rank = CASE WHEN n < 7 THEN 1 ELSE 7 END")
def vec_rank_retrieve(spark, sf_dir):
    return rounded(retrieval.pick_rank(top(spark, sf_dir, "same_task_same_variation"), 7))


@query("SELECT q.vec_id, count(m.vec_id) > 0 AS has_candidates FROM embeddings q LEFT JOIN (SELECT DISTINCT label, vec_id % 4 AS v, vec_id FROM embeddings WHERE vec_id % 2 = 1) m ON q.label = m.label AND q.vec_id % 4 <> m.v GROUP BY q.vec_id")
def preflight_candidates(spark, sf_dir):
    m = memory(spark, sf_dir)
    held = m.filter("vec_id % 2 = 1").groupBy("task").agg(F.min("variation").alias("low"), F.max("variation").alias("high"))
    found = m.join(held, "task", "left")
    other = (F.col("low") != F.col("variation")) | (F.col("high") != F.col("variation"))
    return found.select("vec_id", F.coalesce(other, F.lit(False)).alias("has_candidates"))


# ---- chunks ------------------------------------------------------------------------------------------------------

ENTRY = "'observation: ' || text || ' | action: ' || role"


def turns(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").withColumn("entry", F.concat(F.lit("observation: "), "text", F.lit(" | action: "), "role"))


CONTEXT_SQL = f"SELECT conv_id, turn, coalesce(string_agg({ENTRY}, ' ; ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations"


@query(CONTEXT_SQL)
def chunk_context(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", chunks.context(F.col("entry"), chunks.steps_window("conv_id", "turn")).alias("context"))


@query(f"SELECT conv_id, turn, string_agg({ENTRY}, ' ; ') OVER w AS guidance, count(*) OVER w AS steps, CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)")
def chunk_guidance(spark, sf_dir):
    w = chunks.steps_window("conv_id", "turn")
    out = turns(spark, sf_dir).select("conv_id", "turn", chunks.guidance(F.col("entry"), w).alias("g"), F.when(chunks.is_last(w), 1.0).otherwise(0.0).alias("score"))
    return out.select("conv_id", "turn", F.array_join("g", " ; ").alias("guidance"), F.size("g").cast("long").alias("steps"), "score")


@query("SELECT event_id, coalesce(lead(value) OVER w, value) AS next_reward, count(*) OVER (PARTITION BY user_id) AS trajectory_length FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def chunk_next_reward(spark, sf_dir):
    w = chunks.steps_window("user_id", "ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.lead("value").over(w), "value").alias("next_reward"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("trajectory_length"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def chunk_content_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1")
def chunk_key_dedup(spark, sf_dir):
    return chunks.first_of(read(spark, sf_dir, "conversations"), ["role", "text"], ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, coalesce(string_agg('STEP ' || (turn + 1) || ': OBSERVATION ' || text || ' | ACTION ' || role, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def history_string(spark, sf_dir):
    line = F.concat(F.lit("STEP "), (F.col("turn") + 1).cast("string"), F.lit(": OBSERVATION "), "text", F.lit(" | ACTION "), "role")
    w = chunks.steps_window("conv_id", "turn").rowsBetween(-3, -1)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(line).over(w), "\n").alias("history"))


@query("SELECT conv_id, turn, turn = 0 AS at_start, turn % 3 = 0 AS every_third, turn < 4 AS until_fourth, row_number() OVER (PARTITION BY conv_id, turn >= 2 ORDER BY turn) = 1 AND turn >= 2 AS once_from_second FROM conversations")
def retrieval_schedule(spark, sf_dir):
    t = F.col("turn")
    once = (F.row_number().over(Window.partitionBy("conv_id", t >= 2).orderBy("turn")) == 1) & (t >= 2)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", (t == 0).alias("at_start"), (t % 3 == 0).alias("every_third"), (t < 4).alias("until_fourth"), once.alias("once_from_second"))


@query("WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events) SELECT user_id, min(step) AS first_step FROM s WHERE value >= 50 GROUP BY 1")
def first_match_trigger(spark, sf_dir):
    steps = read(spark, sf_dir, "events").withColumn("step", (F.row_number().over(chunks.steps_window("user_id", "ts", "event_id")) - 1).cast("long"))
    return chunks.first_match(steps, "user_id", "step", F.col("value") >= 50)


@query(f"WITH c AS ({CONTEXT_SQL}) SELECT v.conv_id, v.turn, v.role AS goal, v.text AS state, c.context, 'step_till_now: ' || v.turn AS progress, v.turn::INTEGER AS step FROM conversations v JOIN c USING (conv_id, turn)")
def query_decompose(spark, sf_dir):
    w = chunks.steps_window("conv_id", "turn")
    keyed = turns(spark, sf_dir).select("conv_id", "turn", tx.full_key(F.col("role"), F.col("text"), chunks.context(F.col("entry"), w), F.concat(F.lit("step_till_now: "), F.col("turn").cast("string"))).alias("key"))
    return keyed.select("conv_id", "turn", *tx.decomposed(F.col("key")))


# ---- text --------------------------------------------------------------------------------------------------------

REST = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"


@query(f"SELECT page_id, CASE WHEN url = '' THEN '' WHEN {REST} = '' THEN '/' ELSE {REST} END AS local, regexp_replace({REST}, '[?#].*$', '') AS path FROM pages")
def url_path(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.url_local(F.col("url")).alias("local"), tx.url_path(F.col("url")).alias("path"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unknown') AS slug, lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS feature, CASE WHEN length(url) > 20 THEN substr(url, 1, 20) || '...' ELSE url END AS short FROM pages")
def normalised_names(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", tx.slug(url).alias("slug"), tx.feature_name(url).alias("feature"), tx.ellipsis(url, 20).alias("short"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace('[' || doc_id || '] ' || text, '\\[\\d+\\]', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS stripped FROM documents")
def id_strip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.squeezed(tx.without_ids(F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "text")))).alias("stripped"))


UNITS = """t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS u FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS u FROM benchmark)"""
OVERLAP = """, d AS (SELECT doc_id, len(u) AS dn, unnest(u) AS w FROM t), q AS (SELECT item_id, len(u) AS qn, unnest(u) AS w FROM b),
m AS (SELECT item_id, doc_id, qn, dn, count(*) AS n FROM q JOIN d USING (w) GROUP BY 1, 2, 3, 4),
s AS (SELECT item_id, doc_id, round(n / (qn + dn - n)::DOUBLE, 6) AS jaccard, round(n / qn::DOUBLE, 6) AS overlap FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5"""


@query("WITH " + UNITS + OVERLAP)
def token_jaccard(spark, sf_dir):
    return ranking.token_overlap(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", False, 5)


BIGRAMS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM benchmark),
t AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS u FROM w), b AS (SELECT item_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS u FROM v)"""


@query("WITH " + BIGRAMS + OVERLAP)
def bigram_jaccard(spark, sf_dir):
    return ranking.token_overlap(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", True, 5)


TERMS = """dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents)"""


TFIDF_SQL = "WITH " + TERMS + """, i AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM dt, n GROUP BY term, n HAVING count(*) <= 0.95 * n),
d AS (SELECT doc_id, term, tf * idf AS w FROM dt JOIN i USING (term)), q AS (SELECT item_id, term, qf * idf AS w FROM qt JOIN i USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM d GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM q GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(q.w * d.w) AS dot FROM q JOIN d USING (term) GROUP BY 1, 2),
c AS (SELECT item_id, doc_id, round(dot / (dn.norm * qn.norm), 6) AS score FROM s JOIN dn USING (doc_id) JOIN qn USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5"""


@query(TFIDF_SQL)
def tfidf_topk(spark, sf_dir):
    return ranking.tfidf_topk(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", 5)


@query("WITH " + TERMS + " SELECT term, count(*) AS df, round(ln((1.0 + n) / (1.0 + count(*))) + 1, 6) AS idf FROM dt, n GROUP BY term, n HAVING count(*) <= 0.95 * n")
def tfidf_vocab(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    n = docs.count()
    df = ranking.document_frequency(docs, 0.95, n)
    return df.withColumn("idf", F.round(F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1, 6))


BM25_SQL = "WITH " + TERMS + """, sz AS (SELECT doc_id, sum(tf) AS size FROM dt GROUP BY 1), av AS (SELECT sum(size) / max(n)::DOUBLE AS mean FROM sz, n),
ir AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM dt, n GROUP BY term, n), fl AS (SELECT 0.25 * avg(raw) AS low FROM ir),
i AS (SELECT term, CASE WHEN raw < 0 THEN low ELSE raw END AS idf FROM ir, fl),
c AS (SELECT item_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 6) AS score FROM qt JOIN i USING (term) JOIN dt USING (term) JOIN sz USING (doc_id), av GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5"""


@query(BM25_SQL)
def bm25_topk(spark, sf_dir):
    return ranking.bm25_topk(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", 5)


@query(f"""WITH h AS ({BM25_SQL}), l AS ({TFIDF_SQL}), u AS (SELECT item_id, doc_id, 0 AS part, rank FROM h UNION ALL SELECT item_id, doc_id, 1, rank FROM l),
m AS (SELECT item_id, doc_id, min(part * 1000 + rank) AS pos FROM u GROUP BY 1, 2) SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY pos, doc_id) AS rank FROM m""")
def rank_fusion_union(spark, sf_dir):
    return ranking.merged(bm25_topk(spark, sf_dir), tfidf_topk(spark, sf_dir), "item_id", "doc_id")


# ---- features and ranking ----------------------------------------------------------------------------------------

CANDIDATES = "WITH " + PAIRS.format("true") + ", c AS (SELECT query_id, vec_id, rank, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE round(-d, 6) END AS score FROM r WHERE rank <= 20)"


def candidates(spark, sf_dir) -> DataFrame:
    return rounded(top(spark, sf_dir, k=20)).withColumn("score", F.when(F.col("vec_id") % 3 != 0, -F.col("distance")))


for _policy, _fill in (("min", "-1e9"), ("zero", "0.0"), ("baseline", "(21 - rank)::DOUBLE")):
    query(
        CANDIDATES + f" SELECT query_id, vec_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN coalesce(score, {_fill}) END DESC NULLS LAST, rank) AS final_rank FROM c",
        f"rerank_missing_policy_{_policy}",
    )(lambda spark, sf_dir, policy=_policy: ranking.reranked(candidates(spark, sf_dir), "query_id", F.col("score"), 10, policy, 20).select("query_id", "vec_id", "rank", "final_rank"))

POINTS = CANDIDATES + """, pts AS (SELECT a.query_id, a.vec_id, sum(CASE WHEN a.vec_id % 7 = b.vec_id % 7 THEN 0.5 WHEN a.vec_id % 7 < b.vec_id % 7 THEN 1.0 ELSE 0.0 END)::DOUBLE AS points, count(*) + 1 AS n
FROM c a JOIN c b ON a.query_id = b.query_id AND a.vec_id <> b.vec_id GROUP BY 1, 2)"""


def points(spark, sf_dir) -> DataFrame:
    return ranking.all_pair_points(candidates(spark, sf_dir), "query_id", "vec_id", F.expr("l.vec_id % 7 < r.vec_id % 7"), F.expr("l.vec_id % 7 = r.vec_id % 7"))


@query(POINTS + " SELECT * FROM pts")
def allpair_points(spark, sf_dir):
    return points(spark, sf_dir)


@query(POINTS + """, w AS (SELECT *, CASE WHEN n <= 1 THEN 0.5 ELSE points / (n - 1) END AS raw FROM pts),
mm AS (SELECT *, min(raw) OVER g AS lo, max(raw) OVER g AS hi, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, vec_id) AS llm_rank FROM w WINDOW g AS (PARTITION BY query_id))
SELECT query_id, vec_id, points, round(raw, 6) AS raw, round(CASE WHEN hi = lo THEN 0.5 ELSE (raw - lo) / (hi - lo) END, 6) AS scaled, llm_rank, round(1.0 / llm_rank, 6)::DOUBLE AS reciprocal FROM mm""")
def allpair_winrate(spark, sf_dir):
    return ranking.win_rates(points(spark, sf_dir), "query_id", "vec_id")


@query(CANDIDATES + """, o AS (SELECT a.query_id, a.vec_id, a.rank, count(b.vec_id) AS ahead FROM c a LEFT JOIN c b ON a.query_id = b.query_id AND b.vec_id % 7 < a.vec_id % 7 GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ahead, rank) AS place FROM o) SELECT query_id, vec_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 5 THEN place ELSE 5 + rank END) AS final_rank FROM t""")
def comparison_topk(spark, sf_dir):
    return ranking.comparison_topk(candidates(spark, sf_dir), "query_id", "vec_id", F.expr("l.vec_id % 7 < r.vec_id % 7"), 5).select("query_id", "vec_id", "rank", "final_rank")


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_orderkey) AS qid FROM lineitem")
def qid_assign(spark, sf_dir):
    return evaluation.qids(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / coalesce(nullif(stddev_pop(l_quantity) OVER w, 0), 1), 6) + 0.0 AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def zscore_by_query(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(ranking.zscores(None, "l_orderkey", "l_quantity"), 6) + F.lit(0.0)).alias("z"))


@query("""WITH b AS (SELECT s_nationkey, max(s_acctbal) AS top, avg(s_acctbal) AS mean FROM supplier GROUP BY 1), o AS (SELECT max(s_acctbal) AS top FROM supplier)
SELECT c_custkey, n_name, round(c_acctbal - b.mean, 4) AS delta, b.mean IS NOT NULL AS found, round(coalesce(b.top, o.top), 4) AS source_best FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN b ON c_nationkey = s_nationkey, o""")
def model_deltas(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    bundle = s.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"), F.avg("s_acctbal").alias("mean"))
    best = s.agg(F.max("s_acctbal")).first()[0]
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(bundle, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return c.select("c_custkey", "n_name", F.round(F.col("c_acctbal") - F.col("mean"), 4).alias("delta"), F.col("mean").isNotNull().alias("found"), F.round(F.coalesce("top", F.lit(best)), 4).alias("source_best"))


# ---- disagreements and evaluation --------------------------------------------------------------------------------

RUNS = """WITH u AS (SELECT l_partkey % 500 AS comp, l_returnflag AS cluster, l_orderkey * 10 + l_linenumber AS run_id, l_linenumber = 1 AS baseline, l_linestatus = 'O' AS success FROM lineitem),
c AS (SELECT comp, cluster, count(*) FILTER (success) AS won, count(*) FILTER (NOT success) AS lost FROM u WHERE NOT baseline GROUP BY 1, 2),
b AS (SELECT comp, count(*) FILTER (success) AS bw, count(*) FILTER (NOT success) AS bl FROM u WHERE baseline GROUP BY 1),
s AS (SELECT u.comp, u.cluster, run_id, CASE WHEN success THEN lost + coalesce(bl, 0) ELSE -(won + coalesce(bw, 0)) END AS score FROM u JOIN c USING (comp, cluster) LEFT JOIN b USING (comp) WHERE NOT baseline)"""


def runs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("comp"), F.col("l_returnflag").alias("cluster"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), (F.col("l_linenumber") == 1).alias("baseline"), (F.col("l_linestatus") == "O").alias("success"))


@query(RUNS + " SELECT comp, cluster, run_id, score FROM s WHERE score <> 0")
def disagree_scores(spark, sf_dir):
    return evaluation.disagreements(runs(spark, sf_dir))


@query(RUNS + ", g AS (SELECT comp, cluster, count(*) AS n FROM s WHERE score <> 0 GROUP BY 1, 2) SELECT count(*) AS groups, count(*) FILTER (n = 1) AS single, round(avg(n), 6) AS mean_size, min(n) AS min_size, max(n) AS max_size, round(coalesce(stddev_samp(n), 0), 6) AS std_size FROM g")
def disagree_stats(spark, sf_dir):
    return evaluation.group_stats(evaluation.disagreements(runs(spark, sf_dir)))


EPISODES = """WITH s AS (SELECT event_type AS task, user_id || '-' || ts::DATE AS episode, ts AS moment, event_type || (event_id % 3) AS action, round(value / 100, 6) AS score FROM events),
e AS (SELECT task, episode, count(*) AS total_steps, count(DISTINCT action) AS unique_actions, arg_min(score, moment) AS initial_score, arg_max(score, moment) AS final_score FROM s GROUP BY 1, 2),
f AS (SELECT *, round(final_score - initial_score, 6) AS improvement, total_steps >= 3 AS reached_max, CASE WHEN final_score >= 1 THEN 'success' WHEN final_score <= 0 THEN 'failure' ELSE 'in_progress' END AS class FROM e)"""


def steps(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("task"), F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("episode"), F.col("ts").alias("at"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("action"), F.round(F.col("value") / 100, 6).alias("score"))


@query(EPISODES + " SELECT * FROM f")
def episode_analysis(spark, sf_dir):
    return evaluation.episodes(steps(spark, sf_dir), 3)


@query(EPISODES + """ SELECT task, count(*) AS episodes, round(avg((class = 'success')::INT), 6) AS success_rate, round(avg((class = 'failure')::INT), 6) AS failure_rate, round(avg(total_steps), 6) AS mean_steps, round(stddev_pop(total_steps), 6) AS std_steps,
min(total_steps) AS min_steps, max(total_steps) AS max_steps, round(avg(final_score), 6) AS mean_score, round(avg(CASE WHEN class <> 'failure' THEN total_steps END), 6) AS mean_steps_not_failed, count(*) FILTER (reached_max) AS at_limit FROM f GROUP BY ROLLUP (task)""")
def eval_rollup(spark, sf_dir):
    return evaluation.evaluation(evaluation.episodes(steps(spark, sf_dir), 3))


@query("SELECT c_mktsegment, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS completed, round(avg((o_orderstatus = 'F')::INT), 4) AS rate, round(avg(o_totalprice), 2) AS mean_score, count(DISTINCT o_orderpriority) AS variations FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def run_summary(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("runs"), F.count_if(done).alias("completed"), F.round(F.avg(done.cast("double")), 4).alias("rate"), F.round(F.avg("o_totalprice"), 2).alias("mean_score"), F.count_distinct("o_orderpriority").alias("variations"))


# ---- splits and sets ---------------------------------------------------------------------------------------------

QUOTA = """WITH c AS (SELECT p_type, count(*) AS cap FROM part GROUP BY 1), r AS (SELECT *, 100 * cap / (sum(cap) OVER ())::DOUBLE AS raw FROM c),
f AS (SELECT *, floor(raw) AS low, round(raw - floor(raw), 9) AS fraction FROM r), q AS (SELECT *, 100 - sum(low) OVER () AS spare, row_number() OVER (ORDER BY fraction DESC, cap DESC, p_type DESC) AS turn FROM f),
h AS (SELECT p_type, cap, (low + CASE WHEN turn <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM q)"""


def quotas(spark, sf_dir) -> DataFrame:
    return splits.hamilton(read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("cap")), "p_type", 100)


@query(QUOTA + " SELECT * FROM h")
def hamilton_quotas(spark, sf_dir):
    return quotas(spark, sf_dir)


@query(QUOTA + ", k AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5('s1' || p_partkey), p_partkey) AS pick FROM part) SELECT p_partkey, p_type FROM k JOIN h USING (p_type) WHERE pick <= quota")
def stratified_sample(spark, sf_dir):
    return splits.stratified(read(spark, sf_dir, "part"), "p_type", "p_partkey", quotas(spark, sf_dir), "s1").select("p_partkey", "p_type")


@query("""WITH a AS (SELECT p_brand, count(*) AS in_all FROM part GROUP BY 1), l AS (SELECT p_type, p_brand, count(*) AS in_combo FROM part GROUP BY 1, 2),
r AS (SELECT p_type, p_brand, p_partkey, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS round FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round, in_all, in_combo, p_brand) AS pick FROM r JOIN a USING (p_brand) JOIN l USING (p_type, p_brand)) SELECT p_type, p_brand, p_partkey, pick FROM k WHERE pick <= 4""")
def rare_first_sample(spark, sf_dir):
    return splits.rare_first(read(spark, sf_dir, "part"), "p_type", "p_brand", "p_partkey", 4).select("p_type", "p_brand", "p_partkey", "pick")


@query("""WITH a AS (SELECT p_brand, count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_brand, count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM part WHERE p_size > 25 GROUP BY 1)
SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS tvd FROM a FULL JOIN b ON a.p_brand = b.p_brand""")
def tvd_shift(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return splits.total_variation(part.filter("p_size <= 25"), part.filter("p_size > 25"), "p_brand")


@query("SELECT p_type, p_brand, count(*) AS n, grouping(p_brand) AS of_type FROM part GROUP BY ROLLUP (p_type, p_brand)")
def distribution_summary(spark, sf_dir):
    return read(spark, sf_dir, "part").rollup("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.grouping("p_brand").cast("long").alias("of_type"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'easy' WHEN p_size <= 17 THEN 'medium' ELSE 'hard' END AS band FROM part")
def difficulty_bands(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") <= 10, "easy").when(F.col("p_size") <= 17, "medium").otherwise("hard").alias("band"))


STEP_BINS = """WITH n AS (SELECT p_size AS v, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM part WHERE p_size IS NOT NULL),
e AS (SELECT DISTINCT v FROM n WHERE i IN (SELECT round_even((n - 1) * q, 0) FROM n, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)) AS t(q)))
SELECT p_partkey, CASE WHEN low IS NULL THEN '<= ' || high WHEN high IS NULL THEN '>= ' || (low + 1) ELSE (low + 1) || '-' || high END AS bin
FROM (SELECT p_partkey, (SELECT max(v) FROM e WHERE v < p_size) AS low, (SELECT min(v) FROM e WHERE v >= p_size) AS high FROM part) b"""


@query(STEP_BINS)
def step_bins(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", splits.bin_label(F.col("p_size"), splits.step_bins(part, "p_size")).alias("bin"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def leakage_overlap(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT source, lang FROM documents EXCEPT SELECT source, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1")
def missing_combos(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("source", "lang").subtract(docs.join(read(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("source", "lang"))


@query("WITH e AS (SELECT user_id, event_type, hour(ts) AS hour, ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS held FROM events) SELECT user_id, event_type, hour FROM e WHERE NOT held EXCEPT SELECT user_id, event_type, hour FROM e WHERE held")
def push_dedup(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("hour", F.hour("ts").cast("long"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    held = F.col("ts") < F.lit(low + (high - low) / 2) if low is not None else F.lit(True)
    keys = ["user_id", "event_type", "hour"]
    return push.new_rows(e.filter(~held).select(*keys), e.filter(held).select(*keys), keys)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    return push.windowed_counts(read(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    return windows.sliding(read(spark, sf_dir, "events"), "1 hour", "30 minutes").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 hours THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 hours AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"), "6 hours").withColumn("total", F.round("total", 4))


@query("""WITH f AS (SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY 1)
SELECT v.conv_id::VARCHAR AS trajectory, min(v.turn) AS step FROM conversations v JOIN f ON f.conv_id = v.conv_id + 1 WHERE v.role = 'assistant' GROUP BY 1""")
def state_triggers(spark, sf_dir):
    """Each conversation's first assistant turn: its target is told by the url, here the role."""
    v = read(spark, sf_dir, "conversations")
    targets = chunks.first_of(v.select("conv_id", "turn", "text"), ["conv_id"], ["turn", "text"])
    targets = targets.select((F.col("conv_id") - 1).cast("string").alias("trajectory"), F.lit("no such page").alias("target_observation"), F.lit("assistant").alias("target_url"))
    steps = v.select(F.col("conv_id").cast("string").alias("trajectory"), F.col("turn").alias("step"), F.col("text").alias("observation"), F.col("role").alias("url"))
    return triggers.first_triggers(steps, targets)


@query("SELECT t.conv_id, t.turn, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY role, md5(text)) AS n FROM conversations) t")
def chunk_align(spark, sf_dir):
    v = read(spark, sf_dir, "conversations").withColumn("signature", F.md5("text"))
    counts = v.groupBy("role", "signature").agg(F.count(F.lit(1)).alias("n"))
    return v.join(counts, ["role", "signature"], "left").select("conv_id", "turn", F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"))


# ---- indexes, learned rankers, clusters and messages -------------------------------------------------------------


@query(None)
def ivf_topk(spark, sf_dir):
    m = memory(spark, sf_dir)
    centroids = ivf.fit(m)
    return rounded(ivf.search(ivf.index(m, centroids), m.filter("vec_id % 100 = 0"), centroids))


@query(None)
def pq_topk(spark, sf_dir):
    m = memory(spark, sf_dir)
    path = f"{shared_dir(spark)}/pq-{uuid.uuid4().hex}"
    pq.build(m, pq.fit(m), path)
    return rounded(pq.search(pq.opened(spark, path), m.filter("vec_id % 100 = 0")))


RANK_FEATURES = ["distance", "rank", "same_variation", "gap"]


def labelled(spark, sf_dir) -> DataFrame:
    """Candidates with features, and whether they are of the query's task as label."""
    m = memory(spark, sf_dir).select("vec_id", "task", "variation")
    found = top(spark, sf_dir, k=20).join(m, "vec_id").join(m.select(F.col("vec_id").alias("query_id"), F.col("task").alias("q_task"), F.col("variation").alias("q_variation")), "query_id")
    nearest = F.min("distance").over(Window.partitionBy("query_id"))
    return found.select("query_id", "vec_id", "rank", "distance", (F.col("variation") == F.col("q_variation")).cast("double").alias("same_variation"), (F.col("distance") - nearest).alias("gap"), F.coalesce(F.col("task") == F.col("q_task"), F.lit(False)).cast("int").alias("label"))


for _family in models.FAMILIES:

    @query(None, f"learned_rank_{_family}")
    def learned_rank(spark, sf_dir, family=_family):
        """Fitted on every second query; ranks all, those of the fit too."""
        rows = labelled(spark, sf_dir)
        ranker = models.fit(family, rows.filter("query_id % 200 = 0"), "query_id", "label", RANK_FEATURES)
        return models.rank(ranker, rows, "query_id", "rank").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"), "final_rank")


@query(None)
def learned_rank_heldout(spark, sf_dir):
    """Mean NDCG at 10 of each family on the queries that were not fitted on, and of the retrieved order."""
    rows = labelled(spark, sf_dir).persist()
    fitted, held = rows.filter("query_id % 200 = 0"), rows.filter("query_id % 200 <> 0")
    found = boosting.ndcg(held, "query_id", "label", "rank").select(F.lit("retrieved").alias("family"), "ndcg")
    for family in models.FAMILIES:
        ranked = models.rank(models.fit(family, fitted, "query_id", "label", RANK_FEATURES), held, "query_id", "rank")
        found = found.unionByName(boosting.ndcg(ranked, "query_id", "label", "final_rank").select(F.lit(family).alias("family"), "ndcg"))
    return found.groupBy("family").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(None)
def turn_similarity(spark, sf_dir):
    """Each turn of a conversation against the one before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", before.alias("before")).select("conv_id", "turn", "role", F.round(similarity.sequence_ratio("before", "text"), 6).alias("ratio"))


@query(None)
def state_matches(spark, sf_dir):
    """Each turn as a state, against the first turn of its conversation as the target."""
    v = read(spark, sf_dir, "conversations")
    target = chunks.first_of(v.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", F.col("text").alias("target"), F.col("role").alias("target_url"))
    both = v.join(target, "conv_id")
    matched = similarity.state_match(F.col("text"), F.col("target"), F.lit(""), F.lit(""))
    return both.select("conv_id", "turn", "role", F.round(similarity.state_similarity(F.col("text"), F.col("target")), 6).alias("similarity"), matched.alias("matched"))


@query(None)
def text_leaders(spark, sf_dir):
    """The texts of all turns under their leaders at a similarity of 0.99, element ids left out."""
    v = read(spark, sf_dir, "conversations")
    return text_clusters.text_leaders(v.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.without_ids(F.col("text")).alias("text")))


@query(None)
def leader_clusters(spark, sf_dir):
    """Vectors under the queries that lead them: links are the top ten of each query."""
    links = top(spark, sf_dir).filter("query_id <> vec_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"))
    return clusters.leaders(memory(spark, sf_dir).select(F.col("vec_id").alias("id")), links)


LOG = """WITH g AS (SELECT event_type AS task, user_id::VARCHAR AS episode, CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'planner' ELSE 'warning' END AS kind, event_id % 3 > 0 AS structured, event_id % 2 = 0 AS fallback,
CASE user_id % 3 WHEN 0 THEN 'JSON parsing failed' WHEN 1 THEN 'Non-admissible action' ELSE 'LLM call failed' END AS message, CASE user_id % 4 WHEN 0 THEN 'in trajectory context' WHEN 1 THEN 'Incomplete/partial' WHEN 2 THEN 'similar words' END AS cause FROM events),
m AS (SELECT task, episode, kind = 'warning' AS warning, kind, structured, message, CASE WHEN kind = 'warning' THEN CASE WHEN NOT structured OR cause IS NULL THEN 'not_sure' ELSE cause END END AS cause FROM g WHERE kind <> 'warning' OR NOT structured OR fallback)"""


@query(LOG + """ SELECT task, episode, count(*) FILTER (warning) AS warnings, count(*) FILTER (NOT warning) AS errors, count(*) FILTER (warning AND structured AND message = 'Non-admissible action') AS type_non_admissible_action,
count(*) FILTER (kind = 'planner') AS type_planner_failed, count(*) FILTER (kind = 'error' AND message = 'JSON parsing failed') AS type_json_parsing_failed, count(*) FILTER (kind = 'error' AND message = 'LLM call failed') AS type_llm_call_failed,
count(*) FILTER (cause = 'in trajectory context') AS cause_retrieval_trajectory_mismatch, count(*) FILTER (cause = 'Incomplete/partial') AS cause_partial_incomplete_action, count(*) FILTER (cause = 'similar words') AS cause_similar_word_confusion,
count(*) FILTER (cause = 'not_sure') AS cause_not_sure FROM m GROUP BY ROLLUP (task, episode)""")
def warning_rollup(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    log = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("task"),
        u.cast("string").alias("episode"),
        F.when(i % 5 == 0, "error").when(i % 5 == 1, "planner").otherwise("warning").alias("kind"),
        (i % 3 > 0).alias("structured"),
        (i % 2 == 0).alias("fallback"),
        F.when(u % 3 == 0, "JSON parsing failed").when(u % 3 == 1, "Non-admissible action").otherwise("LLM call failed").alias("message"),
        F.when(u % 4 == 0, "in trajectory context").when(u % 4 == 1, "Incomplete/partial").when(u % 4 == 2, "similar words").alias("cause"),
    )
    return evaluation.message_rollup(evaluation.messages(log))
