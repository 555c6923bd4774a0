"""Registered feature queries, with DuckDB SQL for the same rows.

Stand-ins: a memory row is a vector with the document of its id; its key is made of the document's language, source and
text, its goal, state and context vectors are the thirds of its embedding. Every row whose id is divisible by 100 is a
query against all rows, as in the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.catalog import query, read
from stepforge.functions import text as tx
from stepforge.operators import features, retrieval

KINDS = ["de", "en", "es", "fr"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("state"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    both = read(spark, sf_dir, "embeddings").join(docs, "vec_id")
    both = both.withColumn("goal", F.concat_ws(" ", "lang", "source")).withColumn("context", F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.col("source"), F.lit(" step "), (i % 7).cast("string"))))
    key = tx.full_key(F.col("goal"), F.col("state"), F.col("context"), F.concat(F.lit("step_till_now: "), (i % 20).cast("string")))
    # Up to five steps, each a piece of the text.
    guidance = F.expr("transform(filter(sequence(1, 5), j -> j <= vec_id % 6), j -> struct(concat('go ', j) AS action, substring(state, 10 * j, 30) AS observation))")
    third = lambda at, n: F.slice("embedding", at, n)
    return both.select(
        "vec_id", key.alias("full"), "goal", "state", "context", F.col("label").cast("long").alias("task"), (i % 4).alias("variation"), "embedding", third(1, 21).alias("goal_vector"), third(22, 21).alias("state_vector"), third(43, 22).alias("context_vector"),
        tx.step_number(key).cast("long").alias("step"), guidance.alias("guidance"), F.when(i % 7 > 0, i % 20).alias("total_steps"), (i % 3 == 0).alias("success"), "lang",
    )


def pairs(memory: DataFrame) -> DataFrame:
    return retrieval.vector_topk(memory.select("vec_id", "task", "variation", "embedding"), memory.filter("vec_id % 100 = 0"), 10)


GUIDANCE = r"""('[' || array_to_string(['{"action": "go ' || j || '", "observation": "' || regexp_replace(substr(coalesce(text, ''), 10 * j, 30), '[\t\n\r\f\x0B]', 'n', 'g') || '"}' for j in range(1, vec_id % 6 + 1)], ', ') || ']')"""
ROWS = """m AS (SELECT vec_id, coalesce(lang, '') || ' ' || coalesce(source, '') AS goal, coalesce(text, '') AS state, CASE WHEN vec_id % 5 = 0 THEN '' ELSE coalesce(source, '') || ' step ' || (vec_id % 7) END AS context,
label AS task, vec_id % 4 AS variation, embedding::DOUBLE[] AS e, embedding[1:21]::DOUBLE[] AS ge, embedding[22:42]::DOUBLE[] AS se, embedding[43:64]::DOUBLE[] AS ce, vec_id % 20 AS step, vec_id % 6 AS steps, {GUIDANCE} AS guidance, CASE WHEN vec_id % 7 > 0 THEN vec_id % 20 END AS total_steps, vec_id % 3 = 0 AS success, lang
FROM embeddings JOIN documents ON doc_id = vec_id),
f AS (SELECT *, 'goal: ' || goal || ' | state: ' || state || ' | context: ' || context || ' | progress: step_till_now: ' || step AS "full" FROM m)""".replace("{GUIDANCE}", GUIDANCE)
SPLIT = r"list_filter(regexp_split_to_array(lower({0}), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"
L2 = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE END"


def pack_sql() -> str:
    """The feature pack of the top ten of each query."""
    token = ", ".join(f"{SPLIT.format(chr(34) + c + chr(34))} AS t_{c}" for c in features.COMPONENTS)
    sets = ", ".join(f"list_distinct(t_{c}) AS u_{c}, list_distinct([t_{c}[i] || ' ' || t_{c}[i + 1] for i in range(1, len(t_{c}))]) AS b_{c}" for c in features.COMPONENTS)
    both = "length(trim(q.context)) > 0 AND length(trim(d.context)) > 0"
    need = lambda c, x: f"CASE WHEN {both} THEN {x} END" if c == "context" else x
    columns = [f"{L2.format('q.e', 'd.e')} AS embedding_similarity"]
    columns += [f"{need(c, L2.format(f'q.{c[0]}e', f'd.{c[0]}e'))} AS {c}_only_similarity" for c in ("goal", "state", "context")]
    columns += [f"{need(c, JACCARD.format(f'q.u_{c}', f'd.u_{c}'))} AS jaccard_{c}" for c in features.COMPONENTS]
    columns += [f"{need(c, f'CASE WHEN len(q.u_{c}) = 0 THEN 0.0 ELSE len(list_intersect(q.u_{c}, d.u_{c})) / len(q.u_{c})::DOUBLE END')} AS query_overlap_{c}" for c in features.COMPONENTS]
    columns += [f"{need(c, f'coalesce(x.{c}, 0.0)')} AS tfidf_cosine_{c}" for c in features.COMPONENTS]
    columns += [f"{need(c, JACCARD.format(f'q.b_{c}', f'd.b_{c}'))} AS bigram_jaccard_{c}" for c in features.COMPONENTS]
    columns += ["(q.task = d.task)::INT::DOUBLE AS task_match", "(q.task = d.task AND q.variation = d.variation)::INT::DOUBLE AS task_variation_match", "d.steps::DOUBLE AS trajectory_length", "(CASE WHEN d.steps > 0 THEN len(list_filter(string_split(d.guidance, ' '), lambda x: x <> '')) ELSE len(d.t_full) END)::DOUBLE AS retrieved_text_length", "d.success::INT::DOUBLE AS success_flag", "d.total_steps::DOUBLE AS total_steps"]
    columns += ["len(q.t_full)::DOUBLE AS query_length", "q.step::DOUBLE AS step_index", "abs(q.step - d.step)::DOUBLE AS progress_alignment_abs_diff", "p.distance AS retriever_score", "p.rank::DOUBLE AS retrieved_rank"]
    texts = " UNION ALL ".join(f"SELECT vec_id, '{c}' AS part, \"{c}\" AS text FROM f" for c in features.COMPONENTS)
    pivot = ", ".join(f"max(CASE WHEN part = '{c}' THEN cosine END) AS {c}" for c in features.COMPONENTS)
    return f"""WITH {ROWS},
p0 AS (SELECT q.vec_id AS query_id, d.vec_id, {L2.format('q.e', 'd.e')} AS distance FROM f q, f d WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p0) WHERE rank <= 10),
g AS (SELECT *, {token} FROM f), s AS (SELECT *, {sets} FROM g),
tt AS (SELECT * FROM ({texts}) WHERE length(trim(text)) > 0), tn AS (SELECT part, count(*) AS n FROM tt GROUP BY 1),
tw AS (SELECT vec_id, part, term, count(*) AS tf FROM (SELECT vec_id, part, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM tt) GROUP BY 1, 2, 3),
ti AS (SELECT part, term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM tw JOIN tn USING (part) GROUP BY part, term, n HAVING count(*) <= 0.95 * n),
tv AS (SELECT vec_id, part, term, tf * idf AS w FROM tw JOIN ti USING (part, term)), tm AS (SELECT vec_id, part, sqrt(sum(w * w)) AS norm FROM tv GROUP BY 1, 2),
td AS (SELECT p.query_id, p.vec_id, a.part, sum(a.w * b.w) AS dot FROM p JOIN tv a ON a.vec_id = p.query_id JOIN tv b ON b.vec_id = p.vec_id AND a.part = b.part AND a.term = b.term GROUP BY 1, 2, 3),
tc AS (SELECT query_id, td.vec_id, td.part, greatest(0.0, least(1.0, dot / (a.norm * b.norm))) AS cosine FROM td JOIN tm a ON a.vec_id = query_id AND a.part = td.part JOIN tm b ON b.vec_id = td.vec_id AND b.part = td.part),
x AS (SELECT query_id, vec_id, {pivot} FROM tc GROUP BY 1, 2),
v AS (SELECT p.query_id, p.vec_id, d.lang, {', '.join(columns)} FROM p JOIN s q ON q.vec_id = p.query_id JOIN s d ON d.vec_id = p.vec_id LEFT JOIN x ON x.query_id = p.query_id AND x.vec_id = p.vec_id)"""


PACK = pack_sql()


@query(PACK + " SELECT query_id, vec_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in features.SCALARS) + " FROM v")
def feature_vector(spark, sf_dir):
    memory = rows(spark, sf_dir)
    out = features.feature_pack(pairs(memory), memory)
    return out.select("query_id", "vec_id", *[F.round(c, 6).alias(c) for c in features.SCALARS])


_NAMES = [*features.SCALARS, *[f"agent_type__{k}" for k in sorted(KINDS)]]


@query(
    PACK + f" SELECT query_id, vec_id, ({' + '.join(f'({c} IS NULL)::INT' for c in features.SCALARS)})::BIGINT AS missing, {len(_NAMES)}::BIGINT AS size, "
    + ", ".join(f"coalesce(lang = '{k}', false)::INT::DOUBLE AS agent_type__{k}" for k in sorted(KINDS))
    + f", round({' + '.join(f'coalesce(round({c}, 6), 0.0)' for c in features.SCALARS)} + (lang IN ('de', 'en', 'es', 'fr'))::INT, 4) AS total FROM v"
)
def feature_projection(spark, sf_dir):
    """The features as one vector in a fixed order of columns, missing ones as 0 and counted."""
    memory = rows(spark, sf_dir)
    pack = features.feature_pack(pairs(memory), memory).join(memory.select("vec_id", "lang"), "vec_id")
    hots = features.one_hots(F.col("lang"), KINDS)
    pack = pack.select("query_id", "vec_id", *[F.round(c, 6).alias(c) for c in features.SCALARS], *hots)
    values, missing = features.vector(_NAMES)
    pack = pack.select("*", values.alias("vector"), missing.cast("long").alias("missing"))
    return pack.select("query_id", "vec_id", "missing", F.size("vector").cast("long").alias("size"), *[f"agent_type__{k}" for k in sorted(KINDS)], F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""WITH d AS (SELECT 'model ' || n_nationkey AS model, max(s_acctbal) AS best, avg(s_acctbal) AS typical FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), b AS (SELECT max(best) AS best, max(typical) AS typical FROM d),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'model ' || (c_custkey % 30) ELSE 'model_' || (c_custkey % 30) END AS consumer, 'model ' || (c_custkey % 28) AS source FROM customer)
SELECT c_custkey, round(c.best, 4) AS consumer_best, round(coalesce(s.best, b.best), 4) AS source_best, round(c.best - coalesce(s.best, b.best), 4) AS consumer_minus_source_best,
round(c.typical, 4) AS consumer_typical, round(coalesce(s.typical, b.typical), 4) AS source_typical, round(c.typical - coalesce(s.typical, b.typical), 4) AS consumer_minus_source_typical,
c.model IS NOT NULL AS consumer_found, s.model IS NOT NULL AS source_found, replace(consumer, ' ', '_') = replace(source, ' ', '_') AS same_model FROM p LEFT JOIN d c ON replace(c.model, ' ', '_') = replace(consumer, ' ', '_') LEFT JOIN d s ON s.model = source, b""")
def capability_deltas(spark, sf_dir):
    number = F.concat(F.lit("model "), F.col("n_nationkey").cast("string"))
    joined = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    dimension = joined.groupBy(number.alias("model")).agg(F.max("s_acctbal").alias("best"), F.avg("s_acctbal").alias("typical"))
    i = F.col("c_custkey")
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(i % 2 == 0, "model ").otherwise("model_"), (i % 30).cast("string")).alias("consumer"), F.concat(F.lit("model "), (i % 28).cast("string")).alias("source"))
    out = features.capability_deltas(asked, dimension, "consumer", "source", ["best", "typical"]).drop("consumer", "source")
    return out.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(PACK + ", n AS (SELECT *, dense_rank() OVER (ORDER BY query_id) AS qid FROM v JOIN (SELECT vec_id AS query_id, label AS q_task FROM embeddings) USING (query_id) JOIN (SELECT vec_id, label AS d_task FROM embeddings) USING (vec_id)) SELECT qid, (q_task = d_task)::BIGINT AS label, vec_id::VARCHAR AS docid, " + ", ".join(f"round({f}, 6) AS {n}" for n, f in features.EXPORTED.items()) + " FROM n")
def feature_export(spark, sf_dir):
    """The labelled training table: whether a row is of its query's task."""
    memory = rows(spark, sf_dir)
    found = pairs(memory)
    task = memory.select("vec_id", "task")
    labels = found.join(task, "vec_id").join(task.select(F.col("vec_id").alias("query_id"), F.col("task").alias("q_task")), "query_id")
    labels = labels.select("query_id", "vec_id", (F.col("task") == F.col("q_task")).cast("long").alias("label"))
    out = features.training_rows(features.feature_pack(found, memory), labels)
    return out.select("qid", "label", "docid", *[F.round(n, 6).alias(n) for n in features.EXPORTED])


CHOSEN = """WITH c AS (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN embedding[1:4]::DOUBLE[] END AS own, CASE WHEN vec_id % 3 > 0 THEN vec_id % 2 END AS gaps, CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN 'no encoder' ELSE '' END AS error,
CASE WHEN vec_id % 5 > 0 THEN embedding[5:8]::DOUBLE[] END AS logged FROM embeddings)"""
_BY = {
    "runtime": ("CASE WHEN own IS NOT NULL THEN own END", "CASE WHEN own IS NOT NULL THEN 'runtime' ELSE 'error' END", "coalesce(gaps, 4)", "CASE WHEN own IS NULL AND error = '' THEN 'runtime_feature_missing' ELSE error END"),
    "json": ("logged", "CASE WHEN logged IS NOT NULL THEN 'json' ELSE 'error' END", "CASE WHEN logged IS NULL THEN 4 ELSE 0 END", "CASE WHEN logged IS NULL THEN 'json_feature_missing' ELSE '' END"),
    "hybrid": ("coalesce(own, logged)", "CASE WHEN own IS NOT NULL THEN 'runtime' WHEN logged IS NOT NULL THEN 'json_fallback' ELSE 'error' END", "CASE WHEN own IS NOT NULL THEN gaps WHEN logged IS NOT NULL THEN 0 ELSE 4 END", "CASE WHEN own IS NULL AND logged IS NULL AND error = '' THEN 'runtime_and_json_missing' ELSE error END"),
}
for _policy, (_vector, _source, _missing, _reason) in _BY.items():

    @query(CHOSEN + f" SELECT vec_id, round(list_sum({_vector}), 6) AS total, {_source} AS source, ({_missing})::BIGINT AS missing, {_reason} AS reason, {_vector} IS NOT NULL AS available FROM c", f"feature_policy_{_policy}")
    def feature_policy(spark, sf_dir, policy=_policy):
        """Rows whose vectors of today, and of the log, are missing now and then."""
        i, four = F.col("vec_id"), lambda at: F.slice("embedding", at, 4).cast("array<double>")
        memory = read(spark, sf_dir, "embeddings")
        now = memory.select("vec_id", F.when(i % 3 > 0, four(1)).alias("vector"), F.when(i % 3 > 0, i % 2).alias("missing"), F.when((i % 3 == 0) & (i % 2 == 0), "no encoder").alias("error"))
        before = memory.filter(i % 5 > 0).select("vec_id", four(5).alias("vector"))
        out = features.chosen_features(memory.select("vec_id"), now, before, ["vec_id"], 4, policy)
        return out.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "source", F.col("missing").cast("long").alias("missing"), "reason", "available")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, CASE WHEN vec_id % 2 = 0 THEN label::DOUBLE ELSE 0.0 END AS winrate, CASE WHEN vec_id % 2 = 0 AND vec_id % 3 > 0 THEN 1.0 / (label + 1) ELSE 0.0 END AS reciprocal FROM embeddings")
def feature_injection(spark, sf_dir):
    """Two places of a vector overwritten from a table that knows every second row."""
    i, memory = F.col("vec_id"), read(spark, sf_dir, "embeddings")
    given = memory.filter(i % 2 == 0).select("vec_id", F.col("label").alias("winrate"), F.when(i % 3 > 0, 1 / (F.col("label") + 1)).alias("reciprocal"))
    rows_ = memory.select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("vector"))
    out = features.injected(rows_, "vector", ["first", "winrate", "reciprocal"], given, ["vec_id"])
    return out.select("vec_id", F.round(F.col("vector")[0], 6).alias("first"), F.col("vector")[1].alias("winrate"), F.col("vector")[2].alias("reciprocal"))


@query(PACK + f" SELECT p.query_id, p.vec_id, d.vec_id IS NULL AS failed, CASE WHEN d.vec_id IS NULL THEN 'row_not_found' ELSE '' END AS reason, round(v.embedding_similarity, 6) AS embedding_similarity, round(v.jaccard_full, 6) AS jaccard_full, v.retrieved_text_length, v.step_index FROM p LEFT JOIN (SELECT vec_id FROM f WHERE vec_id % 4 > 0) d USING (vec_id) LEFT JOIN v ON v.query_id = p.query_id AND v.vec_id = d.vec_id")
def log_enrichment(spark, sf_dir):
    """Logged candidates of which a quarter is no longer in the memory."""
    memory = rows(spark, sf_dir)
    out = features.enriched(pairs(memory), memory.filter("vec_id % 4 > 0"), memory.filter("vec_id % 100 = 0"))
    return out.select("query_id", "vec_id", "failed", "reason", F.round("embedding_similarity", 6).alias("embedding_similarity"), F.round("jaccard_full", 6).alias("jaccard_full"), "retrieved_text_length", "step_index")
