"""The feature pack of retrieved candidates: what a ranker reads of a (query, row) pair.

Rows carry the text components ``full``, ``goal``, ``state`` and ``context`` of their key, their vectors and facts; a query
is a row of the same form. Lexical features need the texts of the pairs alone and TF-IDF weights of the whole corpus.
Context features are null unless both contexts are non-blank; distances of missing or unlike vectors are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions import text as tx
from stepforge.functions.similarity import l2
from stepforge.operators import evaluation
from stepforge.operators.ranking import terms

COMPONENTS = ("full", "goal", "state", "context")
MAX_SHARE = 0.95
SCALARS = [
    *[f"{c}_similarity" for c in ("embedding", "goal_only", "state_only", "context_only")],
    *[f"{kind}_{c}" for kind in ("jaccard", "query_overlap", "tfidf_cosine", "bigram_jaccard") for c in COMPONENTS],
    "task_match", "task_variation_match", "trajectory_length", "retrieved_text_length", "success_flag", "total_steps",
    "query_length", "step_index", "progress_alignment_abs_diff", "retriever_score", "retrieved_rank",
]


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def tfidf_cosines(pairs: DataFrame, rows: DataFrame, query: str = "query_id", key: str = "vec_id", queries: DataFrame | None = None) -> DataFrame:
    """query, key and tfidf_cosine_{component}: cosines of smoothed TF-IDF vectors, each component a corpus of its own.

    The corpus is counted once, with map-side sums; only the rows that stand in ``pairs`` are weighed. Queries are rows of the
    corpus, or of ``queries`` (of the same form), which the corpus does not count."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in COMPONENTS])).alias("e")
    split = lambda d: d.select(F.col(key).alias("id"), each).select("id", "e.*").filter(~_blank(F.col("text")))
    texts = split(rows)
    sizes = texts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    df = texts.select("part", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(sizes), "part").filter(F.col("df") <= MAX_SHARE * F.col("n"))  # four rows
    idf = idf.select("part", "term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))

    def weighed(texts: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
        held = texts.join(pairs.select(F.explode(F.array(*wanted)).alias("id")).distinct(), "id", "left_semi")
        tf = held.select("id", "part", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "part", "term").agg(F.count(F.lit(1)).alias("tf"))
        weights = tf.join(idf, ["part", "term"]).select("id", "part", "term", (F.col("tf") * F.col("idf")).alias("w"))
        return weights, weights.groupBy("id", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    weights, norms = weighed(texts, [query, key] if queries is None else [key])
    asking, asking_norms = (weights, norms) if queries is None else weighed(split(queries), [query])
    asked = pairs.select(query, key).join(asking.select(F.col("id").alias(query), "part", "term", F.col("w").alias("qw")), query)
    dots = asked.join(weights.withColumnRenamed("id", key), [key, "part", "term"]).groupBy(query, key, "part").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    for side, name, own in ((query, "qn", asking_norms), (key, "dn", norms)):
        dots = dots.join(own.select(F.col("id").alias(side), "part", F.col("norm").alias(name)), [side, "part"])
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dot") / (F.col("qn") * F.col("dn"))))
    return dots.groupBy(query, key).agg(*[F.max(F.when(F.col("part") == c, cosine)).alias(f"tfidf_cosine_{c}") for c in COMPONENTS])


def feature_pack(pairs: DataFrame, rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``pairs`` (query_id, vec_id, distance, rank) with all of ``SCALARS``, in full precision.

    rows: vec_id, full, goal, state, context, task, variation, the vectors embedding, goal_vector, state_vector and
    context_vector, step (number or null), guidance (an array of action and observation), total_steps, success. Queries are
    rows, or rows of the same form in ``queries``."""
    asking = rows if queries is None else queries
    names = [c for c in asking.columns if c != "vec_id"]
    q = asking.select(F.col("vec_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in names])
    both = pairs.select("query_id", "vec_id", "distance", "rank").join(rows, "vec_id").join(q, "query_id")
    both = both.join(tfidf_cosines(pairs, rows, queries=queries), ["query_id", "vec_id"], "left")
    has_context = ~_blank(F.col("context")) & ~_blank(F.col("q_context"))
    needed = lambda c, value: F.when(has_context, value) if c.startswith("context") else value
    out = {"embedding_similarity": l2(F.col("q_embedding"), F.col("embedding"))}
    for c in ("goal", "state", "context"):
        out[f"{c}_only_similarity"] = needed(c, l2(F.col(f"q_{c}_vector"), F.col(f"{c}_vector")))
    for c in COMPONENTS:
        mine, other = tx.tokens(F.col(f"q_{c}")), tx.tokens(F.col(c))
        out[f"jaccard_{c}"] = needed(c, tx.jaccard(mine, other))
        out[f"query_overlap_{c}"] = needed(c, tx.overlap(mine, other))
        out[f"tfidf_cosine_{c}"] = needed(c, F.coalesce(F.col(f"tfidf_cosine_{c}"), F.lit(0.0)))
        out[f"bigram_jaccard_{c}"] = needed(c, tx.jaccard(tx.bigrams(mine), tx.bigrams(other)))
    same = lambda name: F.coalesce(F.col(f"q_{name}").cast("string"), F.lit("None")) == F.coalesce(F.col(name).cast("string"), F.lit("None"))
    out |= {
        "task_match": same("task").cast("double"),
        "task_variation_match": (same("task") & same("variation")).cast("double"),
        "trajectory_length": F.coalesce(F.size("guidance"), F.lit(0)).cast("double"),
        "retrieved_text_length": tx.guidance_length(F.col("guidance"), F.col("full")).cast("double"),
        "success_flag": F.col("success").cast("double"),
        "total_steps": F.col("total_steps").cast("double"),
        "query_length": F.size(tx.tokens(F.col("q_full"))).cast("double"),
        "step_index": F.col("q_step").cast("double"),
        "progress_alignment_abs_diff": F.abs(F.col("q_step") - F.col("step")).cast("double"),
        "retriever_score": F.col("distance").cast("double"),
        "retrieved_rank": F.col("rank").cast("double"),
    }
    return both.select("query_id", "vec_id", *[out[name].alias(name) for name in SCALARS])


def capability_deltas(pairs: DataFrame, dimension: DataFrame, consumer: str, source: str, numbers: list[str], fallback: str = "max") -> DataFrame:
    """``pairs`` with consumer_*, source_* and consumer_minus_source_* of ``numbers``, found flags and same_model.

    ``dimension`` (model and numbers) is looked up by the exact name, else by its slug. A source that is not found takes the
    column's ``fallback`` (max or mean), or nothing if that is disabled."""
    if fallback not in ("max", "mean", "disabled"):
        raise ValueError(f"unknown source fallback {fallback!r}")
    exact = dimension.select(F.col("model").alias("name"), *numbers).dropDuplicates(["name"])
    slugged = dimension.groupBy(tx.slug(F.col("model")).alias("name")).agg(*[F.min_by(c, "model").alias(c) for c in numbers])
    best = dimension.agg(*[(F.max if fallback == "max" else F.avg)(c) for c in numbers]).first()
    out = pairs
    for side, column in (("consumer", consumer), ("source", source)):
        for table, kind in ((exact, "exact"), (slugged, "slug")):
            named = table.select(F.col("name").alias("name_"), F.lit(True).alias(f"{side}_{kind}"), *[F.col(c).alias(f"{side}_{kind}_{c}") for c in numbers])
            by = F.col(column) if kind == "exact" else tx.slug(F.col(column))
            out = out.join(named, by == F.col("name_"), "left").drop("name_")
    found = {side: F.coalesce(F.col(f"{side}_exact"), F.col(f"{side}_slug"), F.lit(False)) for side in ("consumer", "source")}
    columns = []
    for i, c in enumerate(numbers):
        mine, theirs = (F.when(F.col(f"{side}_exact"), F.col(f"{side}_exact_{c}")).otherwise(F.col(f"{side}_slug_{c}")) for side in ("consumer", "source"))
        if fallback != "disabled":
            theirs = F.when(found["source"], theirs).otherwise(F.lit(best[i]))
        columns += [mine.alias(f"consumer_{c}"), theirs.alias(f"source_{c}"), (mine - theirs).alias(f"consumer_minus_source_{c}")]
    return out.select(*pairs.columns, *columns, found["consumer"].alias("consumer_found"), found["source"].alias("source_found"), F.coalesce(tx.slug(F.col(consumer)) == tx.slug(F.col(source)), F.lit(False)).alias("same_model"))


def one_hots(column: Column, kinds: list[str], name: str = "agent_type") -> list[Column]:
    """A 0/1 column for each of ``kinds``, in sorted order."""
    return [F.coalesce(tx.sanitised(column) == kind, F.lit(False)).cast("double").alias(f"{name}__{kind}") for kind in sorted(kinds)]


def vector(names: list[str]) -> tuple[Column, Column]:
    """The named features as one vector, in that order, and how many of them are missing: those that are no numbers count as 0."""
    values = [F.col(f"`{c}`").cast("string").try_cast("double") for c in names]
    missing = F.aggregate(F.array(*[v.isNull().cast("int") for v in values]), F.lit(0), lambda s, x: s + x)
    return F.array(*[F.coalesce(v, F.lit(0.0)) for v in values]), missing


def exported_name(feature: str) -> str:
    """The name of a scalar in an exported training table."""
    kind, _, component = feature.rpartition("_")
    names = {"jaccard": "jaccard", "query_overlap": "query_overlap", "tfidf_cosine": "overlap_tfidf", "bigram_jaccard": "overlap_bigram"}
    if kind not in names or component not in COMPONENTS:
        return feature
    if component != "full":
        return f"{component}_only_{names[kind]}"
    return {"jaccard": "text_overlap_jaccard", "query_overlap": "query_overlap_ratio"}.get(kind, f"text_{names[kind]}")


#: The thirty scalars of an exported table, by their names there; the retrieved rank is not one of them.
EXPORTED = {name: feature for name, feature in sorted((exported_name(f), f) for f in SCALARS if f != "retrieved_rank")}


def training_rows(pack: DataFrame, labels: DataFrame) -> DataFrame:
    """qid, label, docid and the features of ``EXPORTED`` of each pair of ``pack`` that ``labels`` (query_id, vec_id, label)
    knows; queries are numbered from 1 in their order, missing features are null."""
    both = evaluation.qids(pack.join(labels, ["query_id", "vec_id"]), "query_id")
    return both.select("qid", F.col("label").cast("long").alias("label"), F.col("vec_id").cast("string").alias("docid"), *[F.col(f).alias(n) for n, f in EXPORTED.items()])


POLICIES = ("runtime", "json", "hybrid")


def chosen_features(candidates: DataFrame, computed: DataFrame, logged: DataFrame, keys: list[str], width: int, policy: str) -> DataFrame:
    """``candidates`` with features, source, missing, reason and available: which of two feature vectors a row is ranked by.

    computed (keys, vector, missing, error) is what was found just now, logged (keys, vector) what the row brought. ``runtime``
    takes the first, ``json`` the second, ``hybrid`` the first and where it is missing the second."""
    if policy not in POLICIES:
        raise ValueError(f"unknown feature source policy {policy!r}")
    now = computed.select(*keys, F.col("vector").alias("now_"), F.col("missing").alias("missing_"), F.coalesce("error", F.lit("")).alias("error_"))
    both = candidates.join(now, keys, "left").join(logged.select(*keys, F.col("vector").alias("before_")), keys, "left")
    has_now, has_before = F.col("now_").isNotNull() & (policy != "json"), F.col("before_").isNotNull() & (policy != "runtime")
    absent = {"runtime": "runtime_feature_missing", "json": "json_feature_missing", "hybrid": "runtime_and_json_missing"}[policy]
    error = F.coalesce("error_", F.lit(""))
    why = F.lit(absent) if policy == "json" else F.coalesce(F.nullif(error, F.lit("")), F.lit(absent))
    return both.select(
        *candidates.columns,
        F.when(has_now, F.col("now_")).when(has_before, F.col("before_")).alias("features"),
        F.when(has_now, "runtime").when(has_before, "json" if policy == "json" else "json_fallback").otherwise("error").alias("source"),
        F.when(has_now, F.coalesce("missing_", F.lit(0))).when(has_before, 0).otherwise(width).cast("int").alias("missing"),
        F.when(has_now, error).when(has_before, F.lit("") if policy == "json" else error).otherwise(why).alias("reason"),
        (has_now | has_before).alias("available"),
    )


def injected(rows: DataFrame, vector: str, names: list[str], values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with some places of ``vector`` (an array in the order of ``names``) taken from ``values`` (keys and columns
    named like the features); 0 where a row or a value is missing. A null vector stays null."""
    given = [c for c in values.columns if c in names]
    both = rows.join(values.select(*keys, *[F.col(c).alias(f"given_{c}") for c in given]), keys, "left")
    places = {c: names.index(c) for c in given}
    new = F.transform(F.col(vector), lambda x, i: F.coalesce(*[F.when(i == at, F.coalesce(F.col(f"given_{c}").cast("double"), F.lit(0.0))) for c, at in places.items()], x.cast("double")) if places else x)
    return both.select(*[new.alias(c) if c == vector else F.col(c) for c in rows.columns])


def enriched(log: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every entry of ``log`` (query_id, vec_id, distance, rank) with failed, reason and its features: those of
    ``feature_pack`` where the retrieved row is still in ``rows``, else nulls."""
    held = log.join(rows.select("vec_id"), "vec_id", "left_semi")
    pack = feature_pack(held, rows, queries)
    found = log.join(pack.withColumn("held_", F.lit(True)), ["query_id", "vec_id"], "left")
    failed = F.col("held_").isNull()
    return found.select(*log.columns, failed.alias("failed"), F.when(failed, "row_not_found").otherwise("").alias("reason"), *SCALARS)
