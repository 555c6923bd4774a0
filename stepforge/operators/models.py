"""Learned rankers over candidate lists, fitted and applied by Spark's own learners.

Families: ``svm`` (linear, on differences within a query), ``ffn`` (pointwise network), ``boosted`` (pointwise trees),
``listnet`` (linear, cross-entropy of the top-one probabilities of each query's list) and ``lambdamart`` (trees on the pairs
of each list, weighted by what swapping them changes of its NDCG; its labels are grades). A difference is taken between a row
and the mean of its query's rows of the other label, so training rows grow with the candidates and not with their pairs. A
list's gradient is a sum that Spark adds up over all queries, one job a round.

Defined results: missing or non-numeric features count as 0; labels above 0 are relevant; where the rows have one label
only (or there are none) every score is 0; equal scores keep the retrieved order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stepforge.operators import boosting

FAMILIES = ("svm", "ffn", "boosted", "listnet", "lambdamart")
LAYERS = [128, 64, 32, 16]
SEED = 17
ROUNDS, RATE = 30, 1.0


@dataclass(frozen=True)
class Ranker:
    family: str
    features: tuple[str, ...]
    scaler: Any = None
    model: Any = None


def _plain(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"features the ranker was fitted on are missing: {missing}")
    plain = rows.withColumns({f"_f{i}": F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) for i, f in enumerate(features)})
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_raw").transform(plain)


def _differences(scaled: DataFrame, query: str, count: int) -> DataFrame:
    """Each row less the mean of its query's rows of the other label."""
    own = Window.partitionBy(query)
    wide = scaled.withColumn("_a", vector_to_array("_x"))
    other = lambda i: F.avg(F.when(F.col("_y") == 0, F.col("_a")[i])).over(own), lambda i: F.avg(F.when(F.col("_y") == 1, F.col("_a")[i])).over(own)
    cells = [F.col("_a")[i] - F.when(F.col("_y") == 1, other[0](i)).otherwise(other[1](i)) for i in range(count)]
    diffs = wide.select("_y", *[c.alias(f"_d{i}") for i, c in enumerate(cells)]).dropna()
    return VectorAssembler(inputCols=[f"_d{i}" for i in range(count)], outputCol="_x").transform(diffs)


def _listwise(scaled: DataFrame, query: str, count: int) -> list[float]:
    """Weights of a linear score whose softmax over a query's list is nearest to the softmax of its labels."""
    own = Window.partitionBy(query)
    lists = scaled.select(query, vector_to_array("_x").alias("_a"), "_y").repartition(query)
    lists = lists.withColumn("_m", F.max("_y").over(own)).withColumn("_e", F.exp(F.col("_y") - F.col("_m")))
    lists = lists.withColumn("_t", F.col("_e") / F.sum("_e").over(own)).select(query, "_a", "_t").persist()
    queries = lists.select(query).distinct().count()
    weights = [0.0] * count
    for _ in range(ROUNDS):
        score = sum((F.col("_a")[i] * w for i, w in enumerate(weights)), F.lit(0.0))
        rows = lists.withColumn("_z", score).withColumn("_top", F.max("_z").over(own)).withColumn("_e", F.exp(F.col("_z") - F.col("_top")))
        rows = rows.withColumn("_p", F.col("_e") / F.sum("_e").over(own))
        slope = rows.agg(*[F.sum((F.col("_p") - F.col("_t")) * F.col("_a")[i]) for i in range(count)]).first()
        weights = [w - RATE * (g or 0.0) / max(1, queries) for w, g in zip(weights, slope)]
    lists.unpersist()
    return weights


def fit(family: str, rows: DataFrame, query: str, label: str, features: list[str]) -> Ranker:
    if family not in FAMILIES:
        raise ValueError(f"unknown ranker family {family!r}")
    names = tuple(features)
    plain = _plain(rows, names).withColumn("_y", F.coalesce((F.col(label) > 0).cast("double"), F.lit(0.0)))
    low, high = plain.agg(F.min("_y"), F.max("_y")).first()
    if low == high:
        return Ranker(family, names)
    if family == "lambdamart":
        graded = plain.withColumn("_g", F.greatest(F.coalesce(F.col(label).cast("double"), F.lit(0.0)), F.lit(0.0)))
        columns = [f"_f{i}" for i in range(len(names))]
        return Ranker(family, names, None, boosting.lambdamart(graded, query, "_g", columns, columns))
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(plain)
    scaled = scaler.transform(plain)
    if family == "listnet":
        return Ranker(family, names, scaler, _listwise(scaled, query, len(names)))
    shared = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}
    if family == "svm":
        scaled = _differences(scaled, query, len(names))
        low, high = scaled.agg(F.min("_y"), F.max("_y")).first()
        if low == high:
            return Ranker(family, names)
        learner = LinearSVC(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=50, rawPredictionCol="_r", **shared)
    elif family == "ffn":
        learner = MultilayerPerceptronClassifier(layers=[len(names), *LAYERS, 2], maxIter=50, seed=SEED, probabilityCol="_q", rawPredictionCol="_r", **shared)
    else:
        learner = GBTClassifier(maxDepth=4, maxIter=20, stepSize=0.1, seed=SEED, **shared).setProbabilityCol("_q").setRawPredictionCol("_r")
    return Ranker(family, names, scaler, learner.fit(scaled))


def rank(ranker: Ranker, rows: DataFrame, query: str, retrieved: str) -> DataFrame:
    """``rows`` with score and final_rank; ``retrieved`` is the rank that decides between equal scores."""
    keep = [c for c in rows.columns if c not in ("score", "final_rank")]
    if ranker.model is None:
        scored = rows.select(*keep, F.lit(0.0).alias("score"))
    elif ranker.family == "lambdamart":
        plain = _plain(rows, ranker.features)
        return _placed(plain.select(*keep, _of_trees(ranker.model)(F.array(*[f"_f{i}" for i in range(len(ranker.features))])).alias("score")), query, retrieved)
    else:
        scaled = ranker.scaler.transform(_plain(rows, ranker.features))
        if ranker.family == "listnet":
            value = sum((vector_to_array("_x")[i] * w for i, w in enumerate(ranker.model)), F.lit(0.0))
            scored = scaled.select(*keep, value.alias("score"))
            return _placed(scored, query, retrieved)
        scored = ranker.model.transform(scaled)
        scored = scored.select(*keep, vector_to_array("_r" if ranker.family == "svm" else "_q")[1].alias("score"))
    return _placed(scored, query, retrieved)


def _of_trees(model: boosting.Boosted):
    @F.pandas_udf(DoubleType())
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(model.bins(np.stack(values.to_numpy()).astype(float))) if len(values) else [], dtype="float64")

    return score


def _placed(scored: DataFrame, query: str, retrieved: str) -> DataFrame:
    return scored.withColumn("final_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(retrieved))))


ABOUT = "family string, features array<string>, fitted boolean, weights array<double>, trees string"
MODELS = {"svm": LinearSVCModel, "ffn": MultilayerPerceptronClassificationModel, "boosted": GBTClassificationModel}


def save(ranker: Ranker, spark: SparkSession, path: str) -> None:
    """The ranker in a folder of its own: what it is as one JSON line, its scaler and its model as Spark keeps them."""
    weights = ranker.model if ranker.family == "listnet" else None
    trees = json.dumps(ranker.model.plain()) if ranker.family == "lambdamart" and ranker.model is not None else None
    row = (ranker.family, list(ranker.features), ranker.model is not None, weights, trees)
    spark.createDataFrame([row], ABOUT).coalesce(1).write.json(f"{path}/about")
    if ranker.model is not None and trees is None:
        ranker.scaler.write().save(f"{path}/scaler")
        if weights is None:
            ranker.model.write().save(f"{path}/model")


def load(spark: SparkSession, path: str, count: int | None = None) -> Ranker:
    """The ranker kept in a folder; raises if it reads another number of features than ``count``."""
    about = spark.read.schema(ABOUT).json(f"{path}/about").first()
    if count is not None and count != len(about["features"]):
        raise ValueError(f"the ranker reads {len(about['features'])} features, not {count}")
    if not about["fitted"]:
        return Ranker(about["family"], tuple(about["features"]))
    if about["family"] == "lambdamart":
        return Ranker(about["family"], tuple(about["features"]), None, boosting.Boosted.of(json.loads(about["trees"])))
    model = about["weights"] if about["family"] == "listnet" else MODELS[about["family"]].load(f"{path}/model")
    return Ranker(about["family"], tuple(about["features"]), StandardScalerModel.load(f"{path}/scaler"), model)
