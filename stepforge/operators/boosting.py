"""Gradient-boosted regression trees grown on summed histograms, logistic ones of a whole table, and LambdaMART over lists.

Features are cut into at most ``BINS`` bins at their quantiles. A level of a tree is grown from one array: the sums of the
gradients and curvatures of the rows of each (node, feature, bin). Where those sums come from is the caller's: a Spark job
over all lists (``lambdamart``) or all rows (``classifiers``), or rows already at hand (``local_sums``).

``classifiers`` grows a tree of every kind, without each fold in turn and of all folds, in the same jobs, one for each level.
Each task sends back one array of the same fixed size for each tree; gradients are rounded to multiples of 1 / ``SCALE`` and
added as whole numbers, so trees do not depend on how rows are dealt.

LambdaMART keeps each query's candidate list, which is bounded, in one row. A round's gradient of a pair of candidates of
different labels is the logistic loss of their scores weighted by what swapping them changes of the list's NDCG; pairs are
those with one of the ``TOP`` best-scored candidates. Scores are recomputed from the trees so far, so that a job keeps no
state between rounds, and a lost executor's lists are simply read again. A job brings back one array of bounded size,
summed by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.order import discarded, written

BINS, DEPTH, TREES, RATE = 32, 3, 30, 0.2
TOP = 8
L2, LEAST_CURVATURE, LEAST_GAIN = 1.0, 1e-3, 1e-6
SCALE, BLOCK = 1 << 28, 1 << 16


@dataclass(frozen=True)
class Tree:
    """A binary tree in heap order: the feature a node asks for (-1 for a leaf), the last bin that goes left, its value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends at."""
        at = np.zeros(len(bins), dtype=np.int64)
        while True:
            asked = self.feature[at]
            inner = np.flatnonzero(asked >= 0)
            if not len(inner):
                return at
            right = bins[inner, asked[inner]] > self.cut[at[inner]]
            at[inner] = 2 * at[inner] + 1 + right

    def values(self, columns: np.ndarray) -> np.ndarray:
        """The value of the node each row ends at; ``columns`` has a line of bins for each feature."""
        at, value, level = np.zeros(columns.shape[1], np.uint32), self.value[:1], 0
        while (2 << level) <= len(self.value):
            first, right = (1 << level) - 1, np.zeros(len(at), bool)
            for node in (np.flatnonzero(self.feature[first : 2 * first + 1] >= 0) + first).tolist():
                right |= (columns[self.feature[node]] > self.cut[node]) & (at == node - first)
            at = 2 * at + right
            # A leaf's value holds for all below it.
            inner = np.repeat(self.feature[first : 2 * first + 1] >= 0, 2)
            value, level = np.where(inner, self.value[2 * first + 1 : 4 * first + 3], np.repeat(value, 2)), level + 1
        return value[at]


@dataclass(frozen=True)
class Boosted:
    """Trees, and the upper edges of each feature's bins."""

    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def score(self, bins: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(bins.T)
        return sum((t.values(columns) for t in self.trees), np.zeros(len(bins)))

    def bins(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.edges)

    def plain(self) -> dict:
        """As JSON keeps it."""
        return {"edges": [[float(x) for x in e] for e in self.edges], "trees": [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in self.trees]}

    @classmethod
    def of(cls, plain: dict) -> "Boosted":
        return cls(plain["edges"], [Tree(np.array(f), np.array(c), np.array(v)) for f, c, v in plain["trees"]])


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each value: how many edges are below it."""
    return np.stack([np.searchsorted(np.asarray(e, dtype=float), values[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8) if edges else np.zeros((len(values), 0), np.uint8)


def edges_of(values: np.ndarray, bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 edges of each column, at quantiles of its values."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, cuts, method="lower"))[: bins - 1].tolist() for column in values.T] if len(values) else [[] for _ in values.T]


def edges_of_counts(counts: np.ndarray, bins: int = BINS) -> list[list[float]]:
    """``edges_of`` columns of whole numbers from 0, given how many rows of each column have each number."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.searchsorted(own.cumsum(), np.floor((own.sum() - 1) * cuts), side="right"))[: bins - 1].astype(float).tolist() for own in counts]


Sums = Callable[[Tree, int], np.ndarray]


def histogram(tree: Tree, level: int, bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, width: int) -> np.ndarray:
    """(nodes of the level, features, bins, 2): sums of slopes and curvatures."""
    first, features = (1 << level) - 1, bins.shape[1]
    node = tree.nodes(bins) - first
    ours = np.flatnonzero(node >= 0)
    cell = ((node[ours, None] * features + np.arange(features)) * width + bins[ours]).ravel()
    size = (1 << level) * features * width
    sums = [np.bincount(cell, np.repeat(w[ours], features), minlength=size) for w in (slope, curve)]
    return np.stack(sums, axis=1).reshape(1 << level, features, width, 2)


def local_sums(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, width: int = BINS) -> Sums:
    return lambda tree, level: histogram(tree, level, bins, slope, curve, width)


def _seed(depth: int) -> Tree:
    size = (2 << depth) - 1
    return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))


def _split(tree: Tree, level: int, found: np.ndarray, rate: float) -> bool:
    """Splits the nodes of a level where that gains; whether any was."""
    worth = lambda g, h: g * g / (h + L2)
    first, split = (1 << level) - 1, False
    for node in range(1 << level):
        left = found[node].cumsum(axis=1)
        both = left[:, -1:, :]
        if not both.size:
            continue
        g, h = both[0, 0]
        if level == 0:
            tree.value[0] = -rate * g / (h + L2)
        right = both - left
        gain = worth(left[..., 0], left[..., 1]) + worth(right[..., 0], right[..., 1]) - worth(g, h)
        gain = np.where((left[..., 1] >= LEAST_CURVATURE) & (right[..., 1] >= LEAST_CURVATURE), gain, -1.0)
        f, b = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
        if gain[f, b] > LEAST_GAIN:
            at, split = first + node, True
            tree.feature[at], tree.cut[at] = f, b
            for child, part in ((2 * at + 1, left), (2 * at + 2, right)):
                tree.value[child] = -rate * part[f, b, 0] / (part[f, b, 1] + L2)
    return split


def grown(sums: Sums, depth: int = DEPTH, rate: float = RATE) -> Tree:
    """A tree whose splits gain most of the second-order loss, level by level; ties go to the first feature and bin."""
    tree = _seed(depth)
    for level in range(depth):
        if not _split(tree, level, sums(tree, level), rate):
            break
    return tree


def classifier(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, edges: list[list[float]], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Trees of the logistic loss of weighted rows at hand; a score is a log-odds."""
    model, score = Boosted(edges), np.zeros(len(bins))
    for _ in range(trees if len(bins) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = grown(local_sums(bins, weights * (p - labels), weights * p * (1 - p)), depth, rate)
        model.trees.append(tree)
        score += tree.value[tree.nodes(bins)]
    return model


#: Kind, and the fold whose rows a model leaves out (the number of folds: none).
Key = tuple[str, int]


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.Table]:
    """The batches put together to tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def by_kind(block: pa.Table, features: dict[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """kind, bins, label, weight and fold of the rows of each kind in a block (kind, fold, label, weight, bins)."""
    for kind, n in features.items():
        own = block.filter(pc.equal(block.column("kind"), kind))
        if len(own):
            fold, label, weight = (own.column(c).to_numpy() for c in ("fold", "label", "weight"))
            yield kind, np.frombuffer(b"".join(own.column("bins").to_pylist()), np.uint8).reshape(-1, n), label, weight, fold


def _logistic_sums(rows: DataFrame, models: dict[Key, Boosted], trees: dict[Key, Tree], level: int) -> dict[Key, np.ndarray]:
    """The histograms of a level of all ``trees``, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast({key: (models[key], tree) for key, tree in trees.items()})
    shape = lambda model: (1 << level, len(model.edges), BINS, 2)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {key: np.zeros(shape(model), np.int64) for key, (model, _) in shared.value.items()}
        features = {kind: len(model.edges) for (kind, _), (model, _) in shared.value.items()}
        for block in blocks(batches):
            for kind, bins, label, weight, fold in by_kind(block, features):
                for key, (model, tree) in shared.value.items():
                    if key[0] == kind:
                        ours = np.flatnonzero(fold != key[1])
                        p = 1 / (1 + np.exp(-model.score(bins[ours])))
                        slope, curve = (np.rint(weight[ours] * x * SCALE) for x in (p - label[ours], p * (1 - p)))
                        total[key] += histogram(tree, level, bins[ours], slope, curve, BINS).astype(np.int64)
        columns = [[kind for kind, _ in total], [fold for _, fold in total], [t.tobytes() for t in total.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary()))], ["kind", "fold", "sums"])

    out = {key: np.zeros(shape(models[key]), np.int64) for key in trees}
    for row in rows.mapInArrow(sums, "kind string, fold int, sums binary").toArrow().to_pylist():
        key = row["kind"], row["fold"]
        out[key] += np.frombuffer(row["sums"], np.int64).reshape(out[key].shape)
    shared.destroy()
    return {key: found / SCALE for key, found in out.items()}


def classifiers(rows: DataFrame, edges: dict[str, list[list[float]]], folds: int, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict[Key, Boosted]:
    """``classifier`` of all rows (kind, fold, label, weight, bins: a byte for each feature) of each kind of ``edges``, once
    without each fold and once (at ``folds``) with all of them."""
    models = {(kind, fold): Boosted(own) for kind, own in edges.items() for fold in range(folds + 1)}
    for _ in range(trees if models else 0):
        growing = fresh = {key: _seed(depth) for key in models}
        for level in range(depth):
            found = _logistic_sums(rows, models, growing, level) if growing else {}
            growing = {key: tree for key, tree in growing.items() if _split(tree, level, found[key], rate)}
        for key, tree in fresh.items():
            models[key].trees.append(tree)
    return models


def lambdas(scores: np.ndarray, labels: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and curvatures of one list; equal scores keep the list's order."""
    slope, curve = np.zeros(len(scores)), np.zeros(len(scores))
    gain = np.exp2(labels) - 1
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    if ideal <= 0 or (labels == labels[0]).all():
        return slope, curve
    order = np.argsort(-scores, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    discount = 1 / np.log2(place + 2)
    better, worse = np.nonzero((labels[:, None] > labels) & (np.minimum(place[:, None], place) < top))
    weight = np.abs((gain[better] - gain[worse]) * (discount[better] - discount[worse])) / ideal
    odds = 1 / (1 + np.exp(scores[better] - scores[worse]))
    for target, sign in ((better, -1), (worse, 1)):
        np.add.at(slope, target, sign * weight * odds)
        np.add.at(curve, target, weight * odds * (1 - odds))
    return slope, curve


def lists_of(rows: DataFrame, query: str, label: str, features: list[str], order: list[str], edges: list[list[float]]) -> DataFrame:
    """bins (a byte for each feature, one candidate after the other) and labels of each query's list, in ``order``."""
    below = lambda name: lambda edge: edge < F.col(name)
    # The bin of a value is the number of edges below it.
    cells = [F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]).cast("array<double>"), below(f))).cast("tinyint") for f, e in zip(features, edges)]
    one = F.struct(*order, F.array(*cells).alias("bins"), F.col(label).cast("double").alias("label"))
    lists = rows.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("list"))
    return lists.select(F.flatten(F.transform("list", lambda x: x["bins"])).alias("bins"), F.transform("list", lambda x: x["label"]).alias("labels"))


def _summed(lists: DataFrame, model: Boosted, tree: Tree, level: int, width: int, top: int) -> np.ndarray:
    """The histogram of a level over all lists, added up by Spark."""
    shared = lists.sparkSession.sparkContext.broadcast((model, tree))
    features = len(model.edges)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, partial = shared.value
        total = np.zeros((1 << level, features, width, 2))
        for batch in batches:
            bins, labels = batch.column(0), batch.column(1)
            offsets, flat = labels.offsets.to_numpy(), labels.flatten().to_numpy()
            cells = bins.flatten().to_numpy().astype(np.uint8).reshape(-1, features)
            begin, score = offsets - offsets[0], known.score(cells)
            slope, curve = np.zeros(len(flat)), np.zeros(len(flat))
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                slope[a:b], curve[a:b] = lambdas(score[a:b], flat[a:b], top)
            total += histogram(partial, level, cells, slope, curve, width)
        cell = np.flatnonzero(total.reshape(-1, 2).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(total.reshape(-1, 2)[cell, i]) for i in range(2)]], ["cell", "slope", "curve"])

    found = lists.mapInArrow(sums, "cell long, slope double, curve double").groupBy("cell").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).toArrow()
    out = np.zeros(((1 << level) * features * width, 2))
    out[found.column("cell").to_numpy()] = np.stack([found.column("slope").to_numpy(), found.column("curve").to_numpy()], axis=1)
    return out.reshape(1 << level, features, width, 2)


def quantile_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Edges of all features at approximate quantiles of all rows."""
    cuts = [i / bins for i in range(1, bins)]
    return [sorted(set(found)) for found in rows.approxQuantile(features, cuts, 1e-3)]


def lambdamart(rows: DataFrame, query: str, label: str, features: list[str], order: list[str], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, top: int = TOP) -> Boosted:
    """Trees fitted on the lists of ``query``; ``features`` are doubles without nulls, ``label`` a grade from 0 up."""
    model = Boosted(quantile_edges(rows, features))
    lists = written(lists_of(rows, query, label, features, order, model.edges), "lists")
    for _ in range(trees):
        model.trees.append(grown(lambda tree, level: _summed(lists, model, tree, level, BINS, top), depth, rate))
    discarded(lists)
    return model


def ndcg(ranked: DataFrame, query: str, label: str, place: str, k: int = 10) -> DataFrame:
    """query, ndcg: of each query's first ``k`` by ``place`` (from 1) against the best order; 0 without relevant rows."""
    gain = F.pow(F.lit(2.0), F.greatest(F.coalesce(F.col(label).cast("double"), F.lit(0.0)), F.lit(0.0))) - 1
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("gain")))
    rows = ranked.select(query, F.col(place).alias("place"), gain.alias("gain")).withColumn("best", best)
    dcg = lambda at: F.sum(F.when(F.col(at) <= k, F.col("gain") / F.log2(F.col(at) + 1)).otherwise(0.0))
    sums = rows.groupBy(query).agg(dcg("place").alias("own"), dcg("best").alias("ideal"))
    return sums.select(query, F.when(F.col("ideal") > 0, F.col("own") / F.col("ideal")).otherwise(0.0).alias("ndcg"))
