import math
import random

import numpy as np
import pytest

import __spark_entry__
from stepforge.operators import boosting, models


def data(rng, queries, size=8):
    """Lists whose grade follows a product of two features, so that neither alone ranks them."""
    for q in range(queries):
        for d in range(size):
            a, b = rng.random(), rng.random()
            noise = rng.gauss(0, 0.05)
            yield q, d, d + 1, a, b, rng.random(), int(2 * ((a > 0.5) == (b > 0.5)) + (noise > 0.03))


def plain_pairs(scores, labels, top):
    slope, curve = [0.0] * len(scores), [0.0] * len(scores)
    gain = [2**y - 1 for y in labels]
    ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gain, reverse=True)))
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    place = {i: p for p, i in enumerate(order)}
    for i in range(len(scores)):
        for j in range(len(scores)):
            if labels[i] > labels[j] and min(place[i], place[j]) < top and ideal:
                w = abs((gain[i] - gain[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                p = 1 / (1 + math.exp(scores[i] - scores[j]))
                slope[i] -= w * p
                slope[j] += w * p
                curve[i] += w * p * (1 - p)
                curve[j] += w * p * (1 - p)
    return slope, curve


def test_gradients_equal_a_loop_over_pairs():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 15)
        scores = [rng.choice([0.0, 1.0, rng.gauss(0, 1)]) for _ in range(n)]
        labels = [float(rng.randrange(4)) for _ in range(n)]
        got = boosting.lambdas(np.array(scores), np.array(labels), 3)
        for mine, want in zip(got, plain_pairs(scores, labels, 3)):
            assert np.allclose(mine, want)


def best_split(bins, slope, curve, rows):
    worth = lambda part: sum(slope[i] for i in part) ** 2 / (sum(curve[i] for i in part) + boosting.L2)
    best = (boosting.LEAST_GAIN, None, None)
    for f in range(bins.shape[1]):
        for b in range(boosting.BINS):
            left, right = [i for i in rows if bins[i, f] <= b], [i for i in rows if bins[i, f] > b]
            if min(sum(curve[i] for i in left), sum(curve[i] for i in right)) >= boosting.LEAST_CURVATURE:
                gain = round(worth(left) + worth(right) - worth(rows), 9)
                if gain > best[0]:
                    best = (gain, f, b)
    return best[1:]


def test_trees_over_lists_equal_a_plain_loop(spark):
    """Two trees of depth 2 on 50 lists, dealt over several tasks, against splits found row by row."""
    rows = list(data(random.Random(6), 50, 6))
    df = spark.createDataFrame(rows, "q int, d int, rank int, f double, g double, h double, y int").repartition(7)
    model = boosting.lambdamart(df, "q", "y", ["f", "g", "h"], ["d"], trees=2, depth=2, rate=0.5)
    bins = model.bins(np.array([r[3:6] for r in rows]))
    score = np.zeros(len(rows))
    for tree in model.trees:
        slope, curve = (np.concatenate(x) for x in zip(*[boosting.lambdas(score[a : a + 6], np.array([float(r[6]) for r in rows[a : a + 6]])) for a in range(0, len(rows), 6)]))
        held = {0: list(range(len(rows)))}
        for node in (0, 1, 2):
            if node in held and tree.feature[node] >= 0:
                f, b = best_split(bins, slope, curve, held[node])
                assert (tree.feature[node], tree.cut[node]) == (f, b)
                for child, part in ((2 * node + 1, [i for i in held[node] if bins[i, f] <= b]), (2 * node + 2, [i for i in held[node] if bins[i, f] > b])):
                    held[child] = part
                    assert math.isclose(tree.value[child], -0.5 * sum(slope[i] for i in part) / (sum(curve[i] for i in part) + boosting.L2), abs_tol=1e-9)
        score += tree.value[tree.nodes(bins)]
    assert (tree.feature >= 0).sum() >= 2


def test_lambdamart_ranks_held_out_lists_better(spark):
    rows = spark.createDataFrame(list(data(random.Random(5), 160)), "q int, d int, rank int, f double, g double, h double, y int").persist()
    quality = {}
    for family in ("boosted", "svm", "lambdamart"):
        ranker = models.fit(family, rows.filter("q < 100"), "q", "y", ["f", "g", "h"])
        ranked = models.rank(ranker, rows.filter("q >= 100"), "q", "rank")
        quality[family] = boosting.ndcg(ranked, "q", "y", "final_rank", 5).agg({"ndcg": "avg"}).first()[0]
    assert quality["lambdamart"] > quality["boosted"] > quality["svm"] + 0.2


def test_ndcg_of_plain_lists(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 1), (2, 1, 0), (3, 1, None), (3, 2, 1)], "q int, p int, y int")
    got = {r.q: r.ndcg for r in boosting.ndcg(rows, "q", "y", "p", 2).collect()}
    assert math.isclose(got[1], (3 / math.log2(3)) / (3 + 1 / math.log2(3))) and got[2] == 0 and math.isclose(got[3], 1 / math.log2(3))


def test_classifier_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) == (x[:, 1] > 0.5)).astype(float)
    edges = boosting.edges_of(x)
    model = boosting.classifier(boosting.binned(x, edges), y, np.ones(len(y)), edges)
    assert ((model.score(model.bins(x)) > 0) == (y > 0)).mean() > 0.97
    again = boosting.Boosted.of(model.plain())
    assert np.array_equal(again.score(again.bins(x)), model.score(model.bins(x)))


def test_values_equal_those_of_the_nodes():
    rng = np.random.default_rng(7)
    for depth in (0, 1, 2, 3, 5):
        for size in (0, 1, 300):
            feature = np.where(np.arange((2 << depth) - 1) < (1 << depth) - 1, rng.integers(-1, 4, (2 << depth) - 1), -1)
            for at in range(1, len(feature)):
                feature[at] = -1 if feature[(at - 1) // 2] < 0 else feature[at]
            tree = boosting.Tree(feature, rng.integers(0, 31, len(feature)), rng.random(len(feature)))
            bins = rng.integers(0, 32, (size, 4), dtype=np.uint8)
            assert np.array_equal(tree.values(bins.T), tree.value[tree.nodes(bins)])


def test_edges_of_counts_equal_those_of_values():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 31, 32, 33, 500, 4001):
        values = np.stack([rng.integers(0, top, n) for top in (1, 3, 40, 256)], axis=1)
        counts = np.stack([np.bincount(column, minlength=256) for column in values.T])
        assert boosting.edges_of_counts(counts) == boosting.edges_of(values.astype(float))


def test_classifiers_of_a_table_equal_those_of_rows_at_hand(spark):
    """Every kind and fold, however the rows are dealt."""
    rng = np.random.default_rng(5)
    edges, rows = {"a": [[0.0, 1.0, 2.0]] * 3, "b": [[0.0, 1.0, 2.0, 3.0]] * 2}, []
    for kind, own in edges.items():
        for _ in range(700):
            bins = rng.integers(0, len(own[0]) + 1, len(own), dtype=np.uint8)
            rows.append((kind, int(rng.integers(3)), int(rng.random() < 0.1 + 0.8 * ((bins[0] > 1) == (bins[1] > 1))), 1 + float(rng.random()), bins.tobytes()))
    df = spark.createDataFrame(rows, "kind string, fold int, label int, weight double, bins binary")
    models = boosting.classifiers(df.repartition(5), edges, 3, trees=4, depth=2)
    again = boosting.classifiers(df.coalesce(1), edges, 3, trees=4, depth=2)
    assert {k: m.plain() for k, m in models.items()} == {k: m.plain() for k, m in again.items()}
    for (kind, fold), model in models.items():
        own = [r for r in rows if r[0] == kind and r[1] != fold]
        bins = np.stack([np.frombuffer(r[4], np.uint8) for r in own])
        want = boosting.classifier(bins, np.array([float(r[2]) for r in own]), np.array([r[3] for r in own]), edges[kind], trees=4, depth=2)
        for mine, other in zip(model.trees, want.trees):
            assert mine.feature.tolist() == other.feature.tolist() and mine.cut.tolist() == other.cut.tolist() and np.allclose(mine.value, other.value, atol=1e-6)


def test_heldout_query(spark, sf_dir):
    found = {r.family: r for r in __spark_entry__.queries()["learned_rank_heldout"](spark, sf_dir).collect()}
    assert set(found) == {"retrieved", *models.FAMILIES} and all(0 <= r.ndcg <= 1 for r in found.values())
