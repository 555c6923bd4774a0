import itertools
import random

import numpy as np
import pytest

import __spark_entry__
from stepforge.functions import similarity
from stepforge.operators import clusters, evaluation, ivf, models


def test_ivf_recall(spark, sf_dir):
    found, exact = (
        {(r.query_id, r.vec_id) for r in __spark_entry__.queries()[name](spark, sf_dir).collect()} for name in ("ivf_topk", "vec_topk_l2")
    )
    assert len(found & exact) >= 0.9 * len(exact)


def test_ivf_all_cells_is_exact_and_empty(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [0.0] * 4)]
    memory = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    centroids = ivf.fit(memory, cells=5)
    indexed = ivf.index(memory, centroids)
    assert indexed.count() == 62
    got = {(r.query_id, r["rank"]): r.vec_id for r in ivf.search(indexed, memory.filter("vec_id in (0, 61)"), centroids, k=4, probes=5).collect()}
    known = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v}
    for q in (0, 61):
        want = sorted(known, key=lambda i: (np.sqrt(((known[i] - known[q]) ** 2).sum()), i))[:4]
        assert [got[q, r] for r in range(1, 5)] == want
    none = memory.limit(0)
    assert ivf.search(ivf.index(none, ivf.fit(none)), none, ivf.fit(none)).count() == 0


@pytest.mark.parametrize("family", models.FAMILIES)
def test_rankers_put_relevant_first(spark, tmp_path, family):
    rng = random.Random(3)
    data = [(q, d, d + 1, float(rng.random() + (0.8 if (y := d % 4 == 3) else 0.0)), None if d == 0 else "7", int(y)) for q in range(40) for d in range(8)]
    rows = spark.createDataFrame(data, "q int, d int, rank int, f double, g string, label int")
    ranker = models.fit(family, rows.filter("q < 30"), "q", "label", ["f", "g"])
    ranked = models.rank(ranker, rows.filter("q >= 30"), "q", "rank").collect()
    good = [r.final_rank for r in ranked if r.label]
    assert len(ranked) == 80 and sum(good) / len(good) < 2.3
    flat = models.rank(models.fit(family, rows.filter("label = 0"), "q", "label", ["f"]), rows, "q", "rank")
    assert all(r.final_rank == r["rank"] and r.score == 0 for r in flat.collect())
    with pytest.raises(ValueError):
        models.rank(ranker, rows.drop("g"), "q", "rank")
    models.save(ranker, spark, str(tmp_path / family))
    again = models.rank(models.load(spark, str(tmp_path / family), 2), rows.filter("q >= 30"), "q", "rank").collect()
    assert sorted((r.q, r.d, r.final_rank, round(r.score, 9)) for r in again) == sorted((r.q, r.d, r.final_rank, round(r.score, 9)) for r in ranked)
    with pytest.raises(ValueError):
        models.load(spark, str(tmp_path / family), 3)


def _lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_sequence_ratio(spark):
    rng = random.Random(1)
    words = ["", "é", "abc"] + ["".join(rng.choice("abé ") for _ in range(rng.randrange(40))) for _ in range(20)]
    pairs = list(itertools.product(words, words))
    got = [r.r for r in spark.createDataFrame(pairs, "a string, b string").select(similarity.sequence_ratio("a", "b").alias("r")).collect()]
    assert got == [2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in pairs]
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(similarity.sequence_ratio("a", "b").alias("r")).first().r is None


def test_leaders_equal_the_greedy_loop(spark):
    rng = random.Random(9)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(i, i + 1) for i in range(70, 80)] + [(3, 3), (None, 4), (5, 999)]
    known = [*range(60), *range(70, 81)]
    near = {frozenset(p) for p in links}
    want: dict[int, int] = {}
    for i in known:
        if i not in want:
            want[i] = i
            want |= {j: i for j in known if j > i and j not in want and frozenset((i, j)) in near}
    got = clusters.leaders(spark.createDataFrame([(i,) for i in [*known, None, 3]], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.leader for r in got.collect()} == want and got.count() == len(want)
    assert clusters.leaders(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_messages(spark):
    log = [
        ("t", 1, "warning", True, True, "A Non-Admissible action", "similar words in trajectory context"),
        ("t", 1, "warning", True, None, "left out", None),
        ("t", 2, "warning", None, None, "non-admissible action", "similar words"),
        ("t", 2, "error", None, None, "JSON parsing failed", None),
        ("t", 2, "planner", None, None, None, None),
    ]
    df = spark.createDataFrame(log, "task string, episode int, kind string, structured boolean, fallback boolean, message string, cause string")
    found = {(r.task, r.episode): r for r in evaluation.message_rollup(evaluation.messages(df)).collect()}
    total, first, second = found[None, None], found["t", 1], found["t", 2]
    assert (total.warnings, total.errors) == (2, 2) and (first.type_non_admissible_action, first.cause_retrieval_trajectory_mismatch) == (1, 1)
    assert (second.cause_not_sure, second.type_json_parsing_failed, second.type_planner_failed) == (1, 1, 1)
