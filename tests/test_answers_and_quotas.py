import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stepforge.catalog import candidates
from stepforge.functions import responses
from stepforge.functions import text as tx
from stepforge.operators import features, ranking, splits


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("Let's think. In Summary, the action is ```click [3]``` ok ```b```", ("fenced", "click [3]", "Let's think.")),
        ("why\n```\n stop []\n```", ("fenced", "stop []", "why")),
        ("in summary ```a```", ("fenced", "a", "in summary")),
        ('``` never closed {"action": "go"}', ("json", "go", "")),
        ('so {"reasoning": "a } b { \\" c", "action": "x"} end', ("json", "x", 'a } b { " c')),
        ('{"o": {"action": "inner"}, "action": "outer"}', ("json", "outer", "")),
        ('{"cut": {"action": "whole", "reasoning": "r"}, "action": "tru', ("json", "whole", "r")),
        ('{bad} then {"action": ["a", 1]}', ("json", '["a", 1]', "")),
        ("it's {a} and \"b }\" then {\"action\": \"z\"}", ("json", "z", "")),
        ("no braces", ("none", None, "")),
        ('{"action": "open', ("none", None, "")),
        ("{} {", ("json", "", "")),
        (None, ("none", None, "")),
        ("}" * 50 + "{" * 50, ("none", None, "")),
    ],
)
def test_answers(answer, want):
    assert responses.parsed(answer) == want


def test_balanced_objects_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice('{}a"\\ ') for _ in range(rng.randrange(18)))
        for found in responses.json_objects(text):
            assert found.startswith("{") and found.endswith("}")
    deep = json.dumps({"a": [{"b": '}"{'}], "c": {}})
    assert list(responses.json_objects(f"x {deep} y {deep}")) == [deep, deep]
    assert list(responses.json_objects("{" * 100_000 + "}" * 100_000))[0].count("{") == 100_000


def plain_quotas(caps, total, least):
    quota, left, rest = dict.fromkeys(caps, 0), dict(caps), total
    if least * sum(c > 0 for c in caps.values()) <= total:
        for k in caps:
            quota[k] = min(least, caps[k])
            left[k] -= quota[k]
            rest -= quota[k]
    room = sum(left.values())
    share = {k: divmod(rest * left[k], room) if room else (0, 0) for k in caps}
    for k in caps:
        quota[k] += share[k][0]
        left[k] -= share[k][0]
    spare = total - sum(quota.values())
    for k in sorted((k for k in caps if left[k]), key=lambda k: (share[k][1], caps[k], k), reverse=True)[:spare]:
        quota[k] += 1
    return quota


def test_quotas_are_exact_under_capacities(spark):
    rng = random.Random(8)
    for case in range(12):
        caps = {f"k{i:02}": rng.choice([0, 1, 2, 5, 40, 200]) for i in range(rng.randrange(1, 14))}
        total, least = rng.randrange(sum(caps.values()) + 1), rng.choice([0, 1, 3])
        strata = spark.createDataFrame(list(caps.items()), "k string, cap long")
        got = {r.k: r.quota for r in splits.capped_quotas(strata, "k", total, least).collect()}
        assert sum(got.values()) == total and all(got[k] <= caps[k] for k in caps) and got == plain_quotas(caps, total, least)
    with pytest.raises(ValueError):
        splits.capped_quotas(strata, "k", sum(caps.values()) + 1)


def plain_split(caps, size):
    size = min(size, sum(caps.values()))
    quota = {k: min(max(1, caps[k] * size // sum(caps.values())), caps[k]) for k in sorted(caps)}
    while sum(quota.values()) > size:
        quota[max((k for k in quota if quota[k] > 1), key=lambda k: quota[k])] -= 1
    while sum(quota.values()) < size:
        quota[max((k for k in quota if quota[k] < caps[k]), key=lambda k: caps[k] - quota[k])] += 1
    return quota


def test_split_quotas_equal_steps_of_one(spark):
    rng = random.Random(3)
    for _ in range(12):
        caps = {f"k{i:02}": rng.choice([1, 1, 2, 3, 9, 60]) for i in range(rng.randrange(1, 14))}
        size = rng.randrange(len(caps), sum(caps.values()) + 5)
        strata = spark.createDataFrame(list(caps.items()), "k string, cap long")
        assert {r.k: r.quota for r in splits.split_quotas(strata, "k", size).collect()} == plain_split(caps, size)
    df = spark.createDataFrame([(i, f"g{i % 30}") for i in range(200)], "id long, g string")
    for size in (10, 50, 500):
        parts = [r.part for r in splits.split_sample(df, "g", "id", size, "s").collect()]
        assert len(parts) == 200 and parts.count("test") == min(size, 200)
    with pytest.raises(ValueError):
        splits.split_quotas(df.groupBy("g").agg(F.count("id").alias("cap")), "g", 10)


def slow_passes(size, wins, k):
    """Exchange sort from the end, with the place of the last pass's first exchange kept as it goes."""
    order, last = list(range(size)), size - 1
    for i in range(min(k, size)):
        at, changed = last, False
        while at > i:
            if (order[at], order[at - 1]) in wins:
                order[at - 1], order[at] = order[at], order[at - 1]
                if not changed:
                    changed = True
                    last += last != size - 1
            if not changed:
                last -= 1
            at -= 1
    return order


def test_passes_with_contradictory_answers():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(9)
        wins = {p for p in itertools.permutations(range(n), 2) if rng.random() < 0.5}
        assert ranking.pass_order(n, wins, k := rng.randrange(6)) == slow_passes(n, wins, k)
    assert ranking.pass_order(3, {(1, 0), (2, 1), (0, 2)}, 3) == slow_passes(3, {(1, 0), (2, 1), (0, 2)}, 3)


def test_pass_sorted_query(spark, sf_dir):
    lists = {}
    for r in candidates(spark, sf_dir).collect():
        lists.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    got = {(r.query_id, r.vec_id): r.final_rank for r in __spark_entry__.queries()["pass_sorted"](spark, sf_dir).collect()}
    for q, own in lists.items():
        ids = [v for _, v in sorted(own)]
        wins = {(a, b) for a, b in itertools.permutations(range(len(ids)), 2) if (ids[a] * 7 + ids[b] * 3) % 5 < 2}
        for place, at in enumerate(slow_passes(len(ids), wins, 5)):
            assert got[q, ids[at]] == place + 1


def test_guidance_length_counts_as_json_is_written(spark):
    steps = [[("go\tto  x", 'say "hi" \n now'), (None, "é ü z")], [("", "")], [], None]
    df = spark.createDataFrame([(i, s, "k e y") for i, s in enumerate(steps)], "i int, g array<struct<action:string,observation:string>>, k string")
    want = [len(json.dumps([{"action": a, "observation": o} for a, o in s]).split()) if s else 3 for s in steps]
    assert [r.n for r in df.select("i", tx.guidance_length(F.col("g"), F.col("k")).alias("n")).orderBy("i").collect()] == want


def test_exported_names():
    assert len(features.EXPORTED) == 30 and list(features.EXPORTED) == sorted(features.EXPORTED)
    assert {"text_overlap_tfidf", "goal_only_overlap_bigram", "query_overlap_ratio", "context_only_query_overlap", "state_only_jaccard", "total_steps"} <= set(features.EXPORTED)
    with pytest.raises(ValueError):
        features.chosen_features(None, None, None, [], 1, "odd")
