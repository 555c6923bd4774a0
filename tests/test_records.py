import os
import random

from pyspark.sql import functions as F

from stepforge.functions import records


def test_paths_are_normal_as_a_system_has_them(spark):
    rng = random.Random(4)
    paths = ["", "/", "//", "///a", "//a/..", "..", "a/..", "/..", "./x/./y//z/../"] + ["".join(rng.choice(["/", "/", "a", "..", ".", "b"]) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    for r in df.select("p", records.normal_path(F.col("p")).alias("n")).collect():
        assert r.n == (os.path.normpath(r.p) if r.p else None), r.p


def test_scalars_of_nested_lists(spark):
    df = spark.createDataFrame([([["2.5"]],), ([["x", "1"]],), ([[]],), ([],), (None,), ([["0"]],), ([[""]],), ([["false"]],)], "a array<array<string>>")
    got = [tuple(r) for r in df.select(records.first_number(F.col("a"), 2), records.first_flag(F.col("a"), 2)).collect()]
    assert got == [(2.5, True), (0.0, True), (0.0, False), (0.0, False), (0.0, False), (0.0, False), (0.0, False), (0.0, False)]


def test_adapters_fill_defaults(spark):
    row = {"goal": F.lit(None).cast("string"), "task": F.lit("t"), "variation": F.lit(3), "id": F.lit("i"), "success": F.lit(True)}
    df = spark.createDataFrame([('[{"action": "go"}, null, {"score": 2, "observation": "o"}]',), ("no json",), ("[]",), (None,)], "g string")
    got = [r.t for r in df.select(records.trajectory_of(F.col("g"), row).alias("t")).collect()]
    assert [tuple(s) for s in got[0].steps] == [("go", "", "", 0.0), ("", "o", "", 2.0)] and [len(t.steps) for t in got] == [2, 0, 0, 0]
    assert tuple(got[0])[1:] == ("", "t", "3", "i", True)


def test_reranker_query_and_sources(spark):
    history = "STEP 0 | ACTION: a | REWARD: 1\nnothing\nx | ACTION:  b  | REWARD: 0\ny | ACTION: c | REWARD: 2"
    q = records.reranker_query(F.lit(" g "), F.lit(history), F.lit(""), F.lit("lamp"), F.lit("why "))
    labels = [records.source_label(e, F.lit(None).cast("string"), F.lit("m"), F.lit("kind")) for e in "ABC"]
    row = spark.range(1).select(q.alias("q"), *[c.alias(n) for c, n in zip(labels, "abc")], records.benchmark_score(F.lit("webarena/data")).alias("s")).first()
    assert tuple(row) == ("Goal: g | Recent action history: b | c | Inventory: lamp | Analysis: why", "m", "kind", "unknown", None)
