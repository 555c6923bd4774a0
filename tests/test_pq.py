import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stepforge.operators import pq


def clustered(n, seed, size=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, size))
    return (centres[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, size))).round(4)


def test_recall_of_a_reopened_index_on_new_queries(spark, tmp_path):
    vectors = clustered(6000, 1)
    memory = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(6)
    pq.build(memory, pq.fit(memory), str(tmp_path / "index"))
    index = pq.opened(spark, str(tmp_path / "index"))
    assert len(index.codebook.centroids) == 256 and index.codebook.words.shape == (16, 256, 2)
    assert index.rows.count() == 6000 and index.rows.select("cell").distinct().count() > 200
    asked = clustered(80, 1)[40:] + 0.01  # no row of the table, nor of the fit
    queries = spark.createDataFrame([(10_000 + i, v.tolist()) for i, v in enumerate(asked)], "vec_id long, embedding array<float>")
    found = {}
    for r in pq.search(index, queries, probed=0.25).collect():
        found.setdefault(r.query_id - 10_000, []).append((r["rank"], r.vec_id, r.distance))
    hits = 0
    for i, q in enumerate(asked):
        far = np.sqrt(((vectors.astype(np.float32).astype(float) - q.astype(np.float32)) ** 2).sum(axis=1))
        hits += len({v for _, v, _ in found[i]} & set(np.lexsort((np.arange(6000), far))[:10].tolist()))
        assert all(abs(d - far[v]) < 1e-6 for _, v, d in found[i]) and [r for r, _, _ in sorted(found[i])] == list(range(1, 11))
    assert hits >= 0.9 * 10 * len(asked)
    near = index.codebook.probed(asked, 0.25)
    sizes = np.bincount([r.cell for r in index.rows.select("cell").collect()], minlength=256)
    assert (near @ sizes).mean() <= 0.3 * 6000  # codes; whole vectors are read for 100 rows a query


def test_codes_are_read_without_vectors(spark, tmp_path):
    memory = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(300, 2, 8))], "vec_id long, embedding array<float>")
    pq.build(memory, pq.fit(memory, cells=4), str(tmp_path / "index"))
    index = pq.opened(spark, str(tmp_path / "index"))
    plan = index.rows.filter(F.col("cell").isin([1, 2])).select("vec_id", "cell", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "ReadSchema: struct<vec_id:bigint,code:binary>" in plan


def test_odd_tables(spark, tmp_path):
    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, []), (5, [0.0, 0.0, 9.0])]
    memory = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pq.build(memory, pq.fit(memory), str(tmp_path / "a"))
    got = pq.search(pq.opened(spark, str(tmp_path / "a")), memory, k=2, probed=1.0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(1, 1, 1), (1, 2, 3), (3, 1, 1), (3, 2, 3), (5, 1, 5), (5, 2, 1)]
    none = memory.limit(0)
    pq.build(none, pq.fit(none), str(tmp_path / "b"))
    assert pq.search(pq.opened(spark, str(tmp_path / "b")), memory).count() == 0
    with pytest.raises(ValueError):
        pq.fit(memory.union(spark.createDataFrame([(9, [1.0])], memory.schema)))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        pq.build(memory, pq.fit(memory), str(tmp_path / "a"))


def test_query_recall(spark, sf_dir):
    found, exact = ({(r.query_id, r.vec_id) for r in __spark_entry__.queries()[name](spark, sf_dir).collect()} for name in ("pq_topk", "vec_topk_l2"))
    assert len(found & exact) >= 0.9 * len(exact)
