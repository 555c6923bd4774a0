import duckdb
import pandas as pd
import pytest

import __spark_entry__
from stepforge import catalog
from stepforge.operators import evaluation, ranking, splits
from stepforge.plans.settings import SearchSettings, stages
from stepforge.sources import io
from stepforge.streaming import push

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    text = lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(name, spark, sf_dir, duck):
    ours = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_disagreements_equal_pairs(spark):
    import itertools
    import random

    random.seed(3)
    data = [(random.randrange(4), random.choice("ab"), i, random.random() < 0.3, random.random() < 0.5) for i in range(80)]
    want = {}
    for x, y in itertools.permutations(data, 2):
        if not x[3] and x[0] == y[0] and (y[3] or x[1] == y[1]) and x[4] != y[4]:
            want[x[2]] = want.get(x[2], 0) + (1 if x[4] else -1)
    got = evaluation.disagreements(spark.createDataFrame(data, "comp int, cluster string, run_id int, baseline boolean, success boolean")).collect()
    assert {r.run_id: r.score for r in got} == want


def test_bigram_jaccard_and_fusion(spark, sf_dir):
    found = __spark_entry__.queries()["bigram_jaccard"](spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet").set_index("item_id").text
    pairs = lambda t: set(zip(t.lower().split(), t.lower().split()[1:]))
    for r in found.head(20).itertuples():
        a, b = pairs(items[r.item_id]), pairs(docs[r.doc_id])
        assert abs(len(a & b) / len(a | b) - r.jaccard) < 1e-5
    fused = ranking.merged(spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "g int, k int, rank int"), spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "g int, k int, rank int"), "g", "k")
    assert [(r.k, r["rank"]) for r in fused.orderBy("rank").collect()] == [(5, 1), (6, 2), (7, 3)]


def test_bins_and_settings(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "x int")
    assert splits.step_bins(df, "x") == [10, 25, 50, 75, 90]
    assert splits.step_bins(df.limit(0), "x") == []
    assert stages("llm_then_ltr_with_llm_features", [], 15) == [("llm", 15), ("ltr", 10)]
    with pytest.raises(ValueError):
        SearchSettings(diversity="same_task").condition()
    with pytest.raises(ValueError):
        SearchSettings(diversity="odd").condition("a", "b")


def test_sources_round_trip(spark, tmp_path):
    import json

    for i, (split, n) in enumerate([("train", 0), ("train", 1), ("train", 7), ("test", 3)]):
        d = tmp_path / "in" / f"task{i}" / "v0"
        d.mkdir(parents=True)
        (d / f"{i}.json").write_text(json.dumps({"task_id": f"t{i}", "split": split, "trajectory": [{"observation": f"o{j}", "action": f"a{j}"} for j in range(n)]}, indent=1))
    found = io.read_trajectories(spark, str(tmp_path / "in"))
    assert found.count() == 3
    assert io.exploded(found, drop_last=True).count() == 6
    assert {(r.task_name, r.variation, r.trajectory_id) for r in found.select(*io.path_keys(found.path)).collect()} == {("task0", "v0", "0"), ("task1", "v0", "1"), ("task2", "v0", "2")}
    features = spark.createDataFrame([(1, 0.5, "d", None)], "qid int, label double, docid string, f double")
    io.write_features(features, str(tmp_path / "f"))
    back = io.read_features(spark, str(tmp_path / "f"), "qid int, label double, docid string, f double")
    assert back.collect() == features.collect() and io.feature_columns(back) == ["f"]


def test_readers_choose_files_and_rows(spark, tmp_path):
    import json

    for run, names in {"run_1": ["a_trajectories", "a_trajectories_rag"], "run_2": ["b_trajectories_agentic", "notes"], "other": ["c_trajectories"]}.items():
        (tmp_path / "logs" / run).mkdir(parents=True)
        for name in names:
            (tmp_path / "logs" / run / f"{name}.json").write_text(json.dumps({"taskName": name}))
    found = io.read_runs(spark, str(tmp_path / "logs"), "run_", "taskName string").collect()
    assert {(r.run, r.taskName) for r in found} == {("run_1", "a_trajectories_rag"), ("run_2", "b_trajectories_agentic")}
    files = spark.createDataFrame([(f"/x/{n}.json",) for n in ("10", "9", "b", "2", "a")], "path string")
    assert [r.path[3:-5] for r in io.in_name_order(files).orderBy("name_order").collect()] == ["2", "9", "10", "a", "b"]
    (tmp_path / "conf").mkdir()
    for i, body in enumerate(['{"task_id": 1, "intent_template_id": 7}', '{"task_id": 2}', "[1, 2]"]):
        (tmp_path / "conf" / f"{i}.json").write_text(body)
    configs = io.read_configs(spark, str(tmp_path / "conf"), "task_id long, intent_template_id long").collect()
    assert [(r.task_id, r.task_name) for r in configs] == [(1, "intent_template_id_7")]
    steps = spark.createDataFrame([("t", 1, 0, ["old"]), ("t", 1, 5, ["a", "b"]), ("u", 2, 1, [])], "task_name string, variation int, seen int, trajectory array<string>")
    assert sorted((r.task_name, r.variation, r.step_index, r.step) for r in io.replay_steps(steps, "seen").collect()) == [("t", "1", 0, "a"), ("t", "1", 1, "b")]
    (tmp_path / "cap.tsv").write_text("Model\tTop Score (%)\tNote\nm 1\t 4.5 \tx\n\t7\t\n")
    capabilities = io.read_capabilities(spark, str(tmp_path / "cap.tsv"))
    assert capabilities.columns == ["model", "top_score", "note"] and [tuple(r) for r in capabilities.orderBy("top_score").collect()] == [("m 1", 4.5, None), (None, 7.0, None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "q2", "t1", 0.5, "test"), (1, "q1", "t2", 0.25, "train"), (1, "q1", "t1", 1.0, "test")], "qid int, query string, task_name string, score double, part string")
    io.write_qid_map(df, "query", str(tmp_path / "map"))
    assert sorted((r.qid, r["query"]) for r in io.read_features(spark, str(tmp_path / "map"), "qid int, query string", labelled=False).collect()) == [(1, "q1"), (2, "q2")]
    with pytest.raises(ValueError):
        io.read_features(spark, str(tmp_path / "map"), "qid int, query string")
    io.write_splits(df, str(tmp_path / "splits"), "part", ["qid"])
    assert [r.qid for r in spark.read.json(str(tmp_path / "splits" / "part=test")).collect()] == [1, 2]
    io.write_runs(df, str(tmp_path / "out"), {"metrics": ["score"], "queries": ["query"]})
    assert spark.read.json(str(tmp_path / "out" / "metrics" / "task_name=t1")).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        io.write_json(df, str(tmp_path / "out" / "metrics"))
    text = io.report(df.select("task_name", "score"), "Scores")
    assert text.startswith("Scores\n======\n") and "task_name: t2  score: 0.2500" in text
    rows = df.withColumn("environment", df.part)
    io.create_memory(rows, str(tmp_path / "memory"))
    io.append_memory(rows.drop("score"), str(tmp_path / "memory"))
    assert spark.read.option("mergeSchema", True).parquet(str(tmp_path / "memory")).count() == 6
    with pytest.raises(ValueError):
        io.append_memory(rows.withColumn("score", rows.query), str(tmp_path / "memory"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        io.create_memory(rows, str(tmp_path / "memory"))


def test_text_search_in_blocks_equals_one_block(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = [sorted(map(str, ranking.bm25_topk(docs, items, "doc_id", "item_id", 5).collect()))]
    monkeypatch.setattr(ranking, "BLOCK", 7)
    monkeypatch.setattr(ranking, "CELLS", 20_000)
    found.append(sorted(map(str, ranking.bm25_topk(docs, items, "doc_id", "item_id", 5).collect())))
    assert found[0] == found[1] and ranking.bm25_topk(docs, items.limit(0), "doc_id", "item_id", 5).count() == 0
    near = [sorted(map(str, ranking.tfidf_topk(docs, items, "doc_id", "item_id", 5).collect()))]
    monkeypatch.setattr(ranking, "TERMS", 10)
    near.append(sorted(map(str, ranking.tfidf_topk(docs, items, "doc_id", "item_id", 5).collect())))
    assert near[0] == near[1]


def test_push_stream_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string").write.parquet(src)
    for n in range(2):
        stream = spark.readStream.schema("k int, v string").parquet(src)
        push.push_stream(stream, out, str(tmp_path / f"c{n}"), ["k", "v"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2
