import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepforge.llm import decontam, langid, mixing
from stepforge.llm.queries import tokenizer_path
from stepforge.llm.shared import table


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before
    assert decontam.contaminated(kept, table(spark, sf_dir, "benchmark")).count() == 0
    mixed = corpus_pipeline.mixture(spark, kept, sf_dir)
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect() if r.copies}
    assert mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == copies
    result = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(result) == sum(copies.values())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    assert result.n_tokens.sum() == sum(n * (1 + len(tokenizer.encode(texts[i], add_special_tokens=False).ids)) for i, n in copies.items())
    assert langid.UNKNOWN not in {r.lang_pred for r in langid.identify(kept, langid.fit(docs)).select("lang_pred").collect()}


#: Names that the stages use for columns of their own, or once did.
CLASHING = ["score", "lang_pred", "bits_per_byte", "size", "copy", "copies", "taken", "target", "source_size", "letters", "_letters", "key", "Key_", "row", "at", "part", "tie", "dealt", "shift", "id", "n", "kept", "component_id"]


@pytest.fixture(scope="module")
def literal(spark, tmp_path_factory):
    rng = random.Random(11)
    pick = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, pick("abcdefg" if i % 2 else "tuvwxyz", 60), "aa" if i % 2 else "zz", ("s", "t", None)[i % 3]) for i in range(120)]
    rows += [(200 + i, t, None, s) for i, (_, t, _, s) in enumerate(rows[:10])]  # exact copies
    rows += [(None, rows[0][1], "aa", "s"), (None, rows[0][1], "aa", "s")]  # copies without an id
    alone = pick("abcdefg", 50)
    rows += [(None, alone, "aa", "t"), (None, alone, None, "t")]
    rows += [(300, pick("abcdefg", 20) + " " + rows[5][1][:150].rsplit(" ", 1)[0], "aa", "s"), (301, None, "aa", "s"), (302, "", None, None), (303, "12 34 !!", "zz", "t"), (304, pick("tuvwxyz", 4000), None, "s")]
    rows += [rows[7], (7, pick("abcdefg", 40), "aa", "s")]  # repeated ids
    path = str(tmp_path_factory.mktemp("literal"))
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).repartition(3).withColumns({c: F.concat(F.lit(c), F.length(F.coalesce("text", F.lit(""))).cast("string")) for c in CLASHING})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[:12])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def whole(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:4]])
def test_stages_give_rows_back_as_they_came(spark, literal, name):
    path, docs = literal
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, path)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    before, after = whole(docs), whole(got)
    assert set(after) <= set(before) and after
    empty = stage(spark, docs.limit(0), path)
    assert empty.columns == docs.columns and empty.count() == 0
    texts = [(r.doc_id, r.text) for r in got.collect()]
    if name == "language":
        assert {r.doc_id for r in docs.collect()} - {i for i, _ in texts} == {301, 302, 303}
    if name == "near_duplicates":
        ids = [i for i, _ in texts]
        assert not set(range(200, 210)) & set(ids) and {301, 302, 303, 304} <= set(ids)
        assert ids.count(None) == 1 and len([t for _, t in texts if t is not None]) == len({t for _, t in texts if t is not None}) + (ids.count(7) == 3)
    if name == "decontamination":
        first = docs.filter("doc_id = 5").first().text
        assert not [t for _, t in texts if t and " ".join(first.split()[:12]) in t] and len(before) - len(after) == 3


def test_tokens_of_a_literal_table(spark, literal):
    path, docs = literal
    got = corpus_pipeline.token_ids(spark, docs, path).collect()
    assert len(got) == docs.count() and sum(r.doc_id is None for r in got) == 4 and {r.n_tokens for r in got if r.doc_id in (301, 302)} == {1}
    assert corpus_pipeline.token_ids(spark, docs.limit(0), path).count() == 0
