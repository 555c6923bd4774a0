"""Words made to share a polynomial hash, hot and null ids, moving splits, and the operators' SQL."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stepforge.llm import decontam, dedup_near, langid, queries, shared, textops, tokens, toxicity
from stepforge.llm.queries import tokenizer_path


def thue_morse(n=10):
    word = "a"
    for _ in range(n):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


ONE, OTHER = thue_morse()


def hashes(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return textops.span_hashes(data, np.append(0, ends[:-1]), ends)


def test_hashes_depend_on_bytes_and_places_alone():
    assert len(set(hashes([ONE, OTHER, ONE[:512] * 2, "", "a", "aa", "b"]).tolist())) == 7
    spread = np.frombuffer(f"..{ONE} {ONE}x{OTHER}".encode(), np.uint8)
    starts = np.array([2, 1027, 2052])
    got = textops.span_hashes(spread, starts, starts + 1024)
    assert got[0] == got[1] == hashes([ONE])[0] and got[2] == hashes([OTHER])[0] != got[0]
    long = ["ab" * 400_000, "ba" * 400_000]
    assert hashes(long)[0] != hashes(long)[1] and hashes([long[1]])[0] == hashes(long)[1]


def test_token_ids_of_words_that_shared_a_hash(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [f"see {ONE} here", f"see {OTHER} here", f"see {ONE} {OTHER}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids_crc32 for r in tokens.read_shards(tokens.write_shards(docs, tokenizer_path())).collect()}
    assert got == {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}


def test_encoder_compares_bytes_where_keys_are_equal(monkeypatch):
    """With a hash of two values, ids still are the tokenizer's."""
    weak = lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2) + np.uint64(8)
    monkeypatch.setattr(textops, "span_hashes", weak)
    encoder, rng = tokens.Encoder(tokenizer_path()), random.Random(4)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcé.") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(5)]
        raw = [t.encode() for t in texts]
        ids, sizes = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_near_duplicates_and_decontamination_of_such_words(spark):
    docs = spark.createDataFrame([(1, f"one two {ONE}"), (2, f"one two {OTHER}"), (3, f"one two {ONE}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in dedup_near.near_groups(docs, shingle_words=3, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    item = " ".join(f"w{i} {ONE}" for i in range(8))
    rows = spark.createDataFrame([(1, item), (2, item.replace(ONE, OTHER))], "doc_id long, text string")
    found = decontam.contaminated(rows, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1}


def test_null_and_repeated_ids_are_dealt_to_many_tasks(spark):
    texts = [f"text {i} of many words here" for i in range(8000)]
    docs = spark.createDataFrame([(None if i % 2 else (i if i % 4 else 5), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = tokens.write_shards(docs, tokenizer_path(), shard_ids=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_task = [r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(by_task) == 4 and max(by_task) < 1.6 * min(by_task)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    crc = {t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in texts}
    got = tokens.read_shards(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert sorted(r.ids_crc32 for r in got) == sorted(crc.values())


def test_fits_are_bounded_where_one_id_repeats(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(1, text("abcde"), "aa") for _ in range(3000)] + [(1, "the very same row", "aa")] * 3000 + [(i, text("vwxyz"), "zz") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)], "doc_id long, toxic int")
    sizes = []
    write = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: sizes.append((t := write(df, name)).count()) or t)
    toxicity.fit(docs, labels, rows=300)
    assert sizes and 0 < sizes[0] < 450
    model = langid.fit(docs)
    judged = {r.doc_id: r.lang_pred for r in langid.identify(docs.filter("doc_id in (2, 3, 5)"), model).collect()}
    assert set(judged.values()) == {"zz"}


def test_keys_do_not_move_with_splits(spark, tmp_path):
    spark.createDataFrame([(None if i % 3 else i, f"t{i}") for i in range(4000)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    held = {name: spark.conf.get(name) for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(name, None)}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        keyed = shared.keyed(spark.read.parquet(str(tmp_path / "d")))
        first = {(r.text, r.key) for r in keyed.collect()}
        spark.conf.set("spark.sql.files.minPartitionNum", "40")
        again = {(r.text, r.key) for r in keyed.select("*").repartition(3).collect()}
    finally:
        for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.set(name, held[name]) if name in held else spark.conf.unset(name)
    assert first == again and len({k for _, k in first}) == 4000


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_equals_the_operator(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    theirs = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in theirs.description)
    places = [[c[0] for c in theirs.description].index(c) for c in columns]
    ours = queries.queries()[name](spark, sf_dir)
    assert sorted(ours.columns) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([plain(v) for v in r]) for r in ours.select(columns).collect()) == sorted(str([plain(r[p]) for p in places]) for r in theirs.fetchall())
