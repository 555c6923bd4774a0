import hashlib
import random
import zlib

import duckdb
import pytest

from stepforge.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AZ = {i: i + 32 for i in range(65, 91)}


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    parts = [row[0], row[3], row[2], row[4], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        a = i - i % 16
        yield "".join(level[a:i]), "".join(level[i + 1 : a + 16])
        i //= 16


def brute(rows):
    sources = {}
    for r in rows:
        text = r[1] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 else r[1] and r[1].translate(AZ)
        sources.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, text)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in sources[s]])
    top = levels([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for place, s in enumerate(names):
        for i, (doc_id, own, changed) in enumerate(sources[s]):
            path = [*siblings(trees[s], i), *siblings(top, place)]
            folded = changed
            for left, right in path:
                folded = h(left + folded + right)
            out.append((doc_id, own, trees[s][-1][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def rows_of(rng, n, sources, ids):
    return [(ids(i), rng.choice([None, "", "aB c", "ÀÉx Y", "q" * rng.randrange(9)]) if rng.random() < 0.5 else f"Text {i}", rng.choice(["en", None]), sources(i), rng.choice([None, i])) for i in range(n)]


CASES = {
    "several_levels": lambda rng: rows_of(rng, 700, lambda i: "big" if i % 7 else f"s{i % 40}", lambda i: 3 * i + 1),
    "many_sources": lambda rng: rows_of(rng, 330, lambda i: None if i == 5 else f"é{i}" if i < 300 else "Z", lambda i: i),
    "sparse_and_negative_ids": lambda rng: rows_of(rng, 300, lambda i: "ab"[i % 2], lambda i: rng.randrange(-(2**63), 2**63)),
    "one_row": lambda rng: rows_of(rng, 1, lambda i: None, lambda i: 5),
    "repeats_and_nulls": lambda rng: rows_of(rng, 400, lambda i: ("x", None, "y")[i % 3], lambda i: None if i % 4 == 0 else rng.randrange(90)),
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_equals_a_plain_one(spark, case):
    rows = CASES[case](random.Random(case))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS name", "2 AS word", "3 AS idx", "'z' AS leaf", "4 AS row")
    assert found(manifest.manifest(docs)) == brute(rows)


def test_equal_rows_and_an_empty_table(spark):
    rows = [(7, "Same", "en", "a", 4)] * 40 + [(None, None, None, None, None)] * 20 + [(8, "b", "en", "a", 1)]
    got = [str(tuple(r)) for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(got) == brute(rows)
    none = manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_directory_counts_without_sorting_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "FAN_BITS", 2)
    rng = random.Random(2)
    ids = sorted(rng.sample(range(-4000, 90000), 900))
    leaves = manifest._leaves(spark.createDataFrame([(i, "t", "en", "s", 1) for i in ids], SCHEMA).repartition(4))
    got = {r.doc_id: r.idx for r in manifest.placed(manifest.written(leaves, "t")).collect()}
    assert got == {i: n for n, i in enumerate(ids)}


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    theirs = con.execute(manifest.ORACLE_SQL).fetchall()
    assert found(manifest.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == sorted(map(str, theirs))
