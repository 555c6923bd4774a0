import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from stepforge.llm import phrases

AZ = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=phrases.LEAST, first=phrases.FIRST):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    around = collections.Counter()
    for p, a in found.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                around[(p[0], *p[i : i + m])] = max(around[(p[0], *p[i : i + m])], a)
    out = collections.defaultdict(list)
    for p, a in found.items():
        if 100 * around[p] < 80 * a:
            score, k, l, r = min((2000000 * a // (f[p[: j + 1]] + f[(p[0], *p[j + 1 :])]), j, f[p[: j + 1]], f[(p[0], *p[j + 1 :])]) for j in range(1, len(p) - 1))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i + 1, ph.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, ph, l, r) in enumerate(sorted(rows)[:first]))


def texts(rng, n, words):
    vocabulary = ["".join(rng.choice("aBé\x01ß") for _ in range(rng.randrange(1, 4))) for _ in range(words)]
    word = lambda: vocabulary[min(int(rng.expovariate(0.4)), words - 1)]
    join = lambda: rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"])
    return ["".join(word() + join() for _ in range(rng.randrange(60))) for _ in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_equal_plain_counts(spark):
    rng = random.Random(4)
    rows = [(t, rng.choice(["en", "de", "und", None])) for t in texts(rng, 900, 12)]
    rows += [(None, "en"), ("", "fr"), (" .,\t", None), ("New York new york " * 40, "en")] + [("same Same", "de")] * 35 + [("x. " * 9 + "long " * 5000, "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).selectExpr("*", "1 AS a", "'q' AS words", "2 AS range")
    want = brute(rows)
    assert len({r[0] for r in want}) > 3 and len(want) > 100
    assert got(phrases.collocations(docs)) == want
    assert got(phrases.collocations(docs, 5, 7)) == brute(rows, 5, 7)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_ranges_and_shards_do_not_change_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = phrases.RANGE_BYTES
    try:
        phrases.RANGE_BYTES = 20_000  # read by the driver alone
        assert len(phrases._bounds(docs.select("lang", "text"))) > 5
        some = got(phrases.collocations(docs.repartition(9)))
    finally:
        phrases.RANGE_BYTES = kept
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert some == sorted(con.execute(phrases.ORACLE_SQL).fetchall()) == brute([(r.text, r.lang) for r in docs.collect()])


def test_transducers_share_states_and_unite():
    rng = random.Random(1)
    counts = collections.Counter(tuple(rng.choice("abcd") for _ in range(3)) for _ in range(60))
    labels = pa.array([b"a", b"b", b"c", b"d", b"unused"], pa.large_binary())
    build = lambda c: phrases.Transducer.build(labels, np.array([["abcd".index(x) for x in p] for p in sorted(c)]), np.array([c[p] for p in sorted(c)]))
    spell = lambda t: {tuple(t.labels[i].as_py().decode() for i in p): w for p, w in zip(t.paths()[0].tolist(), t.paths()[1].tolist())}
    one = phrases.Transducer.read(bytes(build(counts)))
    assert spell(one) == counts and list(spell(one)) == sorted(counts)
    asked = [("a", "b", "c"), ("z", "a", "a"), ("d", "d", "d"), *sorted(counts)]
    assert one.weigh([pa.array([p[d].encode() for p in asked], pa.large_binary()) for d in range(3)]).tolist() == [counts[p] for p in asked]
    other = collections.Counter({("a", "a", "a"): 5, ("d", "e", "a"): 1})
    more = phrases.Transducer.build(pa.array([b"a", b"d", b"e"], pa.large_binary()), np.array([[0, 0, 0], [1, 2, 0]]), np.array([5, 1]))
    assert spell(phrases.Transducer.united([one, more], 2)) == {p: c for p, c in (counts + other).items() if c > 1}
    assert phrases.Transducer.united([more], 9) is None
    alike = build({(x, y, z): 7 for x in "abcd" for y in "abcd" for z in "ab"})
    assert [len(first) - 1 for first, _, _ in alike.levels] == [1, 1, 1] and len(alike.weights) == 2


def test_long_texts_are_cut_between_pieces(monkeypatch):
    rng = random.Random(8)
    texts_ = texts(rng, 40, 9)
    langs = pa.array([rng.choice(["a", "b"]) for _ in texts_])
    whole = phrases.Shard(langs, pa.array(texts_))
    monkeypatch.setattr(phrases, "SHARD", 30)
    cut = phrases.Shard(langs, pa.array(texts_))
    for k in range(1, 5):
        assert [x.tolist() for x in whole.counts(k, None)] == [x.tolist() for x in cut.counts(k, None)]
