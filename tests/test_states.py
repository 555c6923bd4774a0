import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stepforge.functions import similarity
from stepforge.operators import text_clusters


def blocks(a, b):
    """Characters in matching blocks, by the definition, for short strings."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n and n + blocks(a[:i], b[:j]) + blocks(a[i + n :], b[j + n :])


def test_matching_ratio_equals_its_definition(spark):
    rng = random.Random(2)
    words = ["tide", "diet", "", "é", *("".join(rng.choice("abc é") for _ in range(rng.randrange(25))) for _ in range(45))]
    pairs = [(a, b) for a in words for b in words] + [(None, "a"), ("[12] a", "[7] a")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    strip = lambda s: s if s is None or "[" not in s else s.split("]")[1]
    for r in df.select("a", "b", similarity.state_similarity(F.col("a"), F.col("b")).alias("r")).collect():
        a, b = strip(r.a) or "", strip(r.b) or ""
        assert r.r == (2 * blocks(a, b) / (len(a) + len(b)) if a or b else 1.0)
    assert similarity.matching_ratio("tide", "diet") == 0.25
    long = ["".join(rng.choice("ab cdefgh") for _ in range(400)) for _ in range(4)]
    for a in long:
        for b in [*long, a[:200] + "x" + a[201:]]:
            assert similarity.matching_ratio(a, b) == SequenceMatcher(None, a, b).ratio() or a == b


def test_state_match(spark):
    page = "[1] RootWebArea 'Shop' [22] link 'Home' [3] button 'Add to cart' " * 2
    other = page.replace("[1]", "[991]").replace("[22]", "[4]")
    near = other.replace("cart", "card", 1)
    rows = [(page, other, "u", "", True), (page, near, "", "", True), (page, "x", "http://a/b#1", "http://a/b#1", True), (page, "x", "http://a/b", "http://a/b#1", False), (page, "x", "", "", False), (None, "", None, None, True), (page, page[:60], "u", None, False)]
    df = spark.createDataFrame(rows, "o string, t string, u string, v string, want boolean")
    got = df.select("want", similarity.state_match(F.col("o"), F.col("t"), F.col("u"), F.col("v")).alias("m")).collect()
    assert [r.m for r in got] == [r.want for r in got]


def lcs(a, b):
    return similarity.common_subsequence(a, b)


def greedy(texts, threshold):
    out = {}
    ids = sorted(texts)
    for i in ids:
        if i not in out:
            out[i] = i
            for j in ids:
                a, b = texts[i], texts[j]
                if j > i and j not in out and (a == b or 2 * lcs(a, b) >= threshold * (len(a) + len(b))):
                    out[j] = i
    return out


@pytest.mark.parametrize("threshold", [0.99, 0.93])
def test_text_leaders_equal_the_greedy_loop(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = ["".join(rng.choice("abcdefg hi") for _ in range(rng.choice([3, 12, 60, 150, 320]))) for _ in range(14)]
    texts = {}
    for i in range(170):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "z", "é"])
        texts[i * 3] = "".join(text)
    texts |= {900: "", 901: "", 902: "a", 903: "😀" * 70, 904: "😀" * 69 + "x"}
    df = spark.createDataFrame([*texts.items(), (None, "x"), (1000, None), (3, texts[3])], "id long, text string").repartition(5)
    got = {r.id: r.leader for r in text_clusters.text_leaders(df, threshold).collect()}
    want = greedy(texts, threshold)
    assert got == want and 20 < len(set(want.values())) < len(want)


def test_a_chain_and_odd_tables(spark):
    """Each text is like the next alone, so every second one leads."""
    start = "the quick brown fox jumps over the lazy dog and runs away " * 2
    chain = {i: "x" * i + start + "y" * (12 - i) for i in range(13)}
    df = spark.createDataFrame(list(chain.items()), "id long, text string")
    assert {r.id: r.leader for r in text_clusters.text_leaders(df, 0.99).collect()} == greedy(chain, 0.99)
    assert text_clusters.text_leaders(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        text_clusters.text_leaders(df, 0.5)


def _crowd(kind):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(330))
    if kind == "unlike":  # all but ten characters are the same
        return [base[:150] + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) + base[150:] for _ in range(40)]
    if kind == "like":
        return [base[:at] + "#" + base[at + 1 :] for at in range(0, 330, 6)]
    return ["x" * i + base + "y" * (40 - i) for i in range(0, 40, 2)]


@pytest.mark.parametrize("kind", ["unlike", "like", "chain"])
def test_a_crowd_takes_few_rounds(spark, kind, monkeypatch):
    """Texts that share most sequences are settled many at once; of like ones no pairs are expanded."""
    tables, write = [], text_clusters.written
    monkeypatch.setattr(text_clusters, "written", lambda df, name: (tables.append(name), write(df, name))[1])
    texts = dict(enumerate(_crowd(kind)))
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    want = greedy(texts, 0.99)
    assert {r.id: r.leader for r in text_clusters.text_leaders(df, 0.99).collect()} == want
    assert len(set(want.values())) == {"unlike": 40, "like": 1, "chain": 10}[kind]
    assert tables.count("free") - 1 <= {"unlike": 5, "like": 1, "chain": 6}[kind]


def test_rarest_sequences_do_not_depend_on_the_texts_beside():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é😀") for _ in range(n)) for n in (60, 1, 400, 90, 0, 75)] + ["a" * 200]
    counts = np.arange(text_clusters.CELLS) % 97
    for threshold, q in ((0.99, 16), (0.95, 8), (0.9, 4)):
        assert text_clusters.gram(threshold) == q
        assert all(n + q - 1 > q * text_clusters.allowed(n, threshold) for n in range(5000))
        most = np.array([q * text_clusters.allowed(len(t), threshold) + 1 for t in texts])
        grams, owner = text_clusters._rarest(texts, q, most, counts)
        assert np.bincount(owner).tolist() == most.tolist()
        for i, text in enumerate(texts):
            own = text_clusters._rarest([text], q, most[i : i + 1], counts)[0]
            assert own.tolist() == grams[owner == i].tolist() and len(set(own.tolist())) == len(own)
    whole, held = text_clusters._hashes(["abcdabcd", "xabcdx"], 4)
    assert held.tolist() == [11, 9] and whole[3] == whole[7] == whole[11 + 4] and len(set(whole.tolist())) == 18


def test_queries(spark, sf_dir):
    queries = __spark_entry__.queries()
    texts = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    texts["id"] = texts.conv_id * 1000 + texts.turn
    got = {r.id: r.leader for r in queries["text_leaders"](spark, sf_dir).collect()}
    assert got == greedy(dict(zip(texts.id, texts.text)), 0.99)
    seen = {(r.conv_id, r.turn): (r.similarity, r.matched) for r in queries["state_matches"](spark, sf_dir).collect()}
    first = texts.sort_values(["turn"]).groupby("conv_id").text.first()
    for r in texts.head(60).itertuples():
        want = SequenceMatcher(None, r.text, first[r.conv_id]).ratio()
        assert abs(seen[r.conv_id, r.turn][0] - want) < 1e-6 or "[" in r.text
