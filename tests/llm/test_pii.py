import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepforge.llm import pii
from stepforge.operators import boosting

#: The patterns as the contract states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            checked = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and checked % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def card(rng, size=16):
    head = [rng.choice("45")] + [rng.choice("0123456789") for _ in range(size - 2)]
    return next("".join(head) + d for d in "0123456789" if pii.luhn("".join(head) + d))


MADE = {
    "email": lambda rng: f"{rng.choice(['ann', 'bo.b', 'k_9'])}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.{rng.choice(['com', 'org'])}",
    "ip": lambda rng: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
    "card": lambda rng: rng.choice([lambda c: c, lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4))])(card(rng)),
    "phone": lambda rng: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
}
NOISE = [lambda r: str(r.randrange(10 ** r.randrange(1, 19))), lambda r: f"{r.randrange(9)}.{r.randrange(9)}", lambda r: "-".join(str(r.randrange(99)) for _ in range(7)), lambda r: "".join(r.choice("0123456789abcdef") for _ in range(30)), lambda r: "x@y", lambda r: f"{r.randrange(400)}.{r.randrange(900)}.{r.randrange(999)}.{r.randrange(99)}", lambda r: "+" + str(r.randrange(10**6))]


def document(rng, n=40):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    parts = [rng.choice(NOISE)(rng) if rng.random() < 0.15 else MADE[rng.choice(list(MADE))](rng) if rng.random() < 0.08 else word() for _ in range(n)]
    # Things of our own are kept apart by words; noise is not.
    return " ".join(p if p.isalpha() else f"{p} {word()}" for p in parts)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    mixed = ["".join(rng.choice("aZ9012.@-+_% ()\n½é") for _ in range(rng.randrange(60))) for _ in range(6000)]
    odd = ["", "a@b@c.d", "x@y.z_q@r.s", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0001.2.3.4", "1..2.3.4.5", "+12", "+1 2", "a@b.", "@a.b", "9" * 6000, "1." * 3 + "9" * 4000, "٣.1.2.3.4"]
    for text in [*mixed, *odd, *(document(rng) for _ in range(300))]:
        assert [f"{k}:{a}:{b}" for a, k, b in pii.base_spans(text)] == plain(text), text


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1 2-" * 100_000, "a@" * 100_000, "1.2." * 100_000, "+1" * 100_000, "4111 " * 60_000, "(" * 300_000 + "@"])
def test_long_texts_take_time_in_proportion(text):
    began = time.process_time()
    pii.base_spans(text)
    list(pii.candidates(text))
    assert time.process_time() - began < 20


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, document(rng)) for i in range(3000)], "doc_id long, text string").repartition(4)
    return docs, pii.fit(docs)


def test_spans_beside_others_are_found_and_clean_texts_left_alone(spark, fitted):
    docs, model = fitted
    assert set(model.trees) == set(pii.KINDS)
    rng = random.Random(12)
    # The patterns swallow what stands beside these and then drop all of it.
    pairs = [(MADE["phone"](rng), card(rng)) for _ in range(200)]
    texts = [f"word {a} {b} word" for a, b in pairs]
    found = model.spans(texts)
    right = sum(("phone", 5, 5 + len(a)) in [s[:3] for s in own] and ("card", 6 + len(a), 6 + len(a) + len(b)) in [s[:3] for s in own] for (a, b), own in zip(pairs, found))
    assert all(not plain(t) for t in texts) and right >= 180
    clean = [" ".join(rng.choice([str(rng.randrange(10**7)), "4.0", f"v{rng.randrange(9)}.{rng.randrange(40)}.1", NOISE[3](rng), "x@y", "2024-05-17", "12:30", "300.1.2.900", "(1)", "3 / 4"]) if rng.random() < 0.3 else "some words" for _ in range(30)) for _ in range(300)]
    clean = [t for t in clean if not plain(t)]
    added = [[t[a:b] for _, a, b, _, _ in own] for t, own in zip(clean, model.spans(clean))]
    assert sum(map(bool, added)) <= 0.03 * len(clean), added


def test_rows_and_digests(spark, fitted):
    _, model = fitted
    rng = random.Random(1)
    rows = [(i, document(rng)) for i in range(60)] + [(None, "call +1 (499) 555-6503 now"), (3, None), (3, ""), (4, "é" * 50 + " a.1@b.co"), (5, "x 10.0.0.1\n" * 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS spans", "2 AS kind").repartition(3)
    found = pii.find(docs, model)
    got = sorted(map(str, pii.digests(found).drop("spans").collect()))
    want = [(i, *[sum(s.startswith(k) for s in plain(t)) for k in pii.KINDS], hashlib.sha256(",".join(plain(t)).encode()).hexdigest()) for i, t in rows]
    names = ["doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256"]
    from pyspark.sql import Row

    assert got == sorted(str(Row(**dict(zip(names, w)))) for w in want)
    for r in pii.digests(found).collect():
        assert r.base_sha256 != hashlib.sha256(b"").hexdigest() or sum(r[f"n_{k}"] for k in pii.KINDS) == 0
    one = spark.createDataFrame([(1, "x 10.0.0.1\n" * 2 + "é a@b.co, +1 (499) 555-6503"), (2, "+4539 578763621486"), (3, None)], "doc_id long, text string")
    masked = one.join(pii.find(one, pii.Model()), "doc_id").orderBy("doc_id").select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r.t for r in masked] == ["x [IP]\nx [IP]\né [EMAIL], [PHONE]", "+[CARD]", None]
    assert pii.find(docs.limit(0), model).count() == 0


def test_fit_of_nothing_keeps_base_spans(spark):
    model = pii.fit(spark.createDataFrame([(1, None), (2, "no data")], "doc_id long, text string"))
    assert model.trees == {} and [s[:3] for s in model.spans(["at 1.2.3.4"])[0]] == [("ip", 3, 10)]


def test_thresholds_keep_precision():
    rng = np.random.default_rng(4)
    score = np.round(rng.random(4000), 3)
    label = (rng.random(4000) < score**0.2).astype(float)
    t = pii._threshold(score, label, np.ones(4000), 0.9)
    assert label[score >= t].mean() >= 0.9 and t < 0.9


def test_few_examples_among_very_many_candidates_are_learned(spark):
    """120 addresses among over 100,000 other candidates: all of them count, not those of a sample."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(4))
    number = lambda: "-".join(str(rng.randrange(10**a, 10 ** (a + 1))) for a in (rng.randrange(1, 6) for _ in range(3)))
    texts = [" ".join(f"{word()} {number()}" for _ in range(400)) for _ in range(200)]
    texts += [f"{word()} {MADE['email'](rng)} {word()}" for _ in range(120)]
    assert len({(c[0], c[4], tuple(c[5])) for t in texts for c in pii.candidates(t)}) > 100_000
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert "email" in model.trees and len(model.shapes["email"]) == len({c[4] for t in texts for c in pii.candidates(t) if c[0] == "email" and (c[1], "email", c[2]) in pii.base_spans(t)})


def test_thresholds_come_from_all_rows_out_of_fold(spark):
    rng = np.random.default_rng(9)
    edges = {"card": [[float(x) for x in range(8)]] * 3, "phone": [[float(x) for x in range(8)]] * 2}
    rows = []
    for kind, own in edges.items():
        for _ in range(3000):
            bins = rng.integers(0, 9, len(own), dtype=np.uint8)
            rows.append((kind, int(rng.integers(pii.FOLDS)), int(rng.random() < (0.995 if bins.sum() > 9 else 0.1)), float(rng.integers(1, 5)), bins.tobytes()))
    df = spark.createDataFrame(rows, "kind string, fold int, label int, weight double, bins binary").repartition(5)
    models = boosting.classifiers(df, edges, pii.FOLDS, trees=6)
    got = pii._thresholds(df, models)
    for kind in edges:
        own = [r for r in rows if r[0] == kind]
        score = np.array([round(float(1 / (1 + np.exp(-models[kind, r[1]].score(np.frombuffer(r[4], np.uint8)[None])[0]))), 9) for r in own])
        assert got.get(kind) == pii._threshold(score, np.array([r[2] for r in own]), np.array([r[3] for r in own]))
    assert got
