"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pytest

from stepforge.llm import dedup_near, quality, warc


def shingled(text, k):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked_groups(texts, k, percent):
    """The least id reachable from each text, by all pairs."""
    sets = [shingled(t, k) for t in texts]
    code, rows = {}, np.zeros((len(texts), len(set().union(*sets))), np.float32)
    for i, s in enumerate(sets):
        rows[i, [code.setdefault(x, len(code)) for x in s]] = 1
    both, size = rows @ rows.T, rows.sum(axis=1)
    near = 100 * both >= percent * (size[:, None] + size[None] - both)
    label = np.arange(len(texts))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def crowd(kind, k):
    rng = random.Random(3)
    own = iter(f"w{i}" for i in range(10**6))
    take = lambda n: [next(own) for _ in range(n)]
    frame = take(180)
    if kind == "own words":
        # Texts of one frame are below the threshold; each pair also shares half of its own words.
        bodies = [take(34) for _ in range(460)]
        for _ in range(40):
            half = take(20)
            bodies += [half + take(14), half + take(14)]
        texts = [" ".join(frame + b) for b in bodies]
    else:
        # Only common shingles: each text lacks some of the frame's; a few lack nearly the same ones.
        slots = [take(2) for _ in range(60)]
        choices = [[rng.randrange(2) for _ in slots] for _ in range(330)]
        for c in rng.sample(choices, 25):
            d = list(c)
            for i in rng.sample(range(60), 11 if k == 1 else 4):
                d[i] = 1 - d[i]
            choices.append(d)
        texts = [" ".join(w for i, c in enumerate(chosen) for w in (frame[3 * i], frame[3 * i + 1], slots[i][c])) for chosen in choices]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("kind, k, percent", [("own words", 5, 80), ("common words", 1, 88), ("common words", 2, 75)])
def test_near_groups_finds_links_inside_a_crowd(spark, monkeypatch, kind, k, percent):
    monkeypatch.setattr(dedup_near, "COMMON", 64, raising=False)
    texts = crowd(kind, k)
    want = linked_groups(texts, k, percent)
    assert 20 <= len(texts) - len(set(want)) < len(texts) // 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in dedup_near.near_groups(docs, k, percent).collect()}
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("cell_texts", [1024, 40])
def test_near_groups_joins_a_crowd_that_only_a_few_texts_link(spark, monkeypatch, cell_texts):
    """Texts below the threshold of each other, each linked to the three with fewer changes alone."""
    monkeypatch.setattr(dedup_near, "COMMON", 64)
    monkeypatch.setattr(dedup_near, "CELL_TEXTS", cell_texts)
    rng = random.Random(5)
    texts = []
    for kind, changes in [("e", 10)] * 200 + [("h", 6)] * 3:
        words = [f"b{i}" for i in range(600)]
        for i in rng.sample(range(600), changes):
            words[i] = f"{kind}{len(texts)}x{i}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    want = linked_groups(texts, 3, 85)
    assert len(set(want.tolist())) < 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in dedup_near.near_groups(docs, 3, 85).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_quality_fit_sample_is_bounded_for_null_ids(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i, f"text number {i} has a few words of its own") for i in range(3000)]
    rows += [(None, "one text again and again")] * 1500
    seen = []
    learned = quality._learned
    monkeypatch.setattr(quality, "_learned", lambda y, *rest: seen.append(len(y)) or learned(y, *rest))
    assert quality.assess(spark.createDataFrame(rows, "doc_id long, text string"), rows=300).count() == len(rows)
    assert 100 < seen[0] < 400


def test_warc_decodes_hexadecimal_and_long_references(spark):
    html = "<p>a&#x27;b&#xE9;c&#X1F600;d&#0000039;e&#1114109;f&#x110000;g&#99999999999999999999;h&#xD800;i&#0;j&#x;k&#x00000000000000000041;l&#233;</p>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    text = warc.derive(warc.responses(pages)).filter("record_type = 'conversion'").first().block
    assert text == "a'béc😀d'e\U0010fffdf&#x110000;g&#99999999999999999999;h&#xD800;i&#0;j&#x;kAlé"
