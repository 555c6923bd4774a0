import random

from stepforge.operators import retrieval, runs


def test_slices_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, i * 2, i * 3, i * 5) for i in range(20)], "id int, at int, part int, shift int").repartition(3)
    got = runs.sliced(rows, ["id"], 5, 8).orderBy("id").collect()
    assert [tuple(r)[:4] for r in got] == [(i, 2 * i, 3 * i, 5 * i) for i in (5, 6, 7)] and [r.place for r in got] == [5, 6, 7]


def test_vectors_of_unlike_lengths_are_not_near(spark):
    rows = [(1, 0, 0, [1.0, 2.0]), (2, 0, 0, [1.0, 2.5]), (3, 0, 0, [1.0, 2.0, 3.0]), (4, 0, 0, None), (5, 0, 0, []), (6, 0, 0, [9.0, 2.0, 3.0])]
    memory = spark.createDataFrame(rows, "vec_id long, task long, variation long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.vector_topk(memory, memory, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 3), (3, 2, 6), (6, 1, 6), (6, 2, 3)]
    assert retrieval.vector_topk(memory.limit(0), memory, 2).count() == 0 == retrieval.vector_topk(memory, memory.limit(0), 2).count()


def test_items_are_found_by_their_rarest_words(spark):
    rng = random.Random(3)
    common = ["a b c d e"] * 3
    items = [(1, "a b c d e f g"), (2, "A  b"), (3, ""), (4, "z z z z z z"), (5, "b"), (6, "c d e f g a b c d e x"), (7, None)]
    docs = [(i, " ".join([rng.choice(common), *(rng.choice("abcdefgxz") for _ in range(rng.randrange(60)))])) for i in range(150)] + [(500, "q a b c d e f g\nA b"), (501, None), (502, "b"), (503, "z z z z z z z"), (504, "c d e f g a b c d e x")]
    want = set()
    for d, text in docs:
        own = f" {' '.join((text or '').lower().split())} "
        want |= {(d, i) for i, item in items if (item or "").split() and f" {' '.join(item.lower().split())} " in own}
    got = runs.containing(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
