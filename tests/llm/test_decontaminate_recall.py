import random

from tallymill.llm.decontaminate import SHARE, overlap, overlaps, run_length, words_of


def found(spark, docs, items):
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_a_later_region_of_an_alignment_counts(spark):
    item = [f"w{k}" for k in range(58)]
    doc = item[:12] + [f"x{k}" for k in range(6)] + item[18:]
    assert found(spark, [(1, " ".join(doc))], [(2, " ".join(item))]) == {(1, 2)}


def test_replaced_words_of_short_items_and_exact_tiny_ones(spark):
    rng = random.Random(6)
    items, docs, want = [], [], set()
    for i, n in enumerate(list(range(1, 25)) * 6):
        item = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(item)))
        part = item[:]
        most = int(n * (1 - SHARE) + 1e-9) if n >= 6 else 0
        for k in [0] if most and i < 24 else rng.sample(range(n), most):
            part[k] = "other"
        docs.append((i, " ".join(["a", "b", *part, "c", "d"])))
        # what extensions reach from any place, seed or not
        if any(overlap(words_of(docs[-1][1]), words_of(items[-1][1]), 2, k) for k in range(n)):
            want.add((i, i))
    got = found(spark, docs, items)
    assert got == want and len(want) > 100
    assert {(i, i) for i in range(24)} <= want
    assert found(spark, [(1, "i1w0 x i1w1")], [(1, "i1w0 i1w1")]) == set()


def test_run_lengths():
    assert [run_length(n) for n in (1, 4, 5, 6, 8, 12, 15, 16, 17, 60, 400)] == [1, 4, 5, 3, 4, 4, 3, 4, 4, 4, 4]
