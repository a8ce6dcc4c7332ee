import random

from tallymill.llm.decontaminate import LEAST, MASKS, MATCHES, SHARE, overlap, overlaps, seeds, without_leaks, words_of


def test_masks_and_seeds():
    assert len({*MASKS}) == len(MASKS) and len({len(m) for m in MASKS}) == 1 and all(m.count("1") == 8 for m in MASKS)
    a = words_of("The quick, brown FOX jumps over the lazy dog while it rains")
    for mask in MASKS:
        k = mask.index("0")
        b = a[:k] + [b"other"] + a[k + 1 :]
        assert set(seeds(a, [12])[0]) & set(seeds(b, [12])[0])
    assert len(seeds(a, [12])[0]) == len(MASKS) and len(seeds(a[:11], [12])[0]) == 0


def corpus():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 6, 8, 11, 12, 13, 30, 60, 400])))) for i in range(60)]
    docs, leaks = [], set()
    for d in range(300):
        w = [word() for _ in range(rng.randrange(0, 300))]
        if d % 3 == 0:
            i, t = rng.choice(items)
            p = t.split()
            if d % 2 == 0 and len(p) >= 30:
                for k in range(7, len(p), 11):
                    p[k] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
            if len(p) >= LEAST:
                leaks.add((d, i))
        docs.append((d, " ".join(w).title() if d % 5 else ", ".join(w)))
    return docs, items, leaks


def brute(docs, items):
    """Every alignment of every pair, each place of it as a seed."""
    out = set()
    for d, t in docs:
        doc = words_of(t)
        where = {}
        for k, w in enumerate(doc):
            where.setdefault(w, []).append(k)
        for i, u in items:
            item = words_of(u)
            if len(item) < LEAST:
                continue
            shifts = [at - k for k, w in enumerate(item) for at in where.get(w, ())]
            for s in {x for x in shifts if shifts.count(x) >= min(MATCHES, SHARE * len(item))}:
                if any(overlap(doc, item, s, k) for k in range(max(0, -s), min(len(item), len(doc) - s))):
                    out.add((d, i))
    return out


def test_finds_all_that_brute_force_finds(spark):
    docs, items, leaks = corpus()
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(pairs) == len(got)
    want = brute(docs, items)
    assert pairs <= want
    assert pairs >= leaks
    assert len(want - pairs) <= 0.02 * len(want)
    assert all(r.n_equal <= r.n_words for r in got)


def test_odd_rows(spark):
    text = " ".join(f"q{k}" for k in range(20))
    docs = [(1, "a b " + text, "x"), (1, "a b " + text, "x"), (2, None, None), (3, "", "y"), (None, text, "z"), (4, "clean words only", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, text, "d"), (7, text, "d"), (8, None, "d"), (None, text, "d"), (9, "too short", "d")], "item_id long, text string, doc_id string")
    assert sorted(map(tuple, overlaps(df, bench).collect()), key=str) == [(1, 7, 2, 20, 20), (None, 7, 0, 20, 20)]
    left = without_leaks(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert overlaps(df.limit(0), bench).count() == 0 == overlaps(df, bench.limit(0)).count()
