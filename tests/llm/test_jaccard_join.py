import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_simhash import classes

from tallymill.llm import jaccard_join as jj
from tallymill.llm.jaccard_join import shingle_set

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def plain(rows):
    """By position, as ids may repeat or be null."""
    sized = [len(shingles(t)) for _, t in rows]
    label = classes(range(len(rows)), lambda a, b: sized[a] > 0 and sized[b] > 0 and jaccard(rows[a][1], rows[b][1]) >= 0.8)
    members = {}
    for k in range(len(rows)):
        members.setdefault(label[k], []).append(k)
    least = {c: min((rows[k][0] for k in m if rows[k][0] is not None), default=None) for c, m in members.items()}
    return sorted(((rows[k][0], sized[k], least[label[k]]) for k in range(len(rows))), key=str)


def found(spark, rows, schema=SCHEMA, **settings):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.joined(df, **settings).collect()), key=str)


def texts(seed):
    rng = random.Random(seed)
    new = lambda: f"W{rng.randrange(10**6)}"
    passage = [new() for _ in range(60)]
    out = []
    for _ in range(30):
        base = [new() for _ in range(rng.choice([3, 5, 9, 24, 40, 150, 400]))]
        if rng.random() < 0.4:
            base[rng.randrange(len(base)) :] = passage
        out.append(" ".join(base))
        for _ in range(4):
            w = base[:]
            for k in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.005, 0.015, 0.022, 0.03, 0.05])))):
                w[k : k + 1] = rng.choice([[], [new()], [w[k], new()], [w[k].lower()]])
            out.append(" ".join(w[rng.randrange(2) :]))
    hot = [new() for _ in range(200)]
    for k in range(50):
        hot[rng.randrange(200)] = new()
        out.append(" ".join(hot))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("shard", [2048, 7])
def test_components_are_those_of_brute_force(spark, shard):
    rows = texts(1)
    assert found(spark, rows, shard=shard) == plain(rows)
    close = [jaccard(a[1], b[1]) for a in rows for b in rows if a[0] < b[0]]
    assert sum(0.78 < x < 0.8 for x in close) > 5 and sum(0.8 <= x < 0.82 for x in close) > 5


def test_sets_at_the_very_threshold(spark):
    """12 words and 8 shingles, of which one more each side gives 8 of 10."""
    w = [f"a{i}" for i in range(12)]
    rows = [(0, " ".join(["x", *w])), (1, " ".join([*w, "y"])), (2, " ".join(["x", *w, "y", "z"])), (3, "just Four words here"), (4, "just four words HERE"), (5, "just four words")]
    assert jaccard(rows[0][1], rows[1][1]) == 0.8
    assert found(spark, rows) == plain(rows)


def test_one_passage_in_every_text_joins_nothing(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, passage + " " + " ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.choice([5, 20, 28, 60])))) for i in range(60)]
    assert found(spark, rows, shard=8) == plain(rows)


def test_odd_inputs(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(9, None), (8, ""), (7, " \n\t"), (None, None), (None, "one two"), (5, "one two"), (5, "one two"), (6, long), (4, long + " end"), (3, "É a b c d e"), (2, "é a b c d e"), (None, "alone here")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    clash = [(*r, "k", 1, b"", b"") for r in rows]
    assert found(spark, clash, SCHEMA + ", key string, size int, node binary, label binary") == plain(rows)


def test_parity_never_shows_more_than_the_difference():
    rng = np.random.default_rng(5)
    for n in (3, 64, 100, 500, 1500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        x, y = (np.frombuffer(jj.parity(h), np.uint64) for h in (a, b))
        while len(x) > len(y):
            x = jj.folded(x)
        while len(y) > len(x):
            y = jj.folded(y)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_each_order_has_a_common_prefix_shingle():
    level = np.random.default_rng(6).integers(0, 9, jj.CELLS).astype(np.uint8)
    rng = random.Random(7)
    for _ in range(50):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 300))]
        v = w[:]
        v[rng.randrange(len(v))] = "other"
        a, b = shingle_set(" ".join(w), 5), shingle_set(" ".join(v), 5)
        if jaccard(" ".join(w), " ".join(v)) >= 0.8:
            for k in range(jj.ORDERS):
                x, y = (set(jj.ordered(h, level, k)[: jj.prefix_size(len(h), 80)].tolist()) for h in (a, b))
                assert x & y


def edited(rng, words, n, k):
    """n copies of a text, in each of which k words are others."""
    for _ in range(n):
        w = words[:]
        for at in rng.sample(range(len(w)), k):
            w[at] = f"e{rng.randrange(10**9)}"
        yield " ".join(w)


def test_odd_codes_never_show_more_than_the_difference():
    rng = np.random.default_rng(8)
    for n in (1, 64, 500, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
        x, y = (np.frombuffer(jj.odd_codes(h), np.uint16) for h in (a, b))
        apart = len(np.setxor1d(a, b))
        assert 0.8 * apart <= len(np.setxor1d(x, y)) <= apart


def test_a_crowd_a_little_under_the_threshold_makes_few_pairs():
    """Texts of a large group that are not similar to each other, but near it: their pairs are turned away where they meet."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    sets = [shingle_set(t, 5) for t in edited(rng, base, 150, 1)] + [shingle_set(t, 5) for t in edited(rng, base, 150, 2)]
    rows = [(False, jj.set_name(h), jj.set_name(h), len(h), jj.parity(h), jj.odd_codes(h)) for h in sets]
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    wanted = {(rows[j][1], rows[k][1]) for k in range(len(sets)) for j in range(k) if share(sets[j], sets[k]) >= 0.8}
    possible = set(jj._bucket_pairs([(*r[:5], None) for r in rows], 80, True, False))
    got = set(jj._bucket_pairs(rows, 80, True, False))
    assert wanted <= got <= possible and len(got) < 1.1 * len(wanted) + 50 and len(possible) > len(got) + 1000


def test_components_of_a_crowd_are_those_of_brute_force(spark, monkeypatch):
    """Groups of more than FINE nodes, with sets that have codes and larger ones that have none."""
    rng = random.Random(10)
    group = [f"g{i}" for i in range(90)]
    rows = [*enumerate(t for k in (1, 2, 3) for t in edited(rng, group, 60, k))]
    assert len(rows) > jj.FINE
    for coded in (jj.CODED, 84):
        monkeypatch.setattr(jj, "CODED", coded)
        assert found(spark, rows) == plain(rows)


def test_a_shingle_of_some_tens_of_texts_comes_after_rarer_ones(spark):
    """Cells have a load of 28 by chance; one whose shingle has 30 texts more must stand out, or each such crowd is compared."""
    loads = np.random.default_rng(11).poisson(28, jj.CELLS)
    loads[77] = 28 + 30
    level = jj.levels(spark.createDataFrame([(k, zstandard.compress(b.tobytes())) for k, b in enumerate(loads.reshape(64, -1))], "block int, loads binary"))
    assert level[77] > np.median(level) and (level == level.min()).mean() > 0.99


def test_nodes_of_a_size_that_no_other_has_are_not_compared(spark):
    met = spark.createDataFrame([(1, 4, 0, 100), (1, 4, 1, 80), (1, 4, 2, 63), (1, 4, 3, 126), (2, 2, 4, 50), (2, 2, 5, 50), (3, 2, 6, 8), (3, 2, 7, 10)], "key long, n long, node long, size long")
    label = spark.createDataFrame([(4, 5)], "node long, label long")
    assert sorted((r.key, r.node) for r in jj._own(met, label, 80).collect()) == [(1, 0), (1, 1), (3, 6), (3, 7)]


def test_shingles_with_the_same_nodes_count_once(spark):
    each = spark.createDataFrame([(s, m, h) for s in range(40) for m in range(s % 4) for h in (False,)] + [(-s, m, True) for s in range(1, 9) for m in (7, 8, 7)], "shingle long, mark long, head boolean")
    nodes = spark.createDataFrame([(m, m + 100, 10) for m in range(9)], "mark long, node long, size long")
    got = sorted((r.head, r.n, r.node, r.size) for r in jj._met(each, nodes).collect())
    assert got == sorted([(False, 2, 100, 10), (False, 2, 101, 10), *((False, 3, k, 10) for k in (100, 101, 102)), (True, 2, 107, 10), (True, 2, 108, 10)])


def test_texts_are_fetched_for_the_wanted_rows_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(5, "text 5")] * 3, SCHEMA)
    row = jj.row_key(docs)
    wanted = docs.where("doc_id % 100 = 5").select(row.alias("row"), F.col("doc_id").alias("node")).distinct()
    wanted = wanted.unionByName(wanted.where("node = 105").withColumn("node", F.lit(-1).cast("long")))
    got = jj.fetched(docs, wanted)
    assert sorted((r.node, r.text) for r in got.collect()) == sorted([(-1, "text 105"), *((i, f"text {i}") for i in range(5, 3000, 100))])
    assert "getbit" in got._jdf.queryExecution().optimizedPlan().toString()
