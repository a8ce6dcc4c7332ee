import random
from collections import Counter

from test_simhash import classes

from tallymill.llm.simhash import keep_one, row_key, shingle_set, similar_links, sketch


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_keep_one_links_what_brute_force_links_at_0_8(spark):
    rng = random.Random(4)
    rows, near = [], 0
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 40, 150, 400]))]
        rows.append(" ".join(base))
        for _ in range(4):
            w = base[:]
            for k in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.005, 0.015, 0.022, 0.03, 0.05])))):
                w[k] = f"x{rng.randrange(10**6)}"
            w = w[rng.randrange(2) :]
            near += 0.8 <= jaccard(rows[-1], " ".join(w)) < 0.85
            rows.append(" ".join(w))
    hot = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows += [" ".join([*hot[:k], "other", *hot[k + 1 :]]) for k in range(60)]
    assert near > 10
    label = classes(range(len(rows)), lambda a, b: jaccard(rows[a], rows[b]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in keep_one(df).collect()) == sorted(set(label.values()))


def test_links_of_large_keys_are_the_same(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(50):
        base[rng.randrange(60)] = f"y{i}"
        rows.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    label = classes(range(len(rows)), lambda a, b: jaccard(rows[a], rows[b]) >= 0.8)
    names = [r[0] for r in df.orderBy("doc_id").select(row_key(df)).collect()]
    made = [sketch(t, 5, 3) for t in rows]
    node = {name: i for i, (name, _, _, _) in enumerate(made)}
    texts = spark.createDataFrame([(bytearray(name), row, size, fp, keys) for row, (name, size, fp, keys) in zip(names, made)], "node binary, row string, size long, fp long, keys array<long>")
    for shard in (4096, 7, 3):
        links = {(node[bytes(r.u)], node[bytes(r.v)]) for r in similar_links(texts, df, 5, 0.8, shard=shard).collect()}
        assert all(jaccard(rows[a], rows[b]) >= 0.8 for a, b in links)
        assert classes(range(len(rows)), lambda a, b: (a, b) in links) == label


def test_a_chain_of_copies_over_many_shards_is_one_group(spark):
    """Only neighbours in the chain are similar, so no shard joins them alone."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(40):
        base[2 * i] = f"z{i}"
        rows.append(" ".join(base))
    rows += [" ".join(f"o{rng.randrange(10**6)}" for _ in range(40)) for _ in range(10)]
    label = classes(range(len(rows)), lambda a, b: jaccard(rows[a], rows[b]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for shard in (2048, 4):
        assert sorted(r.doc_id for r in keep_one(df, shard=shard).collect()) == sorted(set(label.values()))


def test_a_very_long_text_and_clashing_names(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    near = [*long[:50_000], "other", *long[50_001:]]
    df = spark.createDataFrame([(2, " ".join(long), 1, "a"), (1, " ".join(near), 2, "b"), (3, "short", 3, "c"), (4, None, 4, "d"), (5, "", 5, "e")], "doc_id long, text string, __row long, __stays string")
    got = keep_one(df)
    assert got.columns == df.columns and sorted((r.doc_id, r["__row"]) for r in got.collect()) == [(1, 2), (3, 3), (4, 4)]


def test_recall_on_the_given_documents(spark):
    """Of the pairs of 0.8 and more of a fixed query set (ids divisible by 20) against all documents, at least 0.9 are joined."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    shingles = {r.doc_id: set(shingle_set(r.text, 5).tolist()) for r in docs.collect()}
    holders = {}
    for j, b in shingles.items():
        for x in b:
            holders.setdefault(x, []).append(j)
    near = set()
    for i in (i for i in shingles if i % 20 == 0):
        both = Counter(j for x in shingles[i] for j in holders[x])
        near |= {(min(i, j), max(i, j)) for j, n in both.items() if i != j and n / (len(shingles[i]) + len(shingles[j]) - n) >= 0.8}
    kept = {r.doc_id for r in keep_one(docs).select("doc_id").collect()}
    assert len(near) > 20 and sum(j in kept for _, j in near) <= 0.1 * len(near)
