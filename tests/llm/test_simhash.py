import random

import xxhash

from tallymill.llm.components import components
from tallymill.llm.simhash import BKTree, bucket_keys, fingerprint, keep_one, near_duplicates, near_links

DOC = "doc_id long, text string, label string, fps string"


def plain(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    label = {x: x for x in nodes}
    done = False
    while not done:
        done = True
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    done = False
    return label


def test_fingerprint_is_the_plain_one():
    for t in (None, "", " \n\t", "One", "A b", "Äb É c d", "a b c " * 7, "x y z\x1cw v"):
        assert fingerprint(t, 3) == plain(t)
    long = " ".join(f"w{k * k % 9973}" for k in range(70_000))
    assert fingerprint(long, 3) == plain(long)


def test_radius_is_respected(spark):
    df = spark.createDataFrame([(1,), (2,), (7,)], "fp long")  # two bits apart each
    assert near_links(df, 0).count() == 0
    assert {(r.u, r.v) for r in near_links(df, 2).collect()} and near_links(df, 1).count() == 0


def test_tree_search_is_exact():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)} | {rng.getrandbits(64) for _ in range(100)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert {tree.values[i] for i in tree.within(v, 3)} == {x for x in values if (x ^ v).bit_count() <= 3}


def test_links_join_what_brute_force_joins(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = {v - 2**64 if v >> 63 else v: v for v in values}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert df.select(bucket_keys(df.fp).alias("k")).first().k[0] >= 0
    expected = classes(sorted(values), lambda a, b: (a ^ b).bit_count() <= 3)
    for shard in (4096, 7):  # with 7, hot keys are cut into shards
        links = near_links(df, 3, shard)
        assert all((signed[r.u] ^ signed[r.v]).bit_count() <= 3 for r in links.collect())
        got = {signed[r.node]: r.label for r in components(links).collect()}
        groups = {}
        for v in values:
            groups.setdefault(got.get(v, v), set()).add(v)
        want = {}
        for v, c in expected.items():
            want.setdefault(c, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (1, 0)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(61)}) == 1
    assert len({got[1000 + i] for i in range(200)}) == 1
    assert len(set(got.values())) == 2
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_with_odd_rows(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = long[:]
    near[200] = "other"
    rows = [(5, " ".join(long)), (3, " ".join(near).upper()), (9, "quite other words here"), (9, "quite other words here"), (7, None), (8, ""), (2, " \n"), (None, "quite other  words here")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOC)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect()]
    fps = [(i, plain(t)) for i, t in rows]
    linked = lambda a, b: (fps[a][1] ^ fps[b][1]).bit_count() <= 3
    label = classes(range(len(fps)), linked)
    least = {c: min((fps[k][0] for k in label if label[k] == c and fps[k][0] is not None), default=None) for c in label.values()}
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted([(i, f"{f:016x}", least[label[k]]) for k, (i, f) in enumerate(fps)], key=key)
    kept = keep_one(df, words=3)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 9]
    assert near_duplicates(df.limit(0)).count() == 0 == keep_one(df.limit(0)).count()
