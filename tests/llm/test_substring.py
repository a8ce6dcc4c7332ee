import hashlib
import random

from tallymill.llm.substring import SuffixAutomaton, cut, removed, repeated_windows

SPACE = " \t\n\v\f\r"


def plain(rows, k=20):
    """By the definition, over (doc_id, text)."""
    words = {}
    for i, t in rows:
        for c in SPACE:
            t = (t or "").replace(c, " ")
        words[i] = [w for w in t.split(" ") if w]
    first, out = {}, {}
    for i in sorted(words):
        w = words[i]
        gone = set()
        for p in range(len(w) - k + 1):
            if first.setdefault(tuple(w[p : p + k]), (i, p)) != (i, p):
                gone.update(range(p, p + k))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out[i] = (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**7)}"
    passages = [[word() for _ in range(n)] for n in (20, 25, 60, 19, 200)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p if rng.random() < 0.6 else p[a : a + rng.randrange(60)]
        if i % 9 == 0:
            w += [rng.choice(["or", "and"]) for _ in range(120)]
        if i % 7 == 0:
            w += ["same"] * rng.randrange(15, 90)
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:15])]
    for k, (_, t) in enumerate(rows[:30]):
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = word()
        rows.append((2000 + k, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, "é " * 30), (5003, "\x1c\x85 " * 25)]


def test_matching_statistics():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[bytes([97 + rng.randrange(2)]) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        known = SuffixAutomaton()
        for t in texts[:3]:
            known.add(t)
        subs = {tuple(t[i:j]) for t in texts[:3] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        q = texts[3]
        want = [max((n for n in range(1, e + 2) if tuple(q[e + 1 - n : e + 1]) in subs), default=0) for e in range(len(q))]
        assert list(known.matching(q)) == want


def test_removed_is_exact(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, starts string, n int").repartition(7)
    want = sorted(plain(rows).values())
    assert sorted(map(tuple, removed(df).collect())) == want
    assert sum(r[2] for r in want) > 2000


def test_hot_anchors_are_exact_too(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cold = {r.doc_id: r.starts for r in repeated_windows(df).collect()}
    hot = {r.doc_id: r.starts for r in repeated_windows(df, hot=3).collect()}
    flat = lambda d: {(i, x.start + k) for i, xs in d.items() for x in xs for k in range(x.n)}
    assert flat(cold) == flat(hot)


def test_odd_rows_and_the_stage(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text, 5, "a"), (1, text, 5, "a"), (2, text + " more", 9, "b"), (None, text, 1, "c"), (3, None, None, None), (4, "few\nwords", 9, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, starts string")
    got = sorted(map(tuple, cut(df).collect()), key=str)
    assert got == sorted([rows[0], rows[1], (2, "more", 4, "b"), rows[3], rows[4], rows[5]], key=str)
    assert cut(df).columns == df.columns
    assert removed(df.limit(0)).count() == 0
