import random
import re
from collections import Counter

import pytest

from tallymill.llm import collocations as co

SCHEMA = "lang string, text string"


def plain(rows, least=10, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in candidates.items():
        score, k = min((1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        inside = [b for (other, *v), b in candidates.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= 50 * a for b in inside):
            out.append((lang, -score, -a, " ".join(w), f[lang, *w[:k]], f[lang, *w[k:]]))
    out.sort(key=lambda x: (x[0].encode(), x[1], x[2], x[3].encode()))
    rank, rows = Counter(), []
    for lang, score, a, phrase, l, r in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase, -a, l, r, total[lang], -score))
    return sorted(rows)


def found(spark, rows, schema=SCHEMA, **settings):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(df, **settings).collect())


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "of", "a", "New", "york", "City", "état", "x-y", "ß", "n\x00l", "don't"]
    fixed = ["New York City", "the end of a", "the the the", "x-y of état"]
    make = lambda: " ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(1, 12)))
    return [(rng.choice(["en", "en", "de", None]), rng.choice([".", ", ", "\n", "\t", "  ", "\r\n"]).join(make() for _ in range(5))) for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"least": 3, "top": 15}])
def test_phrases_are_those_of_brute_force(spark, settings):
    rows = texts(1)
    assert found(spark, rows, **settings) == plain(rows, **settings)


def test_streams_are_the_same_over_any_number_of_ranges(spark):
    rows = texts(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        assert found(spark, rows, least=2) == plain(rows, least=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_are_cut_into_parts_without_loss(spark, monkeypatch):
    monkeypatch.setattr(co, "SLICE", 7)
    rows = texts(3, 20)
    for _, text in rows:
        parts = list(co.word_lists(text))
        whole = re.sub("[.,;:!?\x0a-\x0d]", " \n ", text)
        assert [w.decode().lower() for p in parts for w in p] == [w.lower() for w in re.findall("[^ \t]+", whole)]
    monkeypatch.undo()
    long = [("en", "one two three, four " * 80_000)]
    assert found(spark, long) == plain(long)


def test_odd_inputs(spark):
    rows = [("und", "a b " * 20), (None, "a b " * 20), ("en", None), ("en", ""), ("en", ". , \t"), ("de", "x"), ("", "no lang " * 30)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    clash = [(*r, "z", 1, 2) for r in rows]
    assert found(spark, clash, SCHEMA + ", phrase string, n int, range int") == plain(rows)
