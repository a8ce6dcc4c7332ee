import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import language as L

ROW = "doc_id long, lang string, text string"


def letters(text):
    """Lower-case letters with one blank for all between words, after three blanks."""
    out = [" "]
    for ch in text or "":
        c = ch.lower()[0] if unicodedata.category(ch)[0] == "L" else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    if out[-1] != " ":
        out.append(" ")
    return "  " + "".join(out) if len(out) > 1 else ""


def plain_grams(text):
    s = letters(text)
    return [s[i : i + 4] for i in range(len(s) - 3)]


def plain_model(texts, alphabet, d=L.DISCOUNT):
    """p(gram): interpolated Kneser-Ney of order 4 as the textbooks have it."""
    counts = {4: Counter(g for t in texts for g in plain_grams(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ahead = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            ahead[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / alphabet
        ns = ahead[k].get(g[:-1])
        return lower if not ns else (max(counts[k][g] - d, 0) + d * len(ns) * lower) / sum(ns)

    return p


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = {"aa": ["ba", "bab", "abba", "été"], "bb": ["ab", "cab", "ça", "abc"], "uk": ["це", "їжа", "мова", "ім'я"]}
    return [(i, lang, " ".join(rng.choice(words[lang] + ["aba", "zz"]) for _ in range(rng.randrange(1, 12)))) for i, lang in enumerate(rng.choice(list(words)) for _ in range(n))]


def teaches(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def models(rows):
    langs = sorted({lang for i, lang, _ in rows if teaches(i) and lang})
    seen = {c for i, lang, t in rows if teaches(i) and lang for c in letters(t)}
    return langs, [plain_model([t for i, lang, t in rows if teaches(i) and lang == x], len(seen) + 1) for x in langs]


def test_grams_are_whole_and_of_letters_only():
    spell = lambda t: ["".join(chr(int(x) >> 16 * k & 0xFFFF) or " " for k in (3, 2, 1, 0)).replace("\0", " ") for x in L.grams(t)]
    for t in ("", "1 2 3", "Ab", "x, y;  z!", "Їжак і ёж", "\ud800a", "ÀÉ" * 5):
        assert spell(t) == plain_grams(t)
    assert len(L.grams(None)) == 0 and len(L.grams("𐌰𐌱")) == 3


def test_probabilities_are_plain_kneser_ney(spark):
    rows = corpus()
    counts = L.gather(spark.createDataFrame([(i, lang if teaches(i) else None, t) for i, lang, t in rows], ROW))
    langs, plain = models(rows)
    got = {r.gram: r.p for r in L.probabilities(counts, langs).collect()}
    wanted = {g for _, _, t in rows for g in plain_grams(t)}
    assert len(got) == len(wanted)
    for g in wanted:
        code = int(np.array([sum((0 if c == " " else ord(c)) << 16 * (3 - k) for k, c in enumerate(g))], np.uint64).view(np.int64)[0])
        for mine, p in zip(got[code], plain):
            assert mine == pytest.approx(p(g), rel=1e-9)


def test_predictions_are_those_of_the_plain_models(spark):
    rows = corpus()
    odd = [(None, "aa", "ba bab"), (7, None, "abba"), (7, None, "abba"), (901, "bb", None), (902, "bb", "12 3"), (903, None, "quite új text"), (904, "aa", "ba " * 3000)]
    df = spark.createDataFrame(rows + odd, ROW).repartition(3)
    everything = [(i, lang, t) for i, lang, t in rows + odd]
    langs, plain = models([(i if i is not None else 0, lang, t) for i, lang, t in everything if i is None or teaches(i)] and [(i, lang, t) if i is not None else (0, lang, t) for i, lang, t in everything])
    for cells in (L.CELLS, 60):  # with 60, the model is cut into many tables
        got = sorted(map(tuple, L.predicted(df, cells).collect()), key=str)
        assert len(got) == len(everything)
        named = {(i, p) for i, _, p, _, _ in got}
        for i, _, t in everything:
            g = plain_grams(t)
            if not g:
                assert (i, "und") in named
                continue
            h = [-sum(math.log(p(x)) for x in g) / len(g) for p in plain]
            near = {langs[k] for k in range(len(h)) if h[k] - min(h) < 1e-9}
            assert any((i, x) in named for x in near), (i, t)
        for i, held, name, score, rejected in got:
            assert held == (i is not None and not teaches(i)) and 0 <= score <= 1 and (name != "und" or (score == 0 and rejected))
        if cells == L.CELLS:
            first = got
        assert [x[:3] for x in got] == [x[:3] for x in first] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, first))


def test_long_texts_follow_the_same_rule():
    n = np.array([1, 1999, 2000, 2001, 10**6])
    e = L.evidence(n)
    assert (np.diff(e) > 0).all() and e[-1] < L.ENOUGH and e[2] / e[1] < 1.001


def test_counts_that_do_not_fit_are_handed_on(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, ROW)
    whole = sorted(map(tuple, L.gather(df).collect()), key=str)
    monkeypatch.setattr(L, "HELD", 10)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows[k::4]], "text": [r[2] for r in rows[k::4]]}) for k in range(4)]
    total = Counter()
    for b in L._counts(iter(batches)):
        for lang, gram, n in zip(*(c.to_pylist() for c in b.columns)):
            total[lang, gram] += n
    assert sorted(((a, b, n) for (a, b), n in total.items()), key=str) == whole


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.predicted(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where(F.col("held_out") & F.col("lang").isNotNull() & (F.length("text") > 50)).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["rejected"].mean() < 0.1


def test_tables_without_rows_or_languages(spark):
    df = spark.createDataFrame(corpus(), ROW)
    assert L.predicted(df.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in L.predicted(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_calibration_is_over_all_training_rows(spark):
    """More rows than any sample had, and rows without an id, which a sample joined by id had lost."""
    df = spark.createDataFrame(corpus(7000, seed=2) + [(None, "aa", f"ba {'abba ' * k}été") for k in range(300)], ROW).repartition(3)
    got = L.predicted(df).toPandas()
    counts = L.gather(df.withColumn("lang", F.when(~L.held_out(F.col("doc_id")), F.col("lang"))).select("lang", "text"))
    langs = sorted(r.lang for r in counts.where("lang is not null").select("lang").distinct().collect())
    each = L.entropies(df, L.probabilities(counts, langs), langs).where(~L.held_out(F.col("doc_id"))).toPandas()
    h, n, y = np.array(each["h"].tolist()), each["n"].to_numpy(float), np.array([langs.index(x) for x in each["lang"]])
    cut = [np.quantile(h[y == k, k], 1 - L.TURNED_AWAY) for k in range(len(langs))]

    def loss(slope):
        z = -np.clip(slope * L.evidence(n)[:, None] * (h - h.min(1, keepdims=True)), 0, 60)
        return np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y])

    mine = got[~got["held_out"]]
    assert mine["rejected"].sum() == (h.min(1) > np.array(cut)[h.argmin(1)]).sum() > 0
    known = spark.createDataFrame(each[["lang", "n", "h"]], "lang string, n long, h array<double>")
    fitted = L.calibrated(known, langs)
    assert fitted.slope == min(L.SLOPES, key=loss) and fitted.cut == pytest.approx(cut, rel=1e-12)
