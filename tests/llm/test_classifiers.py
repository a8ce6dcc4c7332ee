"""Toxicity and quality: what training does, odd rows, and accuracy on rows that training didn't see."""

import random
import zlib

import numpy as np
import pytest

from tallymill.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_machine_is_the_plain_sum_over_pairs():
    rng = np.random.default_rng(3)
    text = "one two three two"
    slots = toxicity.terms(text)
    m = toxicity.Machine(slots, 0.1, rng.normal(size=len(slots)), rng.normal(size=(len(slots), 4)) / 3)
    z = m.bias + m.w.sum() + sum(m.v[i] @ m.v[j] for i in range(len(slots)) for j in range(i))
    assert m.score(text) == pytest.approx(1 / (1 + np.exp(-z)))
    assert m.score(None) == m.score("") == m.score("12 !") == pytest.approx(1 / (1 + np.exp(-0.1)))


def test_machine_learns_an_interaction():
    """Neither word alone is toxic, the two together are."""
    rng = random.Random(4)
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{chr(97 + rng.randrange(26))}" for _ in range(6)] + ["insultish"] * a + ["groupish"] * b
        texts.append(" ".join(words))
        y.append(a and b)
    m = toxicity.train([toxicity.terms(t) for t in texts], np.array(y))
    assert m.score("wa insultish groupish") > 0.8 and m.score("wa insultish") < 0.3 and m.score("wb groupish") < 0.3


def test_no_labels_or_one_kind():
    assert toxicity.train([np.zeros(0, np.int64)], np.zeros(1)).score("x") < 0.5
    assert toxicity.train([toxicity.terms("a b")] * 5, np.ones(5)).score("x") > 0.5
    assert quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(["x", None]).tolist() == pytest.approx([0.7, 0.7])
    assert (quality.train(np.zeros((3, len(quality.FEATURES))), np.zeros(3)).score(["x"]) < 0.7).all()


def test_features():
    assert not quality.features(None).any() and not quality.features(" \n").any()
    x = dict(zip(quality.FEATURES, quality.features("AB ab ab\nAB ab ab\n$$ !")))
    assert x["log_words"] == pytest.approx(np.log(8)) and x["same_lines"] == pytest.approx(1 / 3)
    assert x["upper"] == pytest.approx(4 / 15) and x["shouts"] == pytest.approx(1 / 15) and x["repeats"] == pytest.approx(2 / 8)


def test_ranking_prefers_what_pairs_prefer():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    worth = x[:, 0] - 2 * x[:, 1]
    y = worth > np.quantile(worth, 0.3)
    r = quality.train(x, y)
    assert np.corrcoef(r.worth(x), worth)[0, 1] > 0.95
    assert abs((r.worth(x) > r.cut).mean() - 0.7) < 0.01


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.97), (quality, "quality", 0.98)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = module.scored(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert ((got["score"] >= module.THRESHOLD) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"]))
    both = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (both["predicted"] == both[label]).mean() >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2), (2, "", None), (3, "x " * 100_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = module.scored(docs, labels).collect()
    assert len(got) == 5 and sum(r.score == got[0].score for r in got) >= 2 and all(0 <= r.score <= 1 for r in got)
    assert module.scored(docs.limit(0), labels).count() == 0
    assert module.scored(docs, labels.limit(0)).count() == 5


def test_stage_keeps_columns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and 0.8 * docs.count() < left.count() < docs.count()


def accuracy(machine, rows, y):
    """Of scores above a half, by the plain sum over all pairs of a row's slots."""
    place = {int(s): k for k, s in enumerate(machine.slots)}
    right = 0
    for r, label in zip(rows, y):
        at = [place[int(s)] for s in r if int(s) in place]
        z = machine.bias + sum(machine.w[k] for k in at) + sum(machine.v[a] @ machine.v[b] for n, a in enumerate(at) for b in at[:n])
        right += (z > 0) == bool(label)
    return right / len(rows)


def rows_of(rng, n, a, b, both):
    """n rows of neutral slots, with slot 1 in a share of a, slot 2 in one of b and in addition both in one of `both`."""
    x = np.stack([rng.random(n) < a, rng.random(n) < b], 1) | (rng.random(n) < both)[:, None]
    return [np.unique(np.concatenate([rng.integers(100, 400, 15), np.flatnonzero(k) + 1])) for k in x], x


def test_machine_learns_what_neither_word_tells_alone():
    """Toxic is one of two words without the other: each alone says nothing."""
    rows, x = rows_of(np.random.default_rng(3), 3000, 0.5, 0.5, 0)
    y = x[:, 0] != x[:, 1]
    assert set(toxicity.telling_pairs(rows, y).tolist()) == {1, 2}
    machine = toxicity.train(rows[:2000], y[:2000])
    assert accuracy(machine, rows[2000:], y[2000:]) > 0.98


def test_machine_learns_a_rare_pair_of_neutral_words():
    rng = np.random.default_rng(4)
    rows, x = rows_of(rng, 6000, 0.1, 0.1, 0.004)
    y = x.all(1) | (rng.random(6000) < 0.02)
    machine = toxicity.train(rows[:4000], y[:4000])
    late = [k for k in range(4000, 6000) if x[k].all()]
    assert len(late) > 10 and accuracy(machine, [rows[k] for k in late], y[late]) > 0.9
    assert accuracy(machine, rows[4000:], y[4000:]) > 0.97


def test_pairs_in_parts_are_those_of_the_whole():
    rng = np.random.default_rng(5)
    rows, x = rows_of(rng, 2000, 0.3, 0.4, 0)
    y = x.all(1)
    whole = toxicity.telling_pairs(rows, y)
    assert len(whole) and set(whole.tolist()) == set(np.concatenate([toxicity.telling_pairs(rows, y, k, 3) for k in range(3)]).tolist())


def test_pairs_of_long_rows_are_screened():
    """Toxic is one of two words without the other, in rows with 3,100 other words of 3,200, taken in pieces."""
    rng = np.random.default_rng(6)
    x = np.array([(a, b) for a in (0, 1) for b in (0, 1)] * 60, bool)
    rows = [np.unique(np.concatenate([np.flatnonzero(k) + 1, 100 + rng.permutation(3200)[:3100]])) for k in x]
    slots, far = toxicity.pair_strengths(rows, x[:, 0] != x[:, 1], 0, 64)  # the part of the first word
    assert {1, 2} == set(slots[far > 6].tolist())


def test_pieces_of_long_rows_change_nothing(monkeypatch):
    rng = np.random.default_rng(7)
    rows, x = rows_of(rng, 2000, 0.3, 0.4, 0)
    whole = toxicity.pair_strengths(rows, x.all(1))
    monkeypatch.setattr(toxicity, "HELD", 7)
    pieces = toxicity.pair_strengths(rows[:2000], x.all(1))
    assert len(whole[0]) and all(np.allclose(a, b) for a, b in zip(whole, pieces))


def test_slots_beyond_the_limit_are_chosen_alike(spark, monkeypatch):
    """With room for one of the two slots of a pair, the smaller is used, however the rows are dealt."""
    monkeypatch.setattr(toxicity, "USED", 1)  # on the driver, which chooses
    rng = np.random.default_rng(8)
    texts = [" ".join([*(w for w, k in zip(("alpha", "omega"), rng.random(2) < 0.5) if k), *(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in rng.integers(0, 200, 20))]) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(("alpha" in t) != ("omega" in t))) for k, t in enumerate(texts)], "doc_id long, toxic int")
    a, b = (toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 7))
    assert a.slots.tolist() == b.slots.tolist() and np.array_equal(a.w, b.w)
    pair = [int(toxicity.terms(w)[0]) for w in ("alpha", "omega")]
    assert min(pair) in a.slots and max(pair) not in a.slots


def test_scores_are_the_plain_sums(spark):
    """The query against a row-by-row sum over all pairs, with the machine that it learnt."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.fit(docs, labels)
    place = {int(s): k for k, s in enumerate(machine.slots)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        at = [place[int(s)] for s in toxicity.terms(texts[r.doc_id]) if int(s) in place]
        z = machine.bias + sum(machine.w[k] for k in at) + sum(machine.v[a] @ machine.v[b] for n, a in enumerate(at) for b in at[:n])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_worth_is_the_plain_weighted_sum(spark):
    """Bradley-Terry: the logit of the preference of two documents is the difference of their worths."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ranking = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.scored(docs, labels).collect():
        x = quality.features(texts[r.doc_id])
        worth = sum(w * min(8, max(-8, (a - m) / d)) for w, a, m, d in zip(ranking.w, x, ranking.mean, ranking.deviation))
        z = worth - ranking.cut + np.log(0.7 / 0.3)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.7)
