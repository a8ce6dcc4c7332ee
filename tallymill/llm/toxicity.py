"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: Hash slots of terms, those of words in the lower half; labelled rows that the model is fitted on; slots that it uses at most; factors.
SLOTS, ROWS, USED, FACTORS = 1 << 18, 6000, 4096, 8
#: A term must be in so many of the fitted rows, a pair of words in so many; else it could only be learnt by heart.
SEEN, TOGETHER = 5, 12
#: So many deviations from what chance gives are needed: of a term's toxic rows, and of a pair's from what its two words tell alone.
TELLS, PAIR_TELLS = 4.0, 6.0
#: Parts of the pairs, each a task's; bits of the hash that a part's pairs are counted by; pairs that are held at a time (a long row's in pieces).
PARTS, BITS, HELD = 8, 20, 1_000_000
THRESHOLD = 0.3

LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> np.ndarray:
    """The distinct hash slots of a whole text's words (runs of letters, lower-cased) and of how they start.

    The starts, of 4 and 5 bytes, stand for stems in languages that inflect.
    """
    words = set((text or "").lower().encode().translate(LETTERS).split())
    starts = {w[:k] for w in words for k in (4, 5) if len(w) > k}
    half = SLOTS // 2
    found = [xxhash.xxh3_64_intdigest(w) % half for w in words] + [half + xxhash.xxh3_64_intdigest(w) % half for w in starts]
    return np.unique(np.array(found, np.int64))


@dataclass
class Machine:
    """score = sigmoid(bias + sum of w + sum over pairs of <v, v'>), over the slots of a text that are used."""

    slots: np.ndarray  # sorted
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, text: str | None) -> float:
        found = terms(text)
        at = np.searchsorted(self.slots, found)
        at = at[self.slots[np.minimum(at, len(self.slots) - 1)] == found] if len(self.slots) else at[:0]
        v = self.v[at]
        pairs = 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.w[at].sum() + pairs, -30, 30))))


def deviations(n: np.ndarray, toxic: np.ndarray, chance: np.ndarray) -> np.ndarray:
    return np.abs(toxic - n * chance) / np.sqrt(n * chance * (1 - chance) + 1)


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, part: int = 0, parts: int = 1) -> np.ndarray:
    """The slots of pair_strengths."""
    return pair_strengths(rows, labels, part, parts)[0]


def pair_strengths(rows: list[np.ndarray], labels: np.ndarray, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The slots of pairs of words whose rows' labels are not what the two words tell alone (their log-odds added up), and how far off the furthest pair of each is.

    Of all pairs one part is looked at, by the first word. They are counted by a hash first; those in buckets that
    stand out then as they are. Rows of any length count.
    """
    none = np.zeros(0, np.int64), np.zeros(0)
    y = np.asarray(labels, float)
    words = [r[r < SLOTS // 2] for r in rows]
    slots, place, seen = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    toxic = np.bincount(place, np.repeat(y, [len(w) for w in words]), len(slots))
    often = seen >= TOGETHER
    if not 0 < y.sum() < len(y) or not often.any():
        return none
    slots, seen, toxic, base = slots[often], seen[often], toxic[often], y.mean()
    odds = (toxic + base) / (seen - toxic + 1 - base)
    size, usual = len(slots), base / (1 - base)

    def chance(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = odds[i] * odds[j] / usual
        return both / (1 + both)

    def bucket(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((i * size + j).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)

    def pairs():
        held, size_held = [], 0
        for w, k in zip(words, y):
            at = np.searchsorted(slots, w)
            at = at[slots[np.minimum(at, size - 1)] == w]
            mine = np.flatnonzero(at % parts == part)
            pieces = np.flatnonzero(np.diff((len(at) - 1 - mine).cumsum() // HELD)) + 1
            for first in np.split(mine, pieces):
                n = len(at) - 1 - first
                second = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(first + 1, n)
                held.append((np.repeat(at[first], n), at[second], np.full(n.sum(), k)))
                size_held += n.sum()
                if size_held > HELD:
                    yield map(np.concatenate, zip(*held))
                    held, size_held = [], 0
        if held:
            yield map(np.concatenate, zip(*held))

    total, bad, expected = (np.zeros(1 << BITS) for _ in range(3))
    for i, j, k in pairs():
        at = bucket(i, j)
        for sums, weights in ((total, None), (bad, k), (expected, chance(i, j))):
            sums += np.bincount(at, weights, 1 << BITS)
    stands_out = (total >= TOGETHER) & (deviations(total, bad, expected / np.maximum(total, 1)) >= TELLS)
    found = [np.stack([i[some], j[some], k[some]]) for i, j, k in pairs() if (some := stands_out[bucket(i, j)]).any()]
    if not found:
        return none
    i, j, k = np.concatenate(found, axis=1)
    codes, which, n = np.unique((i * size + j).astype(np.int64), return_inverse=True, return_counts=True)
    i, j = codes // size, codes % size
    far = deviations(n, np.bincount(which, k), chance(i, j))
    tells = (n >= TOGETHER) & (far >= PAIR_TELLS)
    best = pd.Series(np.tile(far[tells], 2)).groupby(slots[np.concatenate([i[tells], j[tells]])]).max()
    return best.index.to_numpy(np.int64), best.to_numpy(float)


def telling_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The slots that tell alone, those that tell most first, USED at most."""
    y = np.asarray(labels, float)
    slots, place, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    toxic = np.bincount(place, np.repeat(y, [len(r) for r in rows]), len(slots))
    tells = np.where(seen >= SEEN, deviations(seen, toxic, np.full(len(slots), y.mean())), 0)
    best = np.argsort(-tells, kind="stable")[:USED]
    return slots[best[tells[best] >= TELLS]]


def train(rows: list[np.ndarray], labels: np.ndarray, paired: np.ndarray | None = None, epochs: int = 30, rate: float = 0.1, decay: float = 2e-4, batch: int = 8, seed: int = 1) -> Machine:
    """By AdaGrad on the logistic loss over the slots that tell alone and the `paired` ones (by default all of telling_pairs).

    Rows are taken in batches, each of them one sparse matrix. Without both labels the score is the share of label 1.
    """
    y = np.asarray(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    none = Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < y.sum() < len(y):
        return none
    paired = telling_pairs(rows, y) if paired is None else paired
    slots = np.union1d(paired, telling_terms(rows, y)[: max(0, USED - len(paired))]).astype(np.int64)
    if not len(slots):
        return none
    places = [np.searchsorted(slots, r) for r in rows]
    places = [at[slots[np.minimum(at, len(slots) - 1)] == r] for at, r in zip(places, rows)]
    rng = np.random.default_rng(seed)
    dealt = rng.permutation(len(places))
    batches = []
    for a in range(0, len(dealt), batch):
        mine = dealt[a : a + batch]
        n = np.array([len(places[k]) for k in mine])
        used, local = np.unique(np.concatenate([places[k] for k in mine]), return_inverse=True)
        order = np.argsort(local, kind="stable")
        batches.append((y[mine], used, local, n, order, np.searchsorted(local[order], np.arange(len(used)))))
    # a slot's row: its weight and its factors
    weights = np.hstack([np.zeros((len(slots), 1)), rng.normal(0, 0.05, (len(slots), FACTORS))])
    speed, bias_speed = np.full(weights.shape, 1e-6), 1e-6
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            wanted, used, local, n, order, groups = batches[b]
            here, filled = weights[used], n > 0
            each, z = here[local], np.full(len(n), bias)
            if len(each):
                starts = (n.cumsum() - n)[filled]
                sums = np.add.reduceat(each, starts, axis=0)
                z[filled] += sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - np.add.reduceat((each[:, 1:] ** 2).sum(1), starts))
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - wanted
            if len(each):
                slope = np.repeat(sums, n[filled], axis=0) - each
                slope[:, 0] = 1
                slope *= np.repeat(e, n)[:, None]
                slope = np.add.reduceat(slope[order], groups, axis=0) + decay * here
                speed[used] += slope**2
                weights[used] = here - rate * slope / np.sqrt(speed[used])
            bias_speed += e.sum() ** 2
            bias -= rate * e.sum() / np.sqrt(bias_speed)
    return Machine(slots, float(bias), weights[:, 0].copy(), weights[:, 1:].copy())


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Machine:
    """From labelled rows outside the held-out quarter: a sample of at most `rows` of them, by a hash of the id.

    The sample is screened for pairs in PARTS tasks and the machine is trained in one; the driver gets the machine alone.
    Of more than USED slots of pairs those whose pairs tell most are used, ties by slot.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y"))
    some = known.where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    @F.pandas_udf("array<long>")
    def slots(t: pd.Series) -> pd.Series:
        return t.map(terms)

    sample = materialize(some.join(texts, "doc_id").select("doc_id", "y", slots("text").alias("x")))

    def unpacked(got: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        got = got.sort_values("doc_id", kind="stable")
        return [np.asarray(x, np.int64) for x in got["x"]], got["y"].to_numpy()

    def screen(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("slot", "far"), pair_strengths(*unpacked(got), key[0], PARTS))))

    parts = sample.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    slots_of_pairs = parts.groupBy("part").applyInPandas(screen, "slot long, far double").groupBy("slot").agg(F.max("far").alias("far"))
    paired = np.array([r.slot for r in slots_of_pairs.orderBy(F.desc("far"), "slot").limit(USED).collect()], np.int64)

    def learn(got: pd.DataFrame) -> pd.DataFrame:
        m = train(*unpacked(got), np.sort(paired))
        return pd.DataFrame({"slot": [-1, *m.slots], "w": [m.bias, *m.w], "v": [np.zeros(FACTORS), *m.v]})

    got = sample.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(learn, "slot long, w double, v array<double>").sort("slot").collect()
    if not got:
        return train([np.zeros(0, np.int64)], np.zeros(1))
    bias, *each = got
    return Machine(np.array([r.slot for r in each], np.int64), bias.w, np.array([r.w for r in each], float), np.array([r.v for r in each], float).reshape(-1, FACTORS))


def score(machine: Machine, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(machine.score).astype(float)

    return run(text.cast("string"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, ...).

    A null, empty or wordless text gets the score of no terms (the bias). Labels that are null, or of ids
    that docs has not, teach nothing; of labels that repeat an id one counts. Rows that repeat give a row each.
    """
    machine = fit(docs, labels)
    out = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), score(machine, docs["text"]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold; columns as they were."""
    return docs.where(score(fit(docs, labels), docs["text"]) < THRESHOLD)
