"""Quality by Bradley-Terry ranking: scores learnt from pairs of documents of which one is preferred."""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows that the model is fitted on, and preference pairs drawn from them.
ROWS, PAIRS = 6000, 40_000
THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "shouts", "bars", "high_bytes", "distinct_words",
    "repeats", "short_words", "long_words", "line_words", "same_lines", "ends", "odd_words",
)
CLASSES = {name: np.array([bool(re.match(p, chr(c))) for c in range(256)]) for name, p in {"upper": "[A-Z]", "digits": "[0-9]", "symbols": r"[#$%&*<>@\\^_~{}+=]", "marks": r"[.,;:?'\"-]", "shouts": "!", "bars": r"[|/\[\]]", "high_bytes": "[\x80-\xff]"}.items()}
ENDS = re.compile(rb"[.?!]$")


def features(text: str | None) -> np.ndarray:
    """What FEATURES names, of a whole text; shares unless said otherwise. Of a text without words all zero."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, seen = len(words), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, n)
    size = int(sizes.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    odd = sum(not w.strip(b".,;:?!'\"()-").isalpha() for w in words if w.isascii())
    share = lambda name: int(seen[CLASSES[name]].sum()) / size
    return np.array([
        np.log(n), min(size / n, 30) / 10, *map(share, CLASSES), len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n, (sizes <= 2).mean(), (sizes > 15).mean(), np.log(n / len(lines)),
        1 - len(set(lines)) / len(lines), sum(bool(ENDS.search(x)) for x in lines) / len(lines), odd / n,
    ])


@dataclass
class Ranking:
    """A document's worth is w . z, with z its features less their mean over their deviation; `cut` is the worth that scores THRESHOLD."""

    mean: np.ndarray
    deviation: np.ndarray
    w: np.ndarray
    cut: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.w

    def score(self, texts: list) -> np.ndarray:
        at = self.worth(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
        return 1 / (1 + np.exp(-np.clip(at - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, decay: float = 1e-3, seed: int = 1) -> Ranking:
    """Logistic loss on differences of features, over `pairs` random pairs of a preferred and another document.

    The cut is the quantile of the training worths that leaves out as many as are not preferred. Without
    both labels nothing is learnt, and all documents score alike: THRESHOLD if all are preferred, else just below.
    """
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, bool)
    if y.all() or not y.any():
        return Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0 if y.all() else 1e-6)
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / deviation, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(y), pairs)] - z[rng.choice(np.flatnonzero(~y), pairs)]
    w, speed = np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for _ in range(steps):
        slope = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + decay * w
        speed = 0.9 * speed - 0.3 * slope
        w = w + speed
    worth = np.sort(z @ w)
    # the quantile lies between two worths of the sample; their middle is the cut
    k = int((~y).sum())
    return Ranking(mean, deviation, w, float(worth[max(k - 1, 0)] + worth[min(k, len(worth) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Ranking:
    """From labelled rows outside the held-out quarter: a sample of at most `rows` of them, by a hash of the id."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    some = known.where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    @F.pandas_udf("array<double>")
    def measure(t: pd.Series) -> pd.Series:
        return t.map(features)

    got = some.join(texts, "doc_id").select("doc_id", "y", measure("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    return train(np.array(got["x"].tolist()), got["y"].to_numpy() == 1)


def score(ranking: Ranking, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(list(texts)))

    return run(text.cast("string"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, ...).

    A null, empty or blank text is scored by its features, which are all zero. Labels that are null, or of
    ids that docs has not, teach nothing; of labels that repeat an id one counts. Rows that repeat give a row each.
    """
    ranking = fit(docs, labels)
    out = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), score(ranking, docs["text"]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
