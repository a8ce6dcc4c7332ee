"""Language identification by interpolated Kneser-Ney models of characters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import exact_percentiles
from .common import held_out, materialize, released, row_key

#: An n-gram's code has 16 bits for each of its ORDER characters.
ORDER, WIDTH = 4, 16
DISCOUNT = 0.75
#: Probabilities (n-grams times languages) of a table; a larger model is cut into tables, and the texts are read once for each.
CELLS = 4_000_000
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 1_000_000
#: The share of a language's training rows that the rejection may turn away; letters from which more evidence hardly counts.
TURNED_AWAY, ENOUGH = 0.005, 2000
#: Weights of the evidence to choose from.
SLOPES = tuple(2.0**k for k in range(-10, 2))


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Of each code point: a letter's own number in lower case, all else 0.

    Letters beyond 16 bits (of historic scripts and rare ideographs) share the 6,400 numbers of the private area, which has no letters.
    """
    table = np.zeros(sys.maxunicode + 1, np.uint16)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ord(ch.lower()[0])
            table[c] = low if low < 1 << WIDTH else 0xE000 + low % 6400
    return table


def grams(text: str | None) -> np.ndarray:
    """The codes of all n-grams of a whole text; runs of anything but letters are one boundary. Without a letter none."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[0], letter_codes()[points], [0]]).astype(np.uint64)
    c = c[np.flatnonzero(c | np.concatenate([[1], c[:-1]]).astype(np.uint64))]  # of zeros in a row the first
    if not c.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([np.zeros(ORDER - 2, np.uint64), c])
    out = np.zeros(len(c) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(WIDTH) | c[k : k + len(out)]
    return out.view(np.int64)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, text): how often each n-gram occurs in each language, summed in the task as far as HELD allows."""
    held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def rows(lang: str | None) -> pa.RecordBatch:
        codes, n = merged(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    for batch in it:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            mine = held.setdefault(lang, [])
            mine.append(np.unique(grams(text), return_counts=True))
            if len(mine) >= 256:
                held[lang] = [merged(mine)]
        while held and sum(len(c) for parts in held.values() for c, _ in parts) > HELD:
            yield rows(max(held, key=lambda k: sum(len(c) for c, _ in held[k])))
    for lang in list(held):
        yield rows(lang)


def gather(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs (lang, text), those of a null lang too."""
    rows = docs.where("text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(released(_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, WIDTH)


def shorter(gram: Column, order: int) -> Column:
    """The last `order` characters."""
    return gram.bitwiseAND((1 << WIDTH * order) - 1)


def probabilities(counts: DataFrame, langs: list[str]) -> DataFrame:
    """(gram, p array<double>): of every n-gram in `counts` (lang, gram, n) its probability in each of the languages, in order.

    Interpolated Kneser-Ney: orders below the highest count in how many contexts an n-gram stands, and each order
    hands on to the next what DISCOUNT takes away. N-grams of texts without a language have a probability too, so a
    text's are all found as they are.
    """
    size = range(len(langs))
    each = lambda value: F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, value)), F.lit(0)).cast("double") for x in langs))
    needed, seen = {ORDER: counts.select("gram").distinct()}, {ORDER: counts.where("lang is not null")}
    for k in range(ORDER - 1, 0, -1):
        needed[k] = needed[k + 1].select(shorter(F.col("gram"), k).alias("gram")).distinct()
        seen[k] = seen[k + 1].groupBy("lang", shorter(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    totals = seen[1].agg(each(F.col("n")).alias("total"), each(F.lit(1)).alias("types"), (F.count_distinct("gram") + 1).alias("letters")).first()
    out = needed[1].select("gram", F.lit([1 / totals.letters] * len(langs)).alias("lower")).withColumns({"total": F.lit(totals.total), "types": F.lit(totals.types)})
    for k in range(1, ORDER + 1):
        own = seen[k].groupBy("gram").agg(each(F.col("n")).alias("n"))
        if k > 1:
            ahead = seen[k].groupBy(context(F.col("gram")).alias("context")).agg(each(F.col("n")).alias("total"), each(F.lit(1)).alias("types"))
            lower = out.select(F.col("gram").alias("shorter"), F.col("p").alias("lower"))
            out = needed[k].join(lower, shorter(F.col("gram"), k - 1) == F.col("shorter")).join(ahead, context(F.col("gram")) == F.col("context"), "left")
        out = out.join(own.withColumnRenamed("gram", "own"), F.col("gram") == F.col("own"), "left")
        taken = lambda i: F.greatest(F.coalesce(F.get("n", F.lit(i)), F.lit(0.0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.get("types", F.lit(i)) * F.get("lower", F.lit(i))
        out = out.select("gram", F.array(*(F.coalesce(F.try_divide(taken(i), F.get("total", F.lit(i))), F.get("lower", F.lit(i))) for i in size)).alias("p"))
    return out


@dataclass
class Table:
    """Log-probabilities of n-grams in each language (the columns), by the sorted array of their codes."""

    codes: np.ndarray
    logs: np.ndarray

    def sums(self, text: str | None) -> tuple[int, np.ndarray]:
        """(n-grams of the text, the sum over those in the table in each language)."""
        found = grams(text)
        codes, n = np.unique(found, return_counts=True)
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        hit = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        return len(found), n[hit] @ self.logs[at[hit]]


def tables(model: DataFrame, langs: list[str], cells: int = CELLS) -> tuple[int, Iterator[Table]]:
    """(number, the tables): as many as keep each to `cells` probabilities; the driver has one at a time."""
    parts = max(1, -(-model.count() * len(langs) // cells))
    logs = [F.log(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(len(langs))]

    def part(k: int) -> Table:
        got = model.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).select("gram", *logs).toArrow()
        codes, *columns = (c.to_numpy() for c in got.columns)
        order = np.argsort(codes)
        return Table(codes[order], np.stack(columns, axis=1)[order])

    return parts, map(part, range(parts))


def entropies(docs: DataFrame, model: DataFrame, langs: list[str], cells: int = CELLS) -> DataFrame:
    """docs (doc_id, text, ...) with n, the text's n-grams, and h array<double>, its cross-entropy in nats a letter in each language (null without a letter).

    With one table the texts pass it once. Else each table has a pass of its own, whose sums are written out, and they are added up.
    """

    def measured(table: Table) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("n long, s array<double>")
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([shared.value.sums(t) for t in texts], columns=["n", "s"])

        return run(F.col("text").cast("string"))

    parts, each = tables(model, langs, cells)
    if parts == 1:
        out = docs.withColumn("m", measured(next(each)))
    else:
        keyed = docs.withColumn("key", row_key(docs))
        once = keyed.select("key", "text").dropDuplicates(["key"])
        sums = [materialize(once.select("key", measured(x).alias("m")).select("key", "m.*")) for x in each]
        total = sums[0]
        for x in sums[1:]:
            total = total.unionByName(x)
        total = total.groupBy("key").agg(F.struct(F.max("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(len(langs)))).alias("s")).alias("m"))
        out = keyed.join(total, "key").drop("key")
    n = F.nullif(F.col("m.n"), F.lit(0))
    return out.select(*docs.columns, F.col("m.n").alias("n"), F.when(n.isNotNull(), F.transform("m.s", lambda x: -x / n)).alias("h"))


def evidence(n):
    """How many letters' worth of evidence n letters are: those of a long text do not add up as if they were independent."""
    return n * ENOUGH / (n + ENOUGH)


@dataclass
class Calibration:
    """From training texts: the weight of the evidence, and for each language the entropy from which a text is no longer taken for it."""

    slope: float
    cut: list[float]


def shares(slope: float) -> Column:
    """Of a text's entropies h each language's likelihood in proportion to the best one's."""
    return F.transform("h", lambda x: F.exp(-beyond(slope, x)))


def beyond(slope: float, x: Column) -> Column:
    """By how much an entropy x of a text speaks against its language, beside the least of the text's."""
    return F.least(F.lit(60.0), slope * evidence(F.col("n")) * (x - F.array_min("h")))


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def calibrated(known: DataFrame, langs: list[str]) -> Calibration:
    """From all rows of known (lang, n, h) that have a letter; the slope is that under which their languages are likeliest.

    The losses are sums over the table, the cuts exact percentiles by ranges, so no task and no driver holds a language's rows.
    """
    rows = known.where("n > 0").withColumn("own", F.get("h", F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1))
    losses = rows.agg(*(F.avg(F.log(summed(shares(s))) + beyond(s, F.col("own"))) for s in SLOPES)).first()
    cuts = {r.lang: r.p[0] for r in exact_percentiles(rows, ["lang"], "own", (1 - TURNED_AWAY,)).collect()}
    return Calibration(min(zip(losses, SLOPES))[1], [cuts.get(x, float("inf")) for x in langs])


def predicted(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of docs (doc_id, text, lang, ...).

    The models, the rejection and the score's weight are learnt from all rows outside the held-out quarter that have a
    language; the entropies of all texts are written out once, for the learning and the result. lang_pred is the
    language of the least cross-entropy a letter, `und` for a null text or one without a letter (or if no row teaches a language), with score 0; of equals the first by name.
    The score is the calibrated share of the best among all languages; rejected tells that the entropy is above what
    training texts of that language have. Rows without lang, without id or with repeats give a row each; texts are read whole.
    """
    held = held_out(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    teaching = rows.withColumn("lang", F.when(~held, F.col("lang")))
    counts = materialize(gather(teaching.select("lang", "text")))
    langs = sorted(r.lang for r in counts.where("lang is not null").select("lang").distinct().collect())
    none = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)}
    if not langs:
        return rows.select("doc_id", held.alias("held_out"), *(v.alias(c) for c, v in none.items()))
    model = materialize(probabilities(counts, langs))
    each = materialize(entropies(teaching, model, langs, cells).select("doc_id", "lang", "n", "h"))
    fitted = calibrated(each.where("lang is not null"), langs)
    least, place = F.array_min("h"), (F.array_position("h", F.array_min("h")) - 1).cast("int")
    found = {"lang_pred": F.get(F.lit(langs), place), "score": 1 / summed(shares(fitted.slope)), "rejected": least > F.get(F.lit(fitted.cut), place)}
    return each.select("doc_id", held.alias("held_out"), *(F.when(F.col("h").isNull(), none[c]).otherwise(v).alias(c) for c, v in found.items()))
