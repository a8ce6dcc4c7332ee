"""Spelling variants: words one edit apart, found through one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released

#: Runs of letters: A-Z, a-z and U+00C0 to U+00FF, whose UTF-8 is the byte C3 and one of 80 to BF.
RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")
#: Symbols that letters are hashed to: with more, neighbourhoods are larger and meet fewer wrong words.
SYMBOLS = 5
#: Words of more code points go through the join by a hash of theirs, so that long strings aren't repeated for each edit.
LONG = 48
#: Distinct words that a task counts before it hands them on, and edits in a batch of rows.
COUNTED, EDITS = 1 << 18, 1 << 17
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def planted(word: bytes, doc: int, every: int) -> bytes:
    """The lower-cased run, without one code point where `every` divides the crc32 of document and run; `doc` is the crc32 of `<doc_id>:`."""
    h = zlib.crc32(word, doc)
    if h % every:
        return word
    points = word.decode()
    k = h % len(points)
    return (points[:k] + points[k + 1 :]).encode()


def _words(every: int, length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def done() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return rows

        for batch in it:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                doc = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(map(itemgetter(0), RUN.finditer((text or "").encode().lower()))).items():
                    word = planted(word, doc, every)
                    if len(word) >= length:  # bytes: at least as many as code points
                        total[word] += n
                if len(total) > COUNTED:
                    yield done()
        yield done()

    return run


def word_counts(docs: DataFrame, every: int = 97, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least `length` code points with at least `least` occurrences in all texts."""
    each = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(released(_words(every, length)), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.length("word") >= length))


def _reduced(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1 to `symbols` of words of one length, a row each, and the powers of BASE for one more place."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    powers = np.full(points.shape[1] + 1, BASE, np.uint64)
    powers[0] = 1
    return (points % symbols + 1).astype(np.uint64), np.multiply.accumulate(powers)


def edits(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, hash) of each reduced word that is at most one edit from the reduced form of a word; words have one length.

    The hash of symbols v is the sum of v[i] * BASE^i modulo 2^64, so each edit is a few sums of what comes before and
    after it. Edits with the same result are made once: of equal neighbours the first is deleted, and nothing is
    put before its own kind.
    """
    v, power = _reduced(words, symbols)
    n, length = v.shape
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(v * power[:-1], axis=1, out=before[:, 1:])
    whole, of = before[:, -1:], np.arange(n)
    base, unbase = np.uint64(BASE), np.uint64(UNBASE)
    yield of, whole[:, 0]
    step = max(1, EDITS // n)
    for at in range(0, length + 1, step):
        to = min(at + step, length)
        own, place = v[:, at:to], power[at:to]
        drop = before[:, at:to] + (whole - before[:, at + 1 : to + 1]) * unbase
        first = np.ones(own.shape, bool)
        start = 1 if at == 0 else 0
        first[:, start:] = own[:, start:] != v[:, at + start - 1 : to - 1]
        rows, cols = np.nonzero(first)
        yield rows, drop[rows, cols]
        ends = min(at + step, length + 1)
        following = np.zeros((n, ends - at), np.uint64)  # nothing follows the last place
        following[:, : to - at] = own
        for c in range(1, symbols + 1):
            symbol = np.uint64(c)
            rows, cols = np.nonzero(own != symbol)
            yield rows, (whole + (symbol - own) * place)[rows, cols]
            put = before[:, at:ends] + symbol * power[at:ends] + (whole - before[:, at:ends]) * base
            rows, cols = np.nonzero(following != symbol)
            yield rows, put[rows, cols]


def _neighbourhoods(symbols: int, whole: bool):
    """For mapInArrow over (id, word): rows (key, id or word) of each reduced neighbour; `whole` is false for only the reduced word itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            by_length: dict[int, list[int]] = {}
            words = batch.column(1).to_pylist()
            for i, w in enumerate(words):
                by_length.setdefault(len(w), []).append(i)
            for length, at in by_length.items():
                step = max(1, EDITS // length)
                for k in range(0, len(at), step):
                    rows = np.array(at[k : k + step])
                    for of, key in edits([words[i] for i in rows], symbols):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(rows[of]))], names=["key", "id"])
                        if not whole:
                            break

    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, other, other_n): all pairs of different words of `words` (word, n) that one inserted, deleted or replaced code point makes equal.

    Words are reduced to `symbols` symbols (code point modulo `symbols`). One edit of a word is at most one edit of its
    reduced form, so the reduced vocabulary joined with all reduced neighbourhoods meets every such pair; the
    original strings decide. Words of more than LONG code points are joined by a hash and their strings fetched
    for the pairs that come out.
    """
    made = lambda df, id, kind, whole: df.select(F.expr(id), "word").mapInArrow(released(_neighbourhoods(symbols, whole)), f"key long, id {kind}")
    # one code point more or less than LONG may still be near
    short, long = words.where(F.length("word") <= LONG + 1), words.where(F.length("word") >= LONG)
    own = made(short, "struct(word, n)", "struct<word: string, n: long>", False).select("key", F.col("id.word").alias("other"), F.col("id.n").alias("other_n"))
    pairs = made(short, "word", "string", True).withColumnRenamed("id", "word").join(own, "key").select("word", "other", "other_n")
    name = "xxhash64(word)"
    there = made(long, name, "long", True).join(made(long, name, "long", False).withColumnRenamed("id", "there"), "key").select("id", "there").distinct()
    named = long.select(F.expr(name).alias("id"), "word", "n")
    others = named.select(F.col("id").alias("there"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    far = there.join(named.drop("n"), "id").join(others, "there").select("word", "other", "other_n")
    one = F.levenshtein("word", "other", 1) == 1
    return pairs.where(one).unionByName(far.where(one)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of `forms` (word, form) lead; each round doubles the steps that a row has taken.

    Forms have at least twice the occurrences, so there is no way round and their number is the logarithm of the largest count.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, every: int = 97, length: int = 5, least: int = 3, times: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs (doc_id, text).

    Words are runs of letters with A-Z lower-cased; where `every` divides the crc32 of `<doc_id>:<run>`, the code point at
    that value modulo the run's length is left out. They have at least `length` code points and `least` occurrences. A
    word's form is the near word of most occurrences (of these the least in code-point order), if it has `times` as
    many; `root` is where forms lead, the word itself if it has none. Null texts have no words, a null id counts as
    an empty one, repeated rows count again; an empty table gives no rows; other columns of docs play no part.
    """
    words = materialize(word_counts(docs, every, length, least))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))  # strings are compared by their UTF-8, as code points are
    near = near_words(words, symbols).groupBy("word").agg(best.alias("best"), F.count(F.lit(1)).alias("n_near"))
    more = -F.col("best.less") >= times * F.col("n")
    found = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(more, F.col("best.other")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n")
        )
    )
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
