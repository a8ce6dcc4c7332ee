"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, free_name, materialize, released, row_key

#: The spaced seeds. 1 is a word that counts, 0 one that may differ.
MASKS = ("111010010111", "110111001011", "101100111101", "111101011010")
SPAN = len(MASKS[0])
#: Items of fewer words than EXACT must be equal as a whole; others of fewer than SPAN words are met by the masks' first places too.
LEAST, EXACT = 1, 6
#: Bits of the table that says which hashes the items have at all.
BITS = 1 << 23
#: An overlap counts from so many equal words (or the item's own, if fewer), so much of the aligned part and of an item this short.
MATCHES, SHARE = 13, 0.8
#: How far the sum of 1 for an equal word and -2 for a different one may fall before an extension ends.
DROP = 6

TO_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or "").lower().encode().translate(TO_WORDS).split()


def run_length(n: int) -> int:
    """The equal words in a row that each overlap with an item of n words has somewhere, if it counts."""
    if n < EXACT:
        return n
    least = next(k for k in range(n + 1) if k >= min(MATCHES, SHARE * n))
    # with m different words there are m + 1 runs, and at least 4 m equal words
    return min(-(-max(least, 4 * m) // (m + 1)) for m in range(n // 5 + 1) if least + m <= n)


def runs(words: list[bytes], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of all runs of each of the lengths."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in lengths:
        if len(words) >= n:
            out = np.full(len(h) - n + 1, 137 * n, np.uint64)
            for j in range(n):
                out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
            hashes.append(out)
            places.append(np.arange(len(out)))
    return np.concatenate(hashes), np.concatenate(places)


def both_kinds(words: list[bytes], spans: list[int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of the spans and the runs of the lengths."""
    (a, b), (c, d) = seeds(words, spans), runs(words, lengths)
    return np.concatenate((a, c)), np.concatenate((b, d))


def seeds(words: list[bytes], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of each mask at each place; a mask is cut to each of the lengths (SPAN among them, or not)."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in lengths:
        for k, mask in enumerate(MASKS if len(words) >= n else ()):
            out, m = np.full(len(h) - n + 1, 131 * n + k, np.uint64), 0x9E3779B97F4A7C15
            for j in range(n):
                if mask[j] == "1":
                    out += h[j : j + len(out)] * np.uint64(m)
                m = m * 0x2545F4914F6CDD1D % 2**64
            out ^= out >> np.uint64(32)
            hashes.append(out * np.uint64(0xD6E8FEB86659FD93))
            places.append(np.arange(len(out)))
    return np.concatenate(hashes), np.concatenate(places)


def item_seeds(bench: DataFrame) -> DataFrame:
    """(hash, item_id, place, n): the seeds of each item of n words."""

    def fn(ids: list, texts: list) -> dict:
        rows: dict = {"hash": [], "item_id": [], "place": [], "n": []}
        for i, text in zip(ids.to_pylist(), texts):
            words = words_of(text)
            n = len(words)
            h, at = both_kinds(words, [min(SPAN, n)] if n >= EXACT else [], [run_length(n)] if n >= LEAST else [])
            rows["hash"] += h.view(np.int64).tolist()
            rows["place"] += at.tolist()
            rows["item_id"] += [i] * len(h)
            rows["n"] += [len(words)] * len(h)
        return rows

    schema = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64())])
    rows = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    return rows.mapInArrow(batches(fn, schema), "hash long, item_id long, place long, n long")


def _slots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hash): one table of BITS bits with a bit for each."""
    bits = np.zeros(BITS, bool)
    for batch in it:
        bits[batch.column(0).to_numpy() & (BITS - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["bits"])


def _hits(spans: list[int], lengths: list[int], table: bytes):
    """The seeds of rows (key, text) that the table of bits has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table, np.uint8)
        for batch in it:
            rows, hashes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, text in enumerate(batch.column(1).to_pylist()):
                h, at = both_kinds(words_of(text), spans, lengths)
                slot = (h & np.uint64(BITS - 1)).astype(np.int64)
                some = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                rows.append(np.full(len(some), k))
                hashes.append(h[some].view(np.int64))
                places.append(at[some])
            keys = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], names=["key", "hash", "at"])

    return run


def _extend(same: np.ndarray, seed: int) -> tuple[int, int]:
    """The part [a, b) around `seed` of an alignment (equal or not, by place) that extensions reach."""
    score = np.where(same, 1, -2)

    def best(steps: np.ndarray) -> int:
        total = steps.cumsum()
        fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > DROP)
        total = total[: fallen[0]] if len(fallen) else total
        return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0

    return seed - best(score[:seed][::-1]), seed + best(score[seed:])


def overlap(doc: list[bytes], item: list[bytes], shift: int, place: int) -> tuple[int, int, int] | None:
    """(first word in the document, words, equal words) of the overlap around a seed at `place` of the item, if it counts.

    The item's word k stands beside the document's word k + shift; words may differ, none may be missing.
    """
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.array([x == y for x, y in zip(item[a:b], doc[a + shift : b + shift])], bool)
    lo, hi = _extend(same, place - a)
    n, equal = hi - lo, int(same[lo:hi].sum())
    enough = min(MATCHES, SHARE * len(item)) if len(item) >= EXACT else len(item)
    return (a + lo + shift, n, equal) if n and equal >= enough and equal >= SHARE * n else None


def overlaps_at(doc: list[bytes], item: list[bytes], shift: int) -> Iterator[tuple[int, int, int]]:
    """The overlaps at this shift: from each place of it that no overlap before it holds."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    equal = sum(x == y for x, y in zip(item[a:b], doc[a + shift : b + shift]))
    if equal < (min(MATCHES, SHARE * len(item)) if len(item) >= EXACT else len(item)):
        return
    k = a
    while k < b:
        if got := overlap(doc, item, shift, k):
            yield got
        k = max(k + 1, got[0] + got[1] - shift) if got else k + 1


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, item_id, shifts, text, item_text), a document's beside each other: the best overlap of each, if one counts."""
    here, doc = None, []
    for batch in it:
        rows, found = [], []
        for k, (item, shifts, text, item_text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            if text is not here:
                here, doc = text, doc if text == here else words_of(text)
            words = words_of(item_text)
            # none where the seed is of another row with this key
            best = min(((-got[2], got[0], got[1]) for shift in shifts for got in overlaps_at(doc, words, shift)), default=None)
            if best:
                rows.append(k)
                found.append((item, best[1], best[2], -best[0]))
        numbers = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *numbers], names=["key", "item_id", "start_word", "n_words", "n_equal"])


def _overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """overlaps() for documents (key, text) with keys of any kind."""
    kind = docs.schema["key"].dataType.simpleString()
    docs = docs.where("text is not null")
    items = materialize(item_seeds(bench))
    # tables of a fixed size, one a task, are merged as they come, whatever the number of items
    table = np.zeros(BITS // 8, np.uint8)
    for r in items.select("hash").mapInArrow(_slots, "bits binary").toLocalIterator():
        table |= np.frombuffer(r.bits, np.uint8)
    # at most 16 lengths (run_length is 4 from 16 words on)
    sizes = {r[0] for r in items.select(F.least("n", F.lit(16))).distinct().collect()}
    spans, lengths = sorted({min(SPAN, n) for n in sizes if n >= EXACT}), sorted({run_length(n) for n in sizes})
    hits = docs.select("key", "text").mapInArrow(released(_hits(spans, lengths, table.tobytes())), f"key {kind}, hash long, at long")
    found = hits.join(items, "hash").groupBy("key", "item_id").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    found = materialize(found.select(F.col("key").alias("found"), "item_id", "shifts"))
    texts = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("item_text")).where("item_text is not null")
    near = docs.join(found.join(texts, "item_id"), F.col("key").eqNullSafe(F.col("found"))).select("key", "item_id", "shifts", "text", "item_text")
    done = near.mapInArrow(_verified, f"key {kind}, item_id long, start_word long, n_words long, n_equal long")
    # of rows that repeat an item's id or a document's, the best overlap; equal ones once
    best = F.min(F.struct(-F.col("n_equal"), "start_word", "n_words", "n_equal")).alias("best")
    return done.groupBy("key", "item_id").agg(best).select("key", "item_id", "best.start_word", "best.n_words", "best.n_equal")


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_equal): the best overlap of each document with each item that it holds.

    A seed ignores the places its mask leaves out, so a passage is met though words of it were replaced; besides,
    each overlap that counts has run_length equal words in a row, so the runs of that length miss none.
    The seeds of documents are first looked up in a table of BITS bits that has a bit for each hash of the items (of a
    fixed size, however many they are; it only saves rows), then joined with the items' seeds; around
    each alignment with a hit all overlaps are verified word by word, a row for each document and item. Items without a
    word are left out, and so are null texts, null ids of items and pairs without an overlap. Of rows that repeat a doc_id
    each is looked at; an id and an item give one row, the best. No documents or no items: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return _overlaps(rows, bench).withColumnRenamed("key", "doc_id")


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that have no overlap with an item, whatever their doc_id; columns as they were."""
    row, hit = free_name(docs, "__row"), free_name(docs, "__hit")
    keyed = docs.withColumn(row, row_key(docs))
    found = _overlaps(keyed.select(F.col(row).alias("key"), docs["text"].cast("string").alias("text")), bench).select(F.col("key").alias(hit)).distinct()
    return keyed.join(found, F.col(row) == F.col(hit), "left_anti").drop(row)
