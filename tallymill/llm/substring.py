"""Removal of repeated passages: suffix automata of reference shards give matching statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, free_name, materialize, released

#: Words of a window, and of the grams whose least hash in a window is its anchor.
WINDOW, GRAM = 20, 8
#: Segments of an anchor above which its windows are counted one by one instead.
HOT = 2000


class SuffixAutomaton:
    """Of all word sequences added so far; state 0 is the start."""

    def __init__(self) -> None:
        self.arcs: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, arcs: dict[bytes, int], link: int, length: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state for `at`'s longest sequence followed by word, which must be an arc."""
        to = self.arcs[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(dict(self.arcs[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.arcs[at].get(word) == to:
            self.arcs[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            if word in self.arcs[last]:
                last = self._split(last, word)
                continue
            new, at = self._state({}, 0, self.length[last] + 1), last
            while at >= 0 and word not in self.arcs[at]:
                self.arcs[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word)
            last = new

    def matching(self, words: list[bytes]) -> Iterator[int]:
        """For each word the length of the longest known sequence that ends there."""
        at = n = 0
        for word in words:
            while at and word not in self.arcs[at]:
                at = self.link[at]
                n = self.length[at]
            if word in self.arcs[at]:
                at, n = self.arcs[at][word], n + 1
            else:
                n = 0
            yield n


def _rolling(h: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hashes of all runs of `size` values."""
    out, m = np.zeros(len(h) - size + 1, np.uint64), 1
    for j in range(size):
        out += h[j : j + len(out)] * np.uint64(m)
        m = m * factor % 2**64
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its hash, the first window that has it, how many have it; and the words' hashes.

    A window's anchor is the gram in it with the least hash, the leftmost of equals; so windows of the same
    words have the same anchor at the same place, and consecutive windows mostly share one.
    """
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), h
    grams = _rolling(h, gram, 0x2545F4914F6CDD1D)
    place = np.arange(len(words) - window + 1)
    place += np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], first, np.diff(first, append=len(place)), h


def _documents(window: int, gram: int):
    """For each document: a 128-bit hash of its words, their number and its anchors."""

    def fn(ids: list, texts: list) -> dict:
        out: dict = {"doc_id": ids, "key": [], "n_words": [], "anchors": []}
        for text in texts:
            words = (text or "").encode().split()
            out["key"].append(xxhash.xxh3_128_digest(b" ".join(words)))
            out["n_words"].append(len(words))
            out["anchors"].append(anchors(words, window, gram)[0].view(np.int64))
        return out

    return batches(fn, pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("anchors", pa.list_(pa.int64()))]))


SEGMENT = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])


def _segments(window: int, gram: int):
    """Of documents and those of their anchors that repeat: the words of each anchor's n windows. Those of hot anchors have a hash g of the words, others 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            for doc_id, text, cold, hot in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                found, first, n, _ = anchors(words, window, gram)
                found = found.view(np.int64)
                for k in np.flatnonzero(np.isin(found, cold + hot)):
                    a, h = int(first[k]), int(found[k])
                    segment = b" ".join(words[a : a + int(n[k]) + window - 1])
                    rows.append((h, xxhash.xxh3_64_intdigest(segment) >> 2 | 1 if h in hot else 0, doc_id, a, int(n[k]), segment))
                if len(rows) > 20_000:
                    yield _batch(rows, SEGMENT)
                    rows = []
            yield _batch(rows, SEGMENT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


PLACE = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])


def _windows(window: int):
    """A 128-bit hash of each window of segments (doc_id, start, words)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for doc_id, start, segment in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, segment.split())), ">u8").astype(np.uint64)
                one, two = (_rolling(h, window, f).view(np.int64).tolist() for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
                rows += [(x, y, doc_id, a) for a, (x, y) in enumerate(zip(one, two), start)]
            yield _batch(rows, PLACE)

    return run


SPAN = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _stream(window: int):
    """Over segments in order of (h, doc_id, start): which windows an earlier segment of the same anchor has.

    The automaton of an anchor's earlier segments is the reference; a segment's matching statistics reach
    the window's length where one of its windows is known. It is then added, unless it held nothing new.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known, seen = None, SuffixAutomaton(), {}
        for batch in it:
            out = []
            for h, doc_id, start, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if h != here:
                    here, known, seen = h, SuffixAutomaton(), {}
                at = (doc_id, start)
                if text in seen:
                    if seen[text] != at:  # a row that repeats is the same place
                        out.append((doc_id, start, n))
                    continue
                seen[text] = at
                words = text.split(b" ")
                covered = [i for i, reach in enumerate(known.matching(words), 1 - window) if reach >= window]
                out.extend((doc_id, start + i, 1) for i in covered)
                if len(covered) < n:
                    known.add(words)
            yield _batch(out, SPAN)

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, starts array<struct<start, n>>): runs of n windows, by their first word, whose words also start earlier.

    Earlier means in a smaller doc_id or before in the same document. Rows with the same doc_id are one
    document here. A text of the same words as a smaller doc_id's is one run; the least of each such group
    goes on. Windows of the same words share an anchor, so only segments around anchors found twice are
    looked at, and segments are sharded by anchor: the suffix automaton of a shard's segments so far is met
    by the next. The segments of an anchor with over `hot` of them are grouped by their words instead, and the
    windows of the first of each group by a 128-bit hash, as partial aggregation takes any group. A null id can't be ordered: its row has nothing removed.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    each = materialize(rows.mapInArrow(_documents(window, gram), "doc_id long, key binary, n_words long, anchors array<long>").where(F.col("n_words") >= window))
    first = materialize(each.groupBy("key").agg(F.min(F.struct("doc_id", "anchors")).alias("x")).select("key", "x.doc_id", "x.anchors"))
    found = first.select("doc_id", F.explode("anchors").alias("h"))
    # a table of its own, so that the join's stage has no aggregation and AQE can split the partition of a hot anchor
    times = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    lists = found.join(times, "h").groupBy("doc_id").agg(*(F.collect_set(F.when(F.expr(c), F.col("h"))).alias(k) for k, c in (("cold", f"n <= {hot}"), ("hot", f"n > {hot}"))))
    near = rows.join(lists, "doc_id").select("doc_id", "text", "cold", "hot")
    segments = materialize(near.mapInArrow(released(_segments(window, gram)), "h long, g long, doc_id long, start long, n long, words binary"))
    shards = segments.where("g = 0").repartition("h").sortWithinPartitions("h", "doc_id", "start").select("h", "doc_id", "start", "n", "words")
    cold = shards.mapInArrow(released(_stream(window)), "doc_id long, start long, n long")
    place = F.struct("doc_id", "start")
    alike = segments.where("g != 0").select("h", "g", "doc_id", "start", "n")
    # written out, so that AQE can split the join on a hot group: its stage has no aggregation
    leads = materialize(segments.where("g != 0").groupBy("h", "g").agg(F.min(F.struct("doc_id", "start", "words")).alias("lead")))
    copied = alike.join(leads.select("h", "g", F.struct("lead.doc_id", "lead.start").alias("lead")), ["h", "g"]).where(place > F.col("lead")).select("doc_id", "start", "n")
    single = materialize(leads.select("lead.*").mapInArrow(released(_windows(window)), "one long, two long, doc_id long, start long"))
    least = single.groupBy("one", "two").agg(F.min(place).alias("least"))
    later = single.join(least, ["one", "two"]).where(place > F.col("least")).select("doc_id", "start", F.lit(1).cast("long").alias("n"))
    copies = each.join(first.select("key", F.col("doc_id").alias("least")), "key").where("doc_id > least")
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start"), (F.col("n_words") - window + 1).alias("n"))
    spans = cold.unionByName(copied).unionByName(later).unionByName(whole)
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("starts"))


def _cut(window: int):
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, starts):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for x in spans if spans is not None else ():
                if x["start"] < len(words):  # else a run of another row of the same id
                    gone[x["start"]] += 1
                    gone[min(len(words), x["start"] + x["n"] + window - 1)] -= 1
            stay = gone[:-1].cumsum() == 0
            kept = b" ".join(w for w, k in zip(words, stay.tolist()) if k)
            rows.append((len(words), len(words) - int(stay.sum()), kept.decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return cut


def _with_cut(docs: DataFrame, window: int, name: str) -> DataFrame:
    """docs with a column `name`: (n_words, n_removed, kept)."""
    ids, starts = free_name(docs, "__id"), free_name(docs, "__starts")
    spans = repeated_windows(docs, window).select(F.col("doc_id").alias(ids), F.col("starts").alias(starts))
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans[ids], "left")
    return joined.withColumn(name, _cut(window)(docs["text"].cast("string"), F.col(starts)))


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs (doc_id, text, ...); see repeated_windows.

    A null text has no words. Other columns play no part; an empty table gives an empty one.
    """
    cut = _with_cut(docs.select("doc_id", "text"), window, "__cut")
    return cut.select(F.col("doc_id").cast("long"), "__cut.n_words", "__cut.n_removed", F.sha2(F.col("__cut.kept").cast("binary"), 256).alias("kept_sha256"))


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words of repeated windows: kept words joined by a space in `text`, and n_chars (if there) of them.

    Rows in which nothing repeats stay as they are; a row whose every word goes stays with an empty text.
    """
    name = free_name(docs, "__cut")
    done = _with_cut(docs, window, name)
    some = F.col(name)["n_removed"] > 0
    new = {"text": F.col(name)["kept"], "n_chars": F.length(F.col(name)["kept"])}
    return done.select(*(F.when(some, new[c].cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c) if c in new else docs[c] for c in docs.columns))
