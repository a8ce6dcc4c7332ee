"""Phrase mining: counts of one to three words kept as streams in prefix and in suffix order and merged in lockstep."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, released

#: Ends of pieces become BREAK, tabs blanks, and A-Z lower case.
BREAK = b"\n"
CLEAN = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")
#: Bits of the filter of phrases that are frequent enough to be parts of others; it is broadcast (8 MB), whatever the input.
BITS = 1 << 26
#: Bits of a block while the filter is put together, bytes of a text that are split at once.
BLOCK, SLICE = 1 << 16, 1 << 20
#: Bytes of words whose phrases a task counts at a time.
COUNTED = 1 << 21


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text with BREAK between its pieces, in parts that end at a blank."""
    clean = (text or "").encode().translate(CLEAN).replace(BREAK, b" \n ")
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        yield [w for w in clean[at:end].split(b" ") if w]
        at = end


def _lang(lang: str) -> int:
    return zlib.crc32(lang.encode() + b" ")


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(a, b, pa.scalar(b" ", pa.binary()))


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of codes, and the place of each code's among them."""
    found = pa.array(codes, pa.int64()).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)


def _known(bits: np.ndarray, lang: int, phrases: pa.Array) -> np.ndarray:
    """Which phrases a filter has."""
    at = np.fromiter((zlib.crc32(p, lang) for p in phrases.to_pylist()), np.int64, len(phrases)) % BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def phrases(words: pa.Array, size: int, filters: list[np.ndarray], lang: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of `size` words in an array of words, whose shorter parts the filters know, and their counts; none goes over a BREAK.

    Words are numbered in the array; a pair is the numbers of its two words, a phrase of three those of its pair and its last word.
    """
    coded = words.dictionary_encode()
    each, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    a_word = pc.not_equal(each, pa.scalar(BREAK, pa.binary())).to_numpy(zero_copy_only=False)
    if size == 1:
        return each.filter(pa.array(a_word)), np.bincount(ids, minlength=len(each))[a_word]
    frequent = (a_word & _known(filters[0], lang, each))[ids]
    first = np.flatnonzero(frequent[:-1] & frequent[1:])
    pairs, which = _numbered(ids[first] * len(each) + ids[first + 1])
    text = _joined(each.take(pa.array(pairs // max(len(each), 1))), each.take(pa.array(pairs % max(len(each), 1))))
    if size == 2:
        return text, np.bincount(which, minlength=len(pairs))
    frequent = _known(filters[1], lang, text)[which]
    both = np.flatnonzero(frequent[:-1] & frequent[1:] & (np.diff(first) == 1))
    threes, which = _numbered(which[both] * np.int64(len(each)) + ids[first[both] + 2])
    return _joined(text.take(pa.array(threes // max(len(each), 1))), each.take(pa.array(threes % max(len(each), 1)))), np.bincount(which, minlength=len(threes))


def _counted(size: int, filters: list):
    """For mapInArrow over (lang, text): (lang, phrase, n); of single words also (lang, null, number of all)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        bits = [np.frombuffer(f.value, np.uint8) for f in filters]
        n_held = 0

        def done() -> Iterator[pa.RecordBatch]:
            for lang, parts in list(held.items()):
                words = pa.concat_arrays(parts)
                phrase, n = phrases(words, size, bits, _lang(lang))
                if size == 1:
                    phrase, n = pa.concat_arrays([phrase, pa.nulls(1, pa.binary())]), np.append(n, n.sum())
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "phrase": phrase.cast(pa.string()), "n": pa.array(n, pa.int64())})
                # a text that goes on needs its last words again
                held[lang] = [pa.concat_arrays([words.slice(max(0, len(words) - size + 1))])]
                if size == 1 or words[-1].as_py() == BREAK:
                    del held[lang]

        for batch in it:
            for row in zip(*batch.columns):
                lang, text = (x.as_py() for x in row)
                for words in chain(word_lists(text), [[BREAK]]):
                    part = pa.array(words, pa.binary())
                    held.setdefault(lang, []).append(part)
                    n_held += part.nbytes
                    if n_held > COUNTED:
                        yield from done()
                        n_held = 0
        yield from done()

    return run


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, places of its bits that are set) as (block, bytes)."""
    for batch in it:
        block, out = batch.column(0), []
        for places in batch.column(1).to_pylist():
            bits = np.zeros(BLOCK, np.uint8)
            bits[places] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([block, pa.array(out, pa.binary())], names=["block", "bits"])


def filter_of(counts: DataFrame):
    """A broadcast bit field of BITS bits with those of all phrases of `counts` (lang, phrase) set."""
    bit = F.crc32(F.concat_ws(" ", "lang", "phrase")) % BITS
    blocks = counts.where("phrase IS NOT NULL").select((bit / BLOCK).cast("int").alias("block"), (bit % BLOCK).cast("int").alias("place"))
    packed = blocks.groupBy("block").agg(F.collect_set("place").alias("places")).mapInArrow(_packed, "block int, bits binary")
    bits = bytearray(BITS // 8)
    for block, part in packed.toLocalIterator():
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = part
    return counts.sparkSession.sparkContext.broadcast(bytes(bits))


def counted(texts: DataFrame, size: int, least: int, filters: list) -> DataFrame:
    """(lang, phrase, n) of phrases of `size` words with n >= least; texts has (lang, text). Of single words also (lang, null, n)."""
    each = texts.mapInArrow(released(_counted(size, filters)), "lang string, phrase string, n long")
    return materialize(each.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull()))


def stream(counts: DataFrame, order: list[str]) -> DataFrame:
    """counts (lang, w, n) as a stream sorted by lang and the words in `order`, each row with what the stream tells of its neighbours.

    `order` names the columns for the first, second and third word of the order; shorter phrases have nulls there, so
    each stands right before those it begins. `one` and `two` are the counts of the row's first word and first two
    words, the last such rows before it; `longer` is the largest count of the rows that a phrase of two begins.

    Rows are dealt out by ranges of the order. What a range needs from those before (one row of one and two words) and
    gives to those before (the rows that its first rows extend) is one row a range.
    """
    a, b, c = order
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(counts.repartitionByRange(n, "lang", *order).withColumn("range", F.spark_partition_id()))
    is_one, is_two = F.col(b).isNull(), F.col(b).isNotNull() & F.col(c).isNull()
    at = Window.partitionBy("range").orderBy("lang", *order)
    last = lambda when: F.last(F.when(when, F.col("n")), ignorenulls=True).over(at)
    group = Window.partitionBy("range", "lang", a, b)
    inside = dealt.select(
        "*",
        last(is_one).alias("one"),
        last(is_two).alias("two"),
        F.max(F.when(F.col(c).isNotNull(), F.col("n"))).over(group).alias("longer"),
        F.max(is_two).over(group).alias("begun"),
    )
    place = F.struct("lang", *order)
    ends = dealt.groupBy("range").agg(*(F.max_by(F.when(when, F.col("n")), F.when(when, place)).alias(name) for when, name in ((is_one, "one_before"), (is_two, "two_before"))))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", *(F.last(name, ignorenulls=True).over(before).alias(name) for name in ("one_before", "two_before")))
    # trigrams whose pair lies in an earlier range: at most the first group of each range
    back = inside.where(F.col(c).isNotNull() & ~F.col("begun")).groupBy("lang", a, b).agg(F.max("longer").alias("later"))
    whole = inside.join(F.broadcast(carried), "range").join(F.broadcast(back), ["lang", a, b], "left")
    told = [F.coalesce("one", "one_before").alias("one"), F.coalesce("two", "two_before").alias("two"), F.greatest("longer", "later").alias("longer")]
    return whole.select("lang", *order, "n", *told)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, scale: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two or three words of each lang of docs (lang, text).

    Texts have A-Z lower-cased and are split at `.,;:!?` and line ends into pieces, those at blanks and tabs into words. a,
    l and r are the occurrences of the phrase and of its two parts, n those of all words; the score is
    floor(scale * a * a / (l * r)) at the cut where that is least (of equal ones the earliest). Phrases have a >= least;
    those inside a longer one with at least `share` hundredths of their occurrences are left out. Null langs count as
    `und`, null and empty texts have no words, repeated rows count again; an empty table gives no rows; other columns
    of docs play no part.

    Every part of a phrase has its count or more, so words and pairs with less than `least` need not be kept. Pairs are
    counted of words that a filter knows as frequent, phrases of three of pairs that it knows; a filter has a fixed number
    of bits, never misses one, and what it lets in wrongly falls to the count.
    """
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    kept, filters = [], []
    for size in (1, 2, 3):
        kept.append(counted(texts, size, least, filters))
        if size < 3:
            filters.append(filter_of(kept[-1]))
    total = kept[0].where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    words = F.split("phrase", " ", -1)
    part = lambda k: F.get(words, F.lit(k))
    parts = [k.where("phrase IS NOT NULL") for k in kept]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    forward = stream(counts.select("lang", part(0).alias("w1"), part(1).alias("w2"), part(2).alias("w3"), "n"), ["w1", "w2", "w3"])
    backward = stream(counts.select("lang", F.element_at(words, -1).alias("v1"), F.get(F.reverse(words), F.lit(1)).alias("v2"), F.get(F.reverse(words), F.lit(2)).alias("v3"), "n"), ["v1", "v2", "v3"])
    left = forward.where("w2 IS NOT NULL").select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "n", "one", "two", "longer", F.col("w3").isNotNull().alias("three"))
    right = backward.where("v2 IS NOT NULL").select("lang", F.concat_ws(" ", "v3", "v2", "v1").alias("phrase"), F.col("one").alias("end_one"), F.col("two").alias("end_two"), F.col("longer").alias("end_longer"))
    both = left.hint("merge").join(right, ["lang", "phrase"])
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    cut = lambda k, l, r: F.struct(F.expr(f"(CAST({scale} AS DECIMAL(38,0)) * a * a) div ({l} * {r})").alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    numbers = both.select("lang", "phrase", "three", "longer", "end_longer", *(exact(x).alias(y) for x, y in (("n", "a"), ("one", "one"), ("two", "two"), ("end_one", "end_one"), ("end_two", "end_two"))))
    scored = numbers.select(
        "lang", "phrase", "a", F.when(F.col("three"), F.least(cut(1, "one", "end_two"), cut(2, "two", "end_one"))).otherwise(cut(1, "one", "end_one")).alias("cut"),
        F.greatest(F.coalesce("longer", F.lit(0)), F.coalesce("end_longer", F.lit(0))).alias("longer"), "three",
    ).where(~(~F.col("three") & (100 * F.col("longer") >= share * F.col("a"))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    long = lambda x, y: F.col(x).cast("long").alias(y)
    return best.join(F.broadcast(total), "lang").select("lang", long("rank", "rank"), "phrase", long("a", "a"), long("cut.l", "l"), long("cut.r", "r"), long("total", "n"), long("cut.score", "score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), each AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, range(1, 4) AS r(k) WHERE len(w) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n, string_split(phrase, ' ') AS w FROM each GROUP BY ALL
), total AS (
  SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang
), candidate AS MATERIALIZED (
  SELECT lang, k, phrase, n AS a, w FROM f WHERE k > 1 AND n >= 10
), parts AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
  FROM candidate, range(1, 3) AS s(cut) WHERE cut < k
), cuts AS (
  SELECT p.*, l.n AS l, r.n AS r, (1000000::HUGEINT * p.a * p.a) // (l.n::HUGEINT * r.n) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.head JOIN f r ON r.lang = p.lang AND r.phrase = p.tail
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidate WHERE k = 3
), dropped AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidate c JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE 100 * i.longer >= 50 * c.a
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       t.n::BIGINT AS n, score::BIGINT AS score
FROM least s JOIN total t ON s.lang = t.lang
WHERE NOT EXISTS (FROM dropped d WHERE d.lang = s.lang AND d.phrase = s.phrase)
QUALIFY rank <= 2000
"""
