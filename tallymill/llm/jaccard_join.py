"""Set similarity join of documents' word shingles by prefix filters under several global orders."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, released, row_key
from .components import components
from .simhash import SEED, _mix

#: Cells that all shingles are counted in for the orders: a table of this size, whatever the input, is broadcast (4 MB of levels).
CELLS = 1 << 22
#: Orders of which each must have a common prefix shingle: the first is joined on, the others are asked of a pair.
ORDERS = 3
#: Sets of a shard where a shingle is in many prefixes, and sets compared with one other set in a task.
SHARD, BESIDE = 2048, 1024
#: Nodes of a shingle from which a pair must pass the finer tables of odd codes too, and the largest sets that have one.
FINE, CODED = 64, 8192
#: Words of 64 bits in the filter that tells which texts are fetched: a table of at most this many rows, whatever the input, is broadcast.
WORDS = 1 << 19
#: Steps of a level while the load of a cell doubles.
STEPS = 8


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text in order, each as a 64-bit hash of its words' hashes; none if there is no word."""
    w = (text or "").encode().lower().split()
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, w, repeat(SEED))), ">u8").astype(np.uint64)
    size = min(words, len(h))
    if not size:
        return h
    factors = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k, f in enumerate(factors):
        total += h[k : k + len(total)] * f
    h = np.sort(_mix(total + np.uint64(size)))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def least_overlap(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """The smallest intersection of sets of a and b members at which 100 * intersection >= share * union."""
    return -(-share * (a + b) // (100 + share))


def prefix_size(n: int, share: int) -> int:
    """Members of the prefix of a set of n under any order: a set that is similar enough has one of them in its own prefix."""
    return n - -(-share * n // 100) + 1 if n else 0


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def _sets(words: int):
    """For mapInArrow over (struct (row, doc_id), text): a row of each text's set, then the task's rows (block, loads) of how many sets have a shingle in each cell."""
    names = ["row", "doc_id", "name", "size", "bits", "block", "loads"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def rows(columns: list) -> pa.RecordBatch:
        n = len(next(c for c in columns if c is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(CELLS, np.int64)
        for batch in it:
            name, size, bits = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text, words)
                np.add.at(loads, _cell(h), 1)  # distinct within a text
                name.append(set_name(h))
                size.append(len(h))
                bits.append(parity(h) if len(h) else b"")
            yield rows([*(batch.column(0).field(k).to_pylist() for k in (0, 1)), name, size, bits, None, None])
        for k, block in enumerate(loads.reshape(64, -1)):
            if block.any():
                yield rows([None] * 5 + [[k], [zstandard.compress(block.tobytes())]])

    return run, ", ".join(f"{c} {k}" for c, k in zip(names, ("string", "long", "binary", "long", "binary", "int", "binary")))


def _levels(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows (block, loads) of one block or several, each whole: (block, total, levels)."""
    sums: dict[int, np.ndarray] = {}
    for batch in it:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[block] = sums.get(block, 0) + np.frombuffer(zstandard.decompress(part.as_buffer()), np.int64)
    for block, loads in sums.items():
        level = np.minimum(255, STEPS * np.log2(1.0 + loads)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([int(loads.sum())], pa.int64()), pa.array([level.tobytes()], pa.binary())], names=["block", "total", "levels"])


def levels(loads: DataFrame) -> np.ndarray:
    """For each cell how frequent its shingles may be, from the counts (block, loads) of all texts; levels that chance around the mean explains are level.

    Any order is right; this one only has the most frequent shingles last, so that few prefixes hold them.
    """
    rows = loads.repartition(64, "block").mapInArrow(_levels, "block int, total long, levels binary").collect()
    out = np.zeros(CELLS, np.uint8)
    for r in rows:
        out[r.block * CELLS // 64 : (r.block + 1) * CELLS // 64] = np.frombuffer(r.levels, np.uint8)
    mean = sum(r.total for r in rows) / CELLS
    return np.maximum(out, np.uint8(min(255, STEPS * np.log2(1.0 + mean + 3 * mean**0.5 + 2))))


def ordered(h: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """The members of a set under a global order: by level, then by a hash that differs from order to order."""
    rank = h if order == 0 else _mix(h + np.uint64(order))
    return h[np.lexsort((rank, level[_cell(h)]))]


def parity(h: np.ndarray) -> bytes:
    """A bit for each cell of a table, about one for each member, set where an odd number of members fall.

    Sets differ in as many members as bits at least. A table of twice the size folds to the smaller one by XOR.
    """
    bits = max(64, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(tables: np.ndarray) -> np.ndarray:
    """Parity tables (rows of 64-bit words) of half the size."""
    half = tables.shape[-1] // 2
    return tables[..., :half] ^ tables[..., half:]


def odd_codes(h: np.ndarray) -> bytes:
    """A parity table of 2^16 cells as the sorted numbers of its odd ones: small beside its cells for sets up to CODED."""
    codes, n = np.unique(h.astype(np.uint16), return_counts=True)
    return codes[n % 2 == 1].tobytes()


def set_name(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _prefixes(words: int, share: int, level):
    """For mapInArrow over (text): (shingle, mark, head) of each shingle of the prefix under the first order, and of the first one under each order.

    A head is told by a hash of the shingle and the order, a set by the XXH64 of its name, which a shuffle carries at half the size.
    """

    def of_set(h: np.ndarray) -> np.ndarray:
        heads = [_mix(ordered(h, level.value, k)[:1] + np.uint64(k)) for k in range(ORDERS)]
        return np.concatenate([*heads, ordered(h, level.value, 0)[: prefix_size(len(h), share)]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in it:
            found = []
            for text in batch.column(0).to_pylist():
                h = shingle_set(text, words)
                name = set_name(h)
                if not len(h) or name in seen:  # copies in one task need not be told again
                    continue
                if len(seen) > 1 << 16:
                    seen.clear()
                seen.add(name)
                found.append((xxhash.xxh64_intdigest(name, SEED), of_set(h)))
            if found:
                shingles, marks = np.concatenate([x for _, x in found]), np.repeat(np.array([m for m, _ in found], np.uint64), [len(x) for _, x in found])
                head = np.concatenate([np.arange(len(x)) < ORDERS for _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(marks.view(np.int64)), pa.array(head)], names=["shingle", "mark", "head"])

    return run


class Forest:
    """Which labels have been joined."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x: object) -> object:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: object, b: object) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


class Bucket:
    """Sets with a common prefix shingle, as rows (known, node, label, size, bits, codes); their parity tables are kept by size."""

    def __init__(self, rows: list[tuple], share: int):
        self.rows, self.share = rows, share
        self.sizes = np.array([r[3] for r in rows])
        tables = [np.frombuffer(r[4], np.uint64) for r in rows]
        self.widths = np.array([len(t) for t in tables])
        self.of = {width: np.nonzero(self.widths == width)[0] for width in set(self.widths.tolist())}
        self.tables = {width: np.stack([tables[k] for k in at]) for width, at in self.of.items()}
        self.codes = [None if r[5] is None else np.frombuffer(r[5], np.uint16) for r in rows]
        self.odd = np.zeros(1 << 16, bool)

    def possible(self, k: int, upto: int) -> list[int]:
        """The rows before `upto` that size and parity let be similar to row k; sets that may be have tables within a factor of two."""
        size, width, out = self.sizes[k], int(self.widths[k]), []
        own = self.tables[width][np.searchsorted(self.of[width], k)]
        for other in (width // 2, width, 2 * width):
            if other in self.of:
                n = int(np.searchsorted(self.of[other], upto))
                theirs, mine = self.tables[other][:n], own
                if other > width:
                    theirs = folded(theirs)
                elif other < width:
                    mine = folded(mine)
                at = self.of[other][:n]
                both = self.sizes[at] + size
                enough = both - np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64) >= 2 * least_overlap(self.sizes[at], size, self.share)
                out.extend(at[enough].tolist())
        return sorted(out)

    def likely(self, k: int, at: list[int]) -> list[int]:
        """Those of the rows `at` that the odd codes let be similar to row k too; a set without codes is let through."""
        own = self.codes[k]
        tested = [] if own is None else [j for j in at if self.codes[j] is not None]
        if not tested:
            return at
        self.odd[own] = True
        ends = np.cumsum([0, *(len(self.codes[j]) for j in tested)])
        common = np.concatenate(([0], np.cumsum(self.odd[np.concatenate([self.codes[j] for j in tested])])))
        self.odd[own] = False
        both = self.sizes[tested] + self.sizes[k]
        apart = len(own) + np.diff(ends) - 2 * np.diff(common[ends])
        far = both - apart < 2 * least_overlap(self.sizes[tested], self.sizes[k], self.share)
        dropped = {j for j, x in zip(tested, far.tolist()) if x}
        return [j for j in at if j not in dropped]


def _bucket_pairs(rows: list[tuple], share: int, inner: bool, forest: bool) -> Iterator[tuple]:
    """Pairs of nodes of rows (known, node, label, size, bits, codes), known ones first, that may be similar and have other labels.

    Known rows are not compared with each other, the rest with itself only if `inner`. With `forest` only as many pairs come
    out as keep joined what all of them join.
    """
    bucket, joined, n_known = Bucket(rows, share), Forest(), sum(r[0] for r in rows)
    for k in range(n_known, len(rows)):
        apart = [j for j in bucket.possible(k, k if inner else n_known) if rows[j][2] != rows[k][2] and (not forest or joined.root(rows[j][2]) != joined.root(rows[k][2]))]
        for j in bucket.likely(k, apart):
            if not forest or joined.join(rows[j][2], rows[k][2]):
                yield rows[j][1], rows[k][1]


def _pairs(names: list[str], pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=names)


def _candidates(share: int):
    """For mapInArrow over rows (key, a, b, forest, known, node, label, size, bits, codes) in order of (key, a, b): pairs (u, v)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            out = []
            if len(rows) > 1:
                for pair in _bucket_pairs(sorted(rows, key=lambda r: (not r[0], r[1])), share, here[1] == 0, here[3]):
                    out.append(pair)
                    if len(out) > 10_000:
                        yield _pairs(["u", "v"], out)
                        out.clear()
            yield _pairs(["u", "v"], out)

        for batch in it:
            for *group, known, node, label, size, bits, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if group != here:
                    yield from done()
                    here, rows = group, []
                rows.append((known, node, label, size, bits, codes))
        yield from done()

    return run


def _coded(words: int):
    """For mapInArrow over (node, text): (node, codes)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            codes = [odd_codes(shingle_set(text, words)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["node", "codes"])

    return run


def similar(a: list[np.ndarray], b: list[np.ndarray], share: int) -> bool:
    """Whether two sets, each given as itself and its prefixes under the further orders, are similar: first all filters, then the sets."""
    if not all(np.isin(x, y).any() for x, y in zip(a[1:], b[1:])):
        return False
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return 100 * common >= share * (len(a[0]) + len(b[0]) - common)


def _verified(words: int, share: int, level):
    """For mapInArrow over rows (u, salt, v, text) in order of (u, salt, v), v being null in the row of u itself: the pairs that are similar."""

    def under_all(text: str) -> list[np.ndarray]:
        h = shingle_set(text, words)
        return [h, *(ordered(h, level.value, k)[: prefix_size(len(h), share)] for k in range(1, ORDERS))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in it:
            out = []
            for u, _, v, text in zip(*(c.to_pylist() for c in batch.columns)):
                if v is None:
                    hub = under_all(text)
                elif similar(hub, under_all(text), share):
                    out.append((u, v))
            yield _pairs(["u", "v"], out)

    return run


def _met(each: DataFrame, nodes: DataFrame) -> DataFrame:
    """(head, key, n, node, size) of `each` (shingle, mark, head): the nodes of each shingle that n nodes, several, have; shingles with the same nodes count once.

    All of a shingle is one shuffle, and what is left of it another one, which brings it to the nodes of its marks.
    """
    dealt = each.repartition("shingle")
    by_shingle = dealt.groupBy("shingle", "head")  # with head, so that both sides of the join read the same columns: one shuffle
    shared = by_shingle.agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last").select(F.col("shingle").alias("key"))
    met = dealt.join(shared, F.col("shingle") == F.col("key")).select("key", "mark", "head").distinct()
    of_key = Window.partitionBy("key")
    marks = [F.bit_xor(F.xxhash64("mark", F.lit(k))).over(of_key).alias(f"x{k}") for k in (1, 2)]
    met = met.select("mark", "head", F.count(F.lit(1)).over(of_key).alias("n"), *marks)
    met = met.select("mark", "head", "n", F.xxhash64("head", "n", "x1", "x2").alias("key")).repartition("mark").distinct()
    return materialize(met.join(nodes.select("mark", "node", "size"), "mark").select("head", "key", "n", "node", "size"))


def _own(met: DataFrame, label: DataFrame, share: int) -> DataFrame:
    """The rows of `met` (key, n, node, size) with the node's label, for the keys whose nodes have several, without nodes of a size that is similar to no other's."""
    named = met.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_key = Window.partitionBy("key")
    by_size = of_key.orderBy("size")
    near = [F.coalesce(100 * a >= share * b, F.lit(False)) for a, b in ((F.lag("size").over(by_size), F.col("size")), (F.col("size"), F.lead("size").over(by_size)))]
    several = F.min("label").over(of_key) != F.max("label").over(of_key)
    return materialize(named.withColumn("several", several).withColumn("near", near[0] | near[1]).where("several AND near").select("key", "n", "node", "size", "label"))


def _by_shards(own: DataFrame, shard: int, small: int) -> DataFrame:
    """Work of a round that joins what it can: the nodes of a key are dealt into shards, of which the first meets each other one.

    Where at most `small` nodes meet, all are compared with all.
    """
    shards = F.when(F.col("n") > small, F.ceil(F.col("n") / shard)).otherwise(1).cast("int")
    dealt = own.select("*", F.lit(0).alias("a"), shards.alias("shards"), F.pmod(F.xxhash64("node"), shards).cast("int").alias("b"), (F.col("n") > small).alias("forest"))
    one = dealt.where("shards > 1 AND b = 0").withColumn("b", F.explode(F.sequence(F.lit(1), F.col("shards") - 1)))
    return dealt.withColumn("known", F.lit(False)).unionByName(one.withColumn("known", F.lit(True)))


def _by_labels(own: DataFrame, shard: int) -> DataFrame:
    """Work of a round that compares all nodes of different labels: those outside the largest one of a key meet all others."""
    of_label = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = of_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    parts = lambda n: F.ceil(n / shard).cast("int")
    main = materialize(main.select("key", F.col("main.label").alias("main"), parts(F.col("main.n")).alias("m"), parts(F.col("n") - F.col("main.n")).alias("r")).where("r > 0"))
    part = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), "m")).otherwise(F.col("m") + F.pmod(F.xxhash64("node"), "r")).cast("int")
    dealt = own.join(main, "key").withColumn("part", part).withColumn("forest", F.lit(False))
    # each part of the rest meets all parts before it, those of the largest label first
    later = dealt.withColumn("a", F.col("part")).withColumn("b", F.explode(F.filter(F.sequence(F.col("m"), F.col("m") + F.col("r") - 1), lambda b: b > F.col("part"))))
    first = dealt.where("part >= m").withColumn("b", F.col("part")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("part") - 1)))
    return later.withColumn("known", F.lit(True)).unionByName(first.withColumn("known", F.lit(False)))


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` (row, ...) with the text of that row of docs.

    A filter of bits, of bounded size, is asked before texts are shuffled; what it lets through in error, the join drops.
    """
    word, at = F.expr(f"xxhash64(row) & {WORDS - 1}L"), "CAST(shiftright(xxhash64(row), 32) & 63 AS INT)"
    held = materialize(wanted.groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {at}))").alias("held")))
    read = docs.select(row_key(docs).alias("row"), docs["text"].cast("string").alias("text"))
    some = read.join(F.broadcast(held), word == F.col("word")).where(F.expr(f"getbit(held, {at}) = 1")).select("row", "text")
    return some.dropDuplicates(["row"]).join(wanted, "row")


def links(nodes: DataFrame, docs: DataFrame, words: int, share: int, level, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(pairs of similar nodes, labels (node, label) of what they join) of `nodes` (node, mark, row, size, bits); they join all that are similar.

    Nodes meet that have a shingle in both prefixes under the first order, and of these what size and parity leave possible
    is verified; where over FINE nodes meet, odd codes must leave it possible too. Three rounds keep the work on large groups of near copies in proportion to their size: nodes with
    the same first shingle under some order come first, and only as many pairs as could join them are verified; so
    are, in the second round, those of the prefixes' shingles whose nodes are not joined by then. The third takes
    all possible pairs of nodes that are still not joined. Where few nodes meet the second round already takes all possible pairs.
    """
    each = materialize(docs.select(docs["text"].cast("string").alias("text")).mapInArrow(released(_prefixes(words, share, level)), "shingle long, mark long, head boolean"))
    met, small = _met(each, nodes), min(FINE, shard)
    crowd = met.where(F.col("n") > FINE).select("node").distinct().join(nodes.where(F.col("size") <= CODED).select("node", "row"), "node")
    codes = materialize(fetched(docs, materialize(crowd)).select("node", "text").mapInArrow(released(_coded(words)), "node long, codes binary"))

    def compared(work: DataFrame) -> DataFrame:
        full = work.join(nodes.select("node", "bits"), "node").join(codes, "node", "left").withColumn("codes", F.when(F.col("n") > FINE, F.col("codes")))
        rows = full.select("key", "a", "b", "forest", "known", "node", "label", "size", "bits", "codes").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
        pairs = materialize(rows.mapInArrow(released(_candidates(share)), "u long, v long").distinct())
        salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / BESIDE).cast("int").alias("salts"))
        beside = pairs.join(salts, "u").select("u", F.pmod(F.xxhash64("v"), "salts").cast("int").alias("salt"), "v", F.col("v").alias("node"))
        hubs = salts.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), F.col("u").alias("node"))
        wanted = materialize(hubs.unionByName(beside).join(nodes.select("node", "row"), "node").drop("node"))
        both = fetched(docs, wanted).select("u", "salt", "v", "text").repartition("u", "salt").sortWithinPartitions("u", "salt", "v")  # null comes first
        return materialize(both.mapInArrow(released(_verified(words, share, level)), "u long, v long"))

    label = nodes.select("node", F.col("node").alias("label")).where(F.lit(False))
    heads, prefixes = met.where("head"), met.where("NOT head")
    found = compared(_by_shards(_own(heads, label, share), shard, 1))
    label = components(found)
    found = found.unionByName(compared(_by_shards(_own(prefixes, label, share), shard, small)))
    label = components(found)
    found = found.unionByName(compared(_by_labels(_own(prefixes.where(F.col("n") > small), label, share), shard)))
    return found, components(found)


def joined(docs: DataFrame, words: int = 5, share: int = 80, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    A text's set has its distinct shingles of `words` words, A-Z lower-cased (with fewer words the whole sequence is the one
    shingle). Two texts are linked if 100 * intersection >= share * union; component_id is the least doc_id that links
    reach. Null, empty and blank texts have no shingle and are linked with nothing. Null ids take part, but are no component_id
    unless the component has nothing else; repeated rows give a row each; an empty table gives none; other columns
    of docs play no part. Shingles are compared by 64 bits of their words' XXH64 and sets named by 128 bits.
    """
    read = docs.select(F.struct(row_key(docs).alias("row"), docs["doc_id"].cast("long").alias("id")), docs["text"].cast("string"))
    run, schema = _sets(words)
    rows = materialize(read.mapInArrow(released(run), schema))
    each = rows.where("block IS NULL").select("row", "doc_id", "name", "size", "bits")
    nodes = each.where("size > 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    nodes = materialize(nodes.select("*", F.xxhash64("name").alias("mark"), F.monotonically_increasing_id().alias("node")))
    level = docs.sparkSession.sparkContext.broadcast(levels(rows.where("block IS NOT NULL").select("block", "loads")))
    _, label = links(nodes, docs, words, share, level, shard)
    named = nodes.select("name", "node", "least").join(label, "node", "left").select("name", "least", F.coalesce("label", "node").alias("label"))
    component = materialize(named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("name", "component_id"))
    out = each.select("doc_id", "name", F.col("size").alias("n_shingles")).join(component, "name", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0
), each AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  WITH RECURSIVE r(doc_id, other) AS (
    SELECT u, v FROM links UNION SELECT r.doc_id, l.v FROM r JOIN links l ON r.other = l.u
  )
  SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN reached r ON d.doc_id = r.doc_id
"""
