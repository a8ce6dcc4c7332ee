"""Near-duplicates by SimHash fingerprints and BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, free_name, materialize, released, row_key
from .components import components

SEED = 42
#: Rows of a shard tree; a bucket with more is cut into shards, each pair of which is a task's work.
SHARD = 4096
#: Shingles that are hashed at once.
PART = 1 << 15
#: Keys of a text where a similarity of shingles is asked for, and bits in which the fingerprints of such texts may differ.
KEYS, WIDE = 12, 24
#: Texts of a shard where texts are compared, and shingles that they have together.
TEXTS, SHINGLES = 2048, 1 << 20


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash value of a text, over XXH64 (seed 42) of its shingles.

    A-Z is lower-cased; shingles are `words` words joined by a space, repeats included. With fewer words
    the whole sequence is the one shingle, with none (null, empty or blank text) the value is zero. A long text is
    taken in parts, so that the shingles of one part are in memory.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    for at in range(0, total, PART):
        part = w[at : at + PART + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8)
        counts += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total).view(">u8")[0])


def signed(value: int) -> int:
    """The same 64 bits as Spark's long."""
    return value - 2**64 if value >> 63 else value


def fingerprint_table(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    fn = batches(lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(t, words)) for t in texts]}, schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fn, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def search(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            stack.extend(child for k, child in self.children[at].items() if d - radius <= k <= d + radius)

    def within(self, value: int, radius: int) -> list[int]:
        return list(self.search(value, radius))


def _shard_links(tree: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius, only as many as keep what they join joined: at most one less than the values."""
    bk, values = BKTree(), tree if probes is tree else tree + probes
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    if probes is not tree:
        for value in tree:
            bk.add(value)
    for i in range(0 if probes is tree else len(tree), len(values)):
        for j in bk.within(values[i], radius):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((values[i], values[j]))
        if probes is tree:
            bk.add(values[i])
    return links


def _links(radius: int):
    """For mapInArrow over rows (key, a, b, shard, fp) in order of (key, a, b): a shard tree for each key and pair of shards."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree, probes, out = None, [], [], []

        def done():
            if here is not None:
                out.extend(_shard_links(tree, tree if here[1] == here[2] else probes, radius))

        for batch in it:
            for *group, shard, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if group != here:
                    done()
                    here, tree, probes = group, [], []
                (tree if shard == here[1] else probes).append(fp & 0xFFFFFFFFFFFFFFFF)
            if len(out) > 10_000:
                yield _edges(out)
                out.clear()
        done()
        yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    signed = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["u", "v"])


def bucket_keys(fp: Column) -> Column:
    """16 keys of 28 bits: two values that differ in 3 bits at most have one in common.

    One of four 16-bit blocks must be equal, and of the 48 bits besides it one of four 12-bit blocks.
    """
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * i) - 1)
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.lit((4 * i + j) << 28).cast("long") + F.shiftleft(block, 12) + part)
    return F.array(*keys)


def near_links(values: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(u, v): links between distinct fingerprints of `values` (fp) that join all that lie within the radius (3 at most).

    The trees are shards of a table keyed by 28 bits (see bucket_keys), so no task searches all of them.
    A key with over `shard` values is cut into shards by a hash; each pair of shards is one piece of work.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the keys find all links up to radius 3 only")
    keyed = values.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    # a table of its own, so that the join's stage has no aggregation and AQE can split the partition of a hot key
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    keyed = keyed.join(sizes, "key")
    shards = F.ceil(F.col("n") / shard).cast("int")
    own = keyed.select("key", "fp", shards.alias("shards"), F.pmod(F.xxhash64("fp"), shards).cast("int").alias("shard"))
    work = own.select("key", "fp", "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    work = work.select("key", F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b"), "shard", "fp")
    return work.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(released(_links(radius)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text, ...).

    Two texts are linked where their fingerprints differ in `radius` bits at most; component_id is the
    smallest doc_id that links reach. Texts without a word have fingerprint zero and are linked like any
    others; null ids take part, but are no component_id unless the component has nothing else. Repeated rows
    give a row each; an empty table gives none; other columns of docs play no part.
    """
    each = materialize(fingerprint_table(docs, words))
    values = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(near_links(values.select("fp"), radius))
    named = values.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    out = each.join(named.join(least, "label").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 values (seed 42), in order, of the shingles that fingerprints() counts; none if there is no word."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), ">u8").astype(np.uint64))


def sketch(text: str | None, words: int, n: int) -> tuple[bytes, int, int, list[int]]:
    """(128-bit name of the set of shingles, its size, its SimHash, KEYS keys of its n least hashes); numbers are signed."""
    h = shingle_set(text, words)
    if not len(h):
        return bytes(16), 0, 0, []
    bits, least = np.zeros(64, np.int64), np.full(KEYS * n, 2**64 - 1, np.uint64)
    factors = _mix(np.arange(1, KEYS * n + 1, dtype=np.uint64)) | np.uint64(1)
    for at in range(0, len(h), 1 << 12):
        part = h[at : at + (1 << 12)]
        bits += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        least = np.minimum(least, (part[:, None] * factors).min(axis=0))
    fp = int(np.packbits(2 * bits > len(h)).view(">i8")[0])
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(KEYS, n))]
    return xxhash.xxh3_128_digest(h.tobytes()), len(h), fp, np.array(keys, np.uint64).view(np.int64).tolist()


def _mix(h: np.ndarray) -> np.ndarray:
    """Another 64-bit hash from one."""
    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Overlaps:
    """How many members each of some sets has in common with all of them, from one list of who holds each member."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        self.ends = self.sizes.cumsum()
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.codes = codes
        order = np.argsort(codes, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.starts = np.searchsorted(codes[order], np.arange(codes.max(initial=-1) + 2))

    def of(self, k: int) -> np.ndarray:
        mine = self.codes[self.ends[k] - self.sizes[k] : self.ends[k]]
        first, n = self.starts[mine], self.starts[mine + 1] - self.starts[mine]
        at = np.repeat(first - n.cumsum() + n, n) + np.arange(n.sum())
        return np.bincount(self.holders[at], minlength=len(self.sizes))


def _similar_links(rows: list[tuple], words: int, radius: int, share: float) -> list[tuple[bytes, bytes]]:
    """Links between rows (known, fp, node, label, text) of at least that similarity, as many as join what such links join.

    Rows that are known are not compared with each other, and rows with the same label are taken as joined. A
    row's candidates come from the BK-tree of the rows before it; they are compared by their shingles.
    """
    rows = sorted(rows, key=lambda r: not r[0])
    shared = Overlaps([shingle_set(r[4], words) for r in rows])
    parent: dict = {}

    def root(x: object) -> object:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, holds, links = BKTree(), {}, []
    for k, (known, fp, node, label, _) in enumerate(rows):
        if not known:
            others = [j for at in tree.search(fp, radius) for j in holds[tree.values[at]] if root(rows[j][3]) != root(label)]
            both = shared.of(k) if others else ()
            for j in others:
                if root(rows[j][3]) != root(label) and both[j] / (shared.sizes[j] + shared.sizes[k] - both[j]) >= share:
                    parent[root(rows[j][3])] = root(label)
                    links.append((rows[j][2], node))
        if fp not in holds:
            tree.add(fp)
        holds.setdefault(fp, []).append(k)
    return links


def _similar(words: int, radius: int, share: float):
    """For mapInArrow over rows (key, a, b, known, fp, node, label, text) in order of (key, a, b)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []

        def done() -> pa.RecordBatch:
            pairs = _similar_links(rows, words, radius, share) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["u", "v"])

        for batch in it:
            for *group, known, fp, node, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if group != here:
                    yield done()
                    here, rows = group, []
                rows.append((known, fp & 0xFFFFFFFFFFFFFFFF, node, label, text))
        yield done()

    return run


def similar_links(texts: DataFrame, docs: DataFrame, words: int, share: float, radius: int = WIDE, shard: int = TEXTS) -> DataFrame:
    """(u, v): links that join all nodes of `texts` (node, row, size, fp, keys) whose shingles' similarity is at least `share`.

    The trees are of the nodes with one key, of least hashes, which texts of that similarity share in one of KEYS cases
    or more; what is within `radius` there is compared shingle by shingle. Keys with the same nodes count once. `row`
    is the row_key in docs of a text of the node.

    The nodes of a large key are dealt into shards, of which one meets every other. What that has not joined to the
    key's largest component (the rest) meets all others in a second round, so the work on a large group of copies that
    are mostly joined grows with its size and not with its square.
    """
    keyed = texts.select("node", "size", F.explode("keys").alias("key"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), *marks)
    shards = F.ceil(F.greatest(F.col("n") / shard, F.col("size") / SHINGLES)).cast("int")
    keys = materialize(sizes.where("n > 1").groupBy("n", "size", "x1", "x2").agg(F.min("key").alias("key")).select("key", shards.alias("shards")))
    own = materialize(keyed.drop("size").join(keys, "key"))
    needed = own.select("node").distinct().join(texts.select("node", "row", "fp"), "node")
    read = docs.select(row_key(docs).alias("row"), docs["text"].cast("string").alias("text"))
    wanted = materialize(read.join(needed, "row").dropDuplicates(["node"]).select("node", "fp", "text"))

    def compared(work: DataFrame) -> DataFrame:
        rows = work.join(wanted, "node").select("key", "a", "b", "known", "fp", "node", "label", "text")
        return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(released(_similar(words, radius, share)), "u binary, v binary").distinct()

    dealt = own.select("key", "node", "shards", F.pmod(F.xxhash64("node"), "shards").cast("int").alias("b"))
    one = dealt.where("shards > 1 AND b = 0").withColumn("b", F.explode(F.sequence(F.lit(1), F.col("shards") - 1)))
    both = dealt.withColumn("known", F.lit(False)).unionByName(one.withColumn("known", F.lit(True)))
    links = materialize(compared(both.select("key", F.lit(0).alias("a"), "b", "known", "node", F.col("node").alias("label"))))
    large = own.where("shards > 1")
    if large.isEmpty():
        return links
    named = materialize(large.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")))
    each = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.first("shards").alias("shards"))
    main = each.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.first("shards").alias("shards")).where("n > main.n")
    share_of = lambda n: F.ceil(F.col("shards") * n / F.col("n")).cast("int")
    main = materialize(main.select("key", F.col("main.label").alias("main"), share_of(F.col("main.n")).alias("m"), share_of(F.col("n") - F.col("main.n")).alias("r")))
    part = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), "m")).otherwise(F.col("m") + F.pmod(F.xxhash64("node"), "r")).cast("int")
    parts = named.select("key", "node", "label").join(main, "key").withColumn("part", part)
    # a part of the rest meets all parts before it, those of the largest component first
    after = F.filter(F.sequence(F.col("m"), F.col("m") + F.col("r") - 1), lambda b: b > F.col("part"))
    later = parts.withColumn("b", F.explode(after)).withColumn("a", F.col("part")).withColumn("known", F.lit(True))
    first = parts.where("part >= m").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).withColumn("b", F.col("part")).withColumn("known", F.lit(False))
    columns = ["key", "a", "b", "known", "node", "label"]
    return links.unionByName(materialize(compared(later.select(columns).unionByName(first.select(columns)))))


def keep_one(docs: DataFrame, words: int = 5, n: int = 3, share: float = 0.8, shard: int = TEXTS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays (null is last).

    Texts are linked whose sets of `words`-word shingles have a similarity (Jaccard) of at least `share`; see
    similar_links, whose keys are of n least hashes each. Columns and rows that stay are unchanged. Texts without a
    word are alike. Null and repeated ids are no links; rows that repeat an id and a text keep one of them.
    """
    kinds = {"row": (pa.string(), "string"), "id": (pa.int64(), "long"), "node": (pa.binary(), "binary"), "size": (pa.int64(), "long"), "fp": (pa.int64(), "long"), "keys": (pa.list_(pa.int64()), "array<long>")}

    def fn(rows: pa.StructArray, texts: list) -> dict:
        node, size, fp, keys = zip(*(sketch(t, words, n) for t in texts))
        return {"row": rows.field(0), "id": rows.field(1), "node": node, "size": size, "fp": fp, "keys": keys}

    read = docs.select(F.struct(row_key(docs).alias("row"), docs["doc_id"].cast("long").alias("id")), docs["text"].cast("string"))
    each = materialize(read.mapInArrow(batches(fn, pa.schema([(c, k) for c, (k, _) in kinds.items()])), ", ".join(f"{c} {k}" for c, (_, k) in kinds.items())))
    of_node = [F.first(c).alias(c) for c in ("size", "fp", "keys")]  # the same in all of its rows
    rows = each.groupBy("node", "row", "id").agg(F.count(F.lit(1)).alias("copies"), *of_node)
    # null ids last
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "copies")).alias("least")
    texts = materialize(rows.groupBy("node").agg(least, *of_node))
    links = similar_links(texts.select("node", F.col("least.row").alias("row"), "size", "fp", "keys"), docs, words, share, shard=shard)
    named = texts.select("node", "least").join(components(links), "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("least").alias("least"))
    row, stays = free_name(docs, "__row"), free_name(docs, "__stays")
    keep = materialize(named.select(F.col("least.row").alias(stays), F.col("least.copies").alias("copies")))
    once, more = (keep.where(f"copies {op} 1").select(stays) for op in ("=", ">"))
    keyed = docs.withColumn(row, row_key(docs))
    out = keyed.join(once, F.col(row) == F.col(stays), "left_semi")
    if not more.isEmpty():
        out = out.unionByName(keyed.join(more, F.col(row) == F.col(stays), "left_semi").dropDuplicates([row]))
    return out.drop(row)
