"""Token ids in files of compressed planes, with an index of their chunks."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .bpe import SPACE

#: Ids of a block, which is transposed as one; a chunk is closed at the end of the document that fills a block.
BLOCK = 1 << 16
#: Chunks of text whose ids a worker keeps; a full table starts anew.
TABLE = 1_500_000
MAGIC, HEADER = b"IDPLANE1", struct.Struct("<8sIQ?")
#: Latin letters, and a piece that is one word of them with ASCII signs after it: the usual pattern cuts it just there.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD_AND_SIGNS = re.compile(rf"(\n?)([{LATIN}]+)([!-/:-@\[-`{{-~]*)")


class Pieces(dict):
    """The ids of each piece of text asked for so far, as 32-bit unsigned integers; None for one that can't stand alone.

    A piece follows a space, or begins with the line end before it. One of a Latin word and signs goes to the
    library's model at once, without its splitting of texts.
    """

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.library = library
        spec = json.loads(library.to_str())
        cut = spec["pre_tokenizer"] or {}
        self.usual = not spec["normalizer"] and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {ord(c): shown(c)[0][0] for c in map(chr, range(0x250)) if re.match(f"[{LATIN}]", c)}
        self.signs = {"": b""}
        self.space = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        if self.usual and (m := WORD_AND_SIGNS.fullmatch(piece)):
            line, word, signs = m.groups()
            if signs not in self.signs:
                self.signs[signs] = self.whole(signs)
            ids = [t.id for t in self.library.model.tokenize(("" if line else "\u0120") + word.translate(self.letters))]
            data = (self.newline if line else b"") + struct.pack(f"={len(ids)}I", *ids) + self.signs[signs]
        else:
            body = piece.removeprefix("\n")
            if not body or body[0] in self.space or body[-1] in self.space:
                data = None
            else:
                data = self.whole(" " + piece) if body is piece else self.newline + self.whole(body)
        self[piece] = data
        return data

    def clear(self) -> None:
        super().clear()
        self.signs = {"": b""}


class Encoder:
    """The tokenizers library, asked once for each distinct piece of text between single spaces and line ends.

    In a byte-level file with the usual pattern, a space between two characters that are no white space always
    starts a word and such a line end is one, so the library gives the same ids for the pieces as for the text.
    Texts with other white space, or with added tokens, are encoded by it as they are.
    """

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        added = [t.content for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = Pieces(library)

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit unsigned integers."""
        if not text:
            return b""
        table = self.pieces
        if self.special is None or not self.special.search(text):
            if len(table) > TABLE:
                table.clear()
            found = list(map(table.__getitem__, ("\n" + text.replace("\n", " \n")).split(" ")))
            try:
                return b"".join(found)[len(table.newline) :]
            except TypeError:  # a piece that can't stand alone
                pass
        return table.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def pack(ids: np.ndarray, block: int = BLOCK, bits: bool = False) -> bytes:
    """Blocks of `block` ids, each as 4 byte planes (or 32 bit planes), each plane a zstandard frame after its length."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    out = [HEADER.pack(MAGIC, block, len(ids), bits)]
    for at in range(0, len(ids), block):
        raw = ids[at : at + block].astype("<u4").view(np.uint8).reshape(-1, 4)
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(raw.T)
        for plane in planes:
            frame = squeeze(plane.tobytes())
            out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    magic, block, total, bits = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a chunk of id planes")
    expand, at, out = zstandard.ZstdDecompressor().decompress, HEADER.size, [np.zeros(0, np.uint32)]
    for start in range(0, total, block):
        n, planes = min(block, total - start), []
        for _ in range(32 if bits else 4):
            (size,) = struct.unpack_from("<I", data, at)
            planes.append(np.frombuffer(expand(data[at + 4 : at + 4 + size]), np.uint8))
            at += 4 + size
        raw = np.stack(planes)
        raw = np.packbits(np.unpackbits(raw, axis=1, count=n).T, axis=1, bitorder="little") if bits else raw.T
        out.append(np.ascontiguousarray(raw).view("<u4").reshape(-1))
    return np.concatenate(out)


CHUNK = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])
CHUNK_DDL = "part int, chunk int, docs array<long>, sizes array<long>, n_ids long, payload binary"


def _chunks(path: str, end: int, block: int, bits: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, part, chunk = np.uint32(end).tobytes(), TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def close():
            data = np.frombuffer(b"".join(held), np.uint32)
            row = (part, chunk, docs, [len(x) // 4 for x in held], len(data), pack(data, block, bits))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, CHUNK)], schema=CHUNK)

        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in zip(ids, texts):
                data = encoder(path).encode(text or "")
                docs.append(i)
                held.append(data + tail)
                size += len(data) // 4 + 1
                if size >= block:
                    yield close()
                    docs, held, size, chunk = [], [], 0, chunk + 1
        if docs:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 2, block: int = BLOCK, bits: bool = False) -> None:
    """Writes path/chunks and path/index: the ids of each text and `end` after it, in ascending order of doc_id (null first).

    Documents are dealt out by ranges of doc_id; a chunk holds whole documents. The index has for each chunk
    its part and number, its documents' first id and count, its size and how many ids stand before it.
    A null text is an empty one. Rows with the same doc_id all are written, in any order among them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(_chunks(tokenizer, end, block, bits), CHUNK_DDL).write.option("compression", "none").parquet(f"{path}/chunks")
    each = spark.read.parquet(f"{path}/chunks").select("part", "chunk", F.get("docs", F.lit(0)).alias("first_doc"), F.size("docs").alias("n_docs"), "n_ids")
    parts = each.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part, so one task can order them
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids")
    each.withColumn("inside", inside).join(before, "part").select("part", "chunk", "first_doc", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("start")).write.parquet(f"{path}/index")


def _documents(value: Callable, kind: pa.DataType):
    """For each document of each chunk: (part, chunk, doc_id, ids before it in the chunk, its number of ids, value(ids))."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, chunk, docs, sizes, _, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(payload)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                values = [value(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [[part] * len(docs), [chunk] * len(docs), docs, starts, sizes, values]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "chunk", "doc_id", "offset", "n_tokens", "value"])

    return run


def _read(spark: SparkSession, path: str, value: Callable, kind: pa.DataType, ddl: str, name: str) -> DataFrame:
    each = spark.read.parquet(f"{path}/chunks").select(*CHUNK.names).mapInArrow(_documents(value, kind), f"part int, chunk int, doc_id long, offset long, n_tokens long, value {ddl}")
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", F.col("start").alias("before"))
    return each.join(index, ["part", "chunk"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", F.col("value").alias(name))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) of each document of the files."""
    return _read(spark, path, np.ndarray.tolist, pa.list_(pa.int64()), "array<long>", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files; the ids count as little-endian 32-bit integers."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "long", "ids_crc32")
