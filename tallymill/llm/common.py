"""Shared pieces of the text operators: reading, scratch tables, word rules and the training split."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import scratch_path

#: The rule for words in several operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder: it cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame) -> Column:
    """A key of 128 bits for each row of docs, of its id and text: ids may be null or stand for several texts."""
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), docs["doc_id"].cast("long"), docs["text"].cast("string"))), 16, "0")
    return F.concat(half(1), half(2))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it while df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as a training row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def batches(fn: Callable[[list, list], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text): fn gets the ids and texts of a batch and returns columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch.column(0), batch.column(1).to_pylist()), schema=schema)

    return released(run)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, but a worker gives back to the system what memory is free when its task ends: workers are kept for other stages."""

    def inner(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return inner
