"""Helpers shared by the training-data operators: shared tables, bounded bitmaps, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.sources import storage

#: Bits of a bitmap that is sent to every task: 2^26 bits are 8 MB, whatever the input's size.
BITMAP_BITS = 1 << 26
#: Text bytes that one numpy step works on; arrays of 8 bytes a character stay near 2 MB.
SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch that goes to Python; a longer row makes a batch of its own.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB: a task's buffers, in Spark and in Python, then don't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """storage.stored, with small batches for the readers of the table."""
    small_batches(df.sparkSession)
    return storage.stored(df, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bitmap_of(keys: DataFrame, *columns: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits in which each key sets one bit.

    Its size is fixed, so it may be broadcast.  Different keys may share a bit: a test for membership can
    say yes too often, never no, and its users only do some work more for that.
    """
    return bitmap_of_slots(keys.select(F.pmod(F.xxhash64(*columns), F.lit(bits)).alias("slot")), bits)


def bitmap_of_slots(slots: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """bitmap_of from the bits' numbers, a column slot."""
    rows = slots.groupBy((F.col("slot") / 63).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 63 as int))")).alias("bits")
    )
    words = np.zeros(bits // 63 + 1, np.int64)
    table = rows.toArrow()
    words[table["word"].to_numpy()] = table["bits"].to_numpy()
    return words


def within(df: DataFrame, bits, *columns: str) -> DataFrame:
    """Rows of ``df`` whose columns may be keys of a broadcast bitmap, made of ``xxhash64(*columns)`` in the same order."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column("_slot").to_numpy())))

    slots = df.withColumn("_slot", F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)))
    return slots.mapInArrow(pick, slots.schema).drop("_slot")


def in_bitmap(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of ``slots`` (pmod of xxhash64, made by Spark in the same way) have their bit set."""
    return (words[slots // 63] >> (slots % 63)) & 1 == 1


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``most`` text bytes; a longer text gets a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets at which they begin and end; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
