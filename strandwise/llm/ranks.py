"""Numbers of rows within their key, where no task may hold a key whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.llm.common import stored


def field(column: Column) -> Column:
    """A value as text that shows where it ends: ``-`` if null, else its count of UTF-8 bytes, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered_parts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds to ordered rows: _at, the number within the key in this part; _head, whether the key is the part's first; _row, the number in the part."""
    last, at, head, done = None, 0, True, 0
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        keys, index = batch.column("_key"), np.arange(n)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is not None and keys[0].as_py() != last
        begins = np.maximum.accumulate(np.where(new, index, -1))
        ranks = np.where(begins < 0, at + index, index - begins)
        heads = (begins < 0) & head
        last, at, head = keys[-1].as_py(), int(ranks[-1]) + 1, bool(heads[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64()), pa.array(heads), pa.array(done + index)], names)
        done += n


def part_bases(parts: list[tuple]) -> list[tuple[int, int]]:
    """For each part, in order, how many rows of its first key stand in earlier parts.

    parts: part, first key, rows of the first key, last key, rows of the last key.
    """
    bases, last, carried = [], None, 0
    for part, first_key, first_n, last_key, last_n in sorted(parts):
        base = carried if first_key == last else 0
        bases.append((part, base))
        last, carried = last_key, base + first_n if last_key == first_key else last_n
    return bases


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank", ordered: DataFrame | None = None) -> DataFrame:
    """``rows`` with a column ``name``: each row's number from 0 among the rows of equal ``keys``, by ``order``, nulls first.

    Rows are range-sorted by keys and order; each part numbers its own rows, and the first key of each part (only that one
    can have begun earlier) is moved up by what earlier parts hold: a table with a row for each part.  So a key with most
    rows is spread as any other.  ``rows`` should be a stored table, as sorting samples it; where ``order`` leaves ties, equal
    rows may come in any order, and rows that are equal in all of it share a part: end it with a unique column.

    ordered: the rows, where they are range-partitioned and sorted already.
    """
    spark = rows.sparkSession
    if ordered is None:
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartitionByRange(n_parts, *keys, *order).sortWithinPartitions(*keys, *order)
    ordered = ordered.withColumns({"_key": F.concat(F.lit(""), *[field(F.col(k)) for k in keys]), "_part": F.spark_partition_id()})
    added = [T.StructField("_at", T.LongType()), T.StructField("_head", T.BooleanType()), T.StructField("_row", T.LongType())]
    schema = T.StructType([*ordered.schema.fields, *added])
    names = schema.names
    local = stored(ordered.mapInArrow(lambda batches: numbered_parts(batches, names), schema), "ranks")
    key, n_head = F.md5("_key"), F.count(F.when(F.col("_head"), 1))
    ends = local.groupBy("_part").agg(F.min_by(key, "_row"), n_head, F.max_by(key, "_row"), F.max_by(F.col("_at") + 1, "_row"))
    bases = spark.createDataFrame(part_bases([tuple(r) for r in ends.collect()]), "_part int, _base long")  # a row for each part
    at = (F.col("_at") + F.when(F.col("_head"), F.col("_base")).otherwise(0)).alias(name)
    return local.join(F.broadcast(bases), "_part").select(*rows.columns, at)
