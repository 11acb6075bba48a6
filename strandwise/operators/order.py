"""File order without one task that holds it: the first rows, row numbers, sums in a fixed order, and records that keep contigs' order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.sources.storage import stored

#: Rows that one task may put in order, and ranges that a count is made of.
ONE_TASK, RANGES = 1 << 16, 1 << 12
#: Bytes of rows, as Spark reckons them, that go to one task of near(), and the most that is taken for a reckoning at all.
SHARE, KNOWN = 1 << 22, 1 << 50
#: Values that are summed together, as a piece of the tree of sums.
PIECE = 1 << 16


def first_rows(rows: DataFrame, n: int | None, key: str = "rid") -> DataFrame:
    """The first n rows by a whole number ``key`` (nulls first); all if n is None or there are no more.

    Counts of key ranges tell in which range the n-th row lies; that range is counted again in finer ranges until one task can order
    what is left of it.  So nothing is ordered but a last range of ONE_TASK rows, and of rows that share a key there any may be
    left out.  Counts are made while the query is made: a few jobs over the key alone.
    """
    if n is None:
        return rows
    if n <= RANGES:
        return rows.orderBy(key).limit(n)
    keys = rows.select(F.col(key).cast("long").alias("k"))
    low, high, total, nulls = keys.agg(F.min("k"), F.max("k"), F.count("*"), F.count_if(F.col("k").isNull())).first()
    if total <= n:
        return rows
    if nulls >= n:
        return rows.where(F.col(key).isNull()).limit(n)
    left, size = n - nulls, total - nulls  # of the rows from low to high, so many are wanted
    while size > ONE_TASK and high > low:
        step = (high - low) // RANGES + 1
        counts = keys.where((F.col("k") >= low) & (F.col("k") <= high)).groupBy(F.expr(f"(k - {low}L) div {step}L").alias("r")).count().collect()
        for r, size in sorted(map(tuple, counts)):
            if size >= left:
                low, high = low + r * step, min(high, low + (r + 1) * step - 1)
                break
            left -= size
    last = keys.where((F.col("k") >= low) & (F.col("k") <= high)).orderBy("k").limit(left) if high > low else keys.where(F.col("k") == low)
    cut = last.agg(F.max("k")).first()[0]
    before = F.col(key).isNull() | (F.col(key) < cut)
    return rows.where(before).unionByName(rows.where(F.col(key) == cut).limit(n - rows.where(before).count()))


def numbered_rows(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their number from 0 by ``order``, which should tell rows apart: sorted in ranges, which are counted."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    return placed.join(F.broadcast(parts), "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name))


def near(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, in so many tasks that none holds more of a larger input."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = size // SHARE + 1 if size < KNOWN else 0
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def _piece(n: int) -> Column:
    """Where the piece of the sum tree over n values begins that holds a row's number: halves, the first in whole eights, until PIECE or fewer are left."""
    depth = max(0, (n - 1).bit_length() - PIECE.bit_length() + 3)
    half = "(s.n div 2 - s.n div 2 % 8)"
    step = f"if(s.n <= {PIECE}, s, if(number < s.at + {half}, named_struct('at', s.at, 'n', {half}), named_struct('at', s.at + {half}, 'n', s.n - {half})))"
    return F.expr(f"aggregate(sequence(0, {depth}), named_struct('at', 0L, 'n', {n}L), (s, i) -> {step}, s -> s.at)")


def _tree_sum(numbered: DataFrame, n: int) -> float:
    """The sum of ``value`` by number 0 to n - 1 in numpy's order for one array of them all."""

    def run(piece: pa.Table) -> pa.Table:
        values = piece["value"].to_numpy()[np.argsort(piece["number"].to_numpy())]
        return pa.table({"at": pa.array([piece["at"][0].as_py()]), "sum": pa.array([float(np.add.reduce(np.ascontiguousarray(values)))])})

    pieces = numbered.select("number", "value", _piece(n).alias("at")).groupBy("at").applyInArrow(run, "at long, sum double")
    sums = {r["at"]: r["sum"] for r in pieces.collect()}  # one for each PIECE / 2 values at least

    def total(at: int, n: int) -> float:
        if n <= PIECE:
            return sums[at]
        half = n // 2 - n // 2 % 8
        return total(at, half) + total(at + half, n - half)

    return total(0, n) if n else 0.0


def ordered_mean_std(rows: DataFrame, value: str, order: list[str], ddof: int = 0) -> tuple[float, float]:
    """Mean and standard deviation of a column, to the last bit as numpy gives them for the values in this order, however rows are dealt."""
    numbered = stored(numbered_rows(rows.select(F.col(value).cast("double").alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), [f"_o{i}" for i in range(len(order))]), "ordered")
    n = numbered.count()
    if n <= ddof:
        return (_tree_sum(numbered, n) / n if n else float("nan")), float("nan")
    mean = _tree_sum(numbered, n) / n
    far = F.col("value") - F.lit(mean)
    return mean, float(np.sqrt(_tree_sum(numbered.select("number", (far * far).alias("value")), n) / (n - ddof)))


def before_break(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reads before the first that breaks the contigs' order; that one and all after it go.  contigs: ref_id, chrom.

    A read breaks it if it has no contig, or if an earlier read has a later contig: for each contig the first rid of the later ones
    tells where.  So two small aggregates find the place, and nothing is put in order.
    """
    listed = F.broadcast(contigs.select("ref_id", "chrom"))  # a header's contigs
    placed = reads.select("rid", "chrom").join(listed, "chrom", "left")
    firsts = placed.where("ref_id is not null").groupBy("ref_id").agg(F.min("rid").alias("first"))
    later = F.min("first").over(W.orderBy(F.desc("ref_id")).rowsBetween(W.unboundedPreceding, -1))
    bounds = firsts.select("ref_id", later.alias("bound"))  # a row for each contig
    ends = placed.join(F.broadcast(bounds), "ref_id", "left").where("ref_id is null or rid > bound").agg(F.min("rid").alias("_end"))
    return reads.crossJoin(F.broadcast(ends)).where("_end is null or rid < _end").drop("_end")  # one row


__all__ = ["before_break", "first_rows", "near", "numbered_rows", "ordered_mean_std"]
