"""Arithmetic of signal tracks: rows chrom, start, end, value; positions without a row are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.operators.intervals import BIN, as_right, merge, overlap_join

OPERATIONS = ("Add", "Subtract", "Product", "Average", "geometricMean", "Max", "Min")


def track_sum(track: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One row, total: value times bases over all positions, or those of the merged regions; NaN is passed over."""
    rows = track.where(~F.isnan("value"))
    if regions is not None:
        rows = overlap_join(rows, as_right(merge(regions))).withColumns({"start": F.greatest("start", "r_start"), "end": F.least("end", "r_end")})
    return rows.agg(F.coalesce(F.sum(F.col("value").cast("double") * (F.col("end") - F.col("start"))), F.lit(0.0)).alias("total"))


def normalize_track(track: DataFrame, target: float = 1e8, chunk: int = 500_000, regions: DataFrame | None = None) -> DataFrame:
    """chrom, start, end, value scaled to the target sum, zeros left out; equal neighbours join inside a chunk only."""
    if target <= 0 or chunk <= 0:
        raise ValueError("the target sum and the chunk size must be above zero")
    total = track_sum(track, regions)
    rows = track.where(~F.isnan("value") & (F.col("value") != 0)).crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    rows = rows.select("chrom", "chunk", F.greatest("start", F.col("chunk") * chunk).alias("start"), F.least("end", (F.col("chunk") + 1) * chunk).alias("end"), (F.col("value").cast("double") * F.lit(float(target)) / F.col("total")).alias("value"))
    line = W.partitionBy("chrom", "chunk").orderBy("start")
    new = (F.lag("end").over(line) != F.col("start")) | (F.lag("value").over(line) != F.col("value"))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("chrom", "chunk", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).select("chrom", "start", "end", "value")


def segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, start, end, x, y: both tracks on common breakpoints, 0 where one is missing.

    Rows are cut at bins first, so breakpoints are ordered inside a bin and no contig meets in one task.
    """
    def cut(t: DataFrame, side: int) -> DataFrame:
        rows = t.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))))
        value = F.when(F.isnan("value"), 0.0).otherwise(F.col("value").cast("double"))
        return rows.select("chrom", "bin", F.greatest("start", F.col("bin") * BIN).alias("start"), F.least("end", (F.col("bin") + 1) * BIN).alias("end"), F.lit(side).alias("side"), value.alias("value"))

    both = cut(a, 0).unionByName(cut(b, 1))
    events = both.select("chrom", "bin", F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.when(F.col("side") == 0, F.col("value")).alias("x"), F.when(F.col("side") == 1, F.col("value")).alias("y"), F.lit(1).alias("open"), "side"),
        F.struct(F.col("end").alias("at"), F.when(F.col("side") == 0, F.lit(0.0)).alias("x"), F.when(F.col("side") == 1, F.lit(0.0)).alias("y"), F.lit(0).alias("open"), "side"),
    )).alias("e")).select("chrom", "bin", "e.*")
    # Where a row ends and the next begins, the beginning holds.
    at = events.groupBy("chrom", "bin", "at").agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.col("open"))).alias("x"), F.max_by("y", F.when(F.col("y").isNotNull(), F.col("open"))).alias("y"))
    line = W.partitionBy("chrom", "bin").orderBy("at")
    held = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)).alias(c)
    return at.select("chrom", F.col("at").alias("start"), F.lead("at").over(line).alias("end"), held("x"), held("y")).where("end is not null")


def common_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, length of the contigs of two tracks (chrom, length each); one that both have with different lengths is an error."""
    both = a.select("chrom", "length").unionByName(b.select("chrom", "length")).groupBy("chrom").agg(F.min("length").alias("length"), F.max("length").alias("other"))
    differs = F.raise_error(F.concat_ws(" ", F.lit("contig sizes differ:"), "chrom", F.col("length").cast("string"), F.col("other").cast("string")))
    return both.select("chrom", F.when(F.col("length") == F.col("other"), F.col("length")).otherwise(differs.cast("long")).alias("length"))


def overlay_tracks(a: DataFrame, b: DataFrame, operation: str, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """chrom, start, end, value of two tracks combined base by base; missing counts 0 and zero results are left out.

    sizes: the tracks' contigs (chrom, length), which must agree where both have one.
    """
    if sizes is not None:
        contigs = F.broadcast(common_sizes(*sizes))  # headers' contigs
        a, b = (t.join(contigs, "chrom").where("length is not null").select(*t.columns) for t in (a, b))
    if operation not in OPERATIONS:
        raise ValueError(f"no such operation: {operation}")
    x, y = F.col("x"), F.col("y")
    value = {
        "Add": x + y, "Subtract": x - y, "Product": x * y, "Average": (x + y) / 2,
        "geometricMean": F.when(x * y < 0, F.lit(float("nan"))).otherwise(F.sqrt(F.abs(x * y))), "Max": F.greatest(x, y), "Min": F.least(x, y),
    }[operation]
    return segments(a, b).select("chrom", "start", "end", value.alias("value")).where("value <> 0")
