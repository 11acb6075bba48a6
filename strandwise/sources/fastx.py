"""Readers of FASTA and FASTQ; there are three on purpose, for the reports disagree about what a record is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.sources.alignments import numbered_lines

#: Lines that are put in order together; records that cross two such blocks are joined afterwards.
BLOCK = 1 << 16


def read_permissive(spark: SparkSession, path: str) -> DataFrame:
    """rec_no, name, seq of FASTA or FASTQ: lines in upper case, of letters ACGTN only, after each line that starts with > or @."""
    lines = numbered_lines(spark, path).select("file", "line", F.upper(F.trim("value")).alias("value")).where("value <> ''")
    head = F.rlike("value", F.lit("^[>@]"))
    rows = lines.where(head | F.rlike("value", F.lit("^[ACGTN]+$"))).withColumns({"head": head, "block": F.floor(F.col("line") / BLOCK)})
    # The running header: the last one in the block, or else the last one of the file's blocks before.
    tops = rows.groupBy("file", "block").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("top"))
    carried = tops.select("file", "block", F.last("top", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))  # a row a block
    within = F.max(F.when(F.col("head"), F.col("line"))).over(W.partitionBy("file", "block").orderBy("line"))
    placed = rows.withColumn("own", within).join(carried, ["file", "block"]).withColumn("record", F.coalesce("own", "carried"))
    parts = placed.where("record is not null").groupBy("record").agg(F.max(F.when(F.col("head"), F.substr("value", F.lit(2)))).alias("name"), F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("line", "value")))).alias("s"))
    return parts.select(F.col("record").alias("rec_no"), "name", F.array_join(F.transform("s", lambda x: x["value"]), "").alias("seq")).where("seq <> ''")


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """rec_no, seq: every line that is no header is a record."""
    lines = numbered_lines(spark, path).where(~F.startswith("value", F.lit(">"))).where(F.trim("value") != "")
    return lines.select(F.col("line").alias("rec_no"), F.upper(F.trim("value")).alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """rec_no, seq, qual: records are every four lines that are not blank."""
    lines = numbered_lines(spark, path, F.trim("value") != "")
    rows = lines.groupBy(F.floor(F.col("line") / 4).alias("rec_no")).agg(*[F.max(F.when(F.col("line") % 4 == i, F.trim("value"))).alias(n) for i, n in ((1, "seq"), (3, "qual"))])
    return rows.select("rec_no", "seq", "qual")
