"""Readers of alignments.

SAM text is split by Spark and decoded by expressions.  BAM is a Python data source over byte ranges, see bam.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.functions.cigar import parse_cigar
from strandwise.sources.bam import FEW_PARTS, SAM_SCHEMA, BamSource, read_bam
from strandwise.sources.cram import read_cram

__all__ = ["SAM_SCHEMA", "BamSource", "decode_sam", "numbered_lines", "read_alignments", "read_sam", "sam_contigs"]
#: Endings of compressed text that Spark's reader does not know; files of either kind cannot be split.
OTHER_GZIP, OTHER_BZIP = (".z",), (".bz", ".bzip2")
SAM, BAM, CRAM = (".sam",), (".bam",), (".cram",)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a file, by its extension."""
    name = path.lower()
    if name.endswith((*SAM, *(x + y for x in SAM for y in (".gz", ".bz2", *OTHER_GZIP, *OTHER_BZIP)))):
        return read_sam(spark, path)
    if name.endswith(BAM):
        return read_bam(spark, path)
    if name.endswith(CRAM):
        return read_cram(spark, path)
    raise ValueError(f"unknown kind of alignment file: {path}")


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """value, file, line: lines of text with their number (from 0) over all files, in order of path.

    keep: a condition on value; other lines are not counted.  Each part of a file counts its own lines, and a table
    with a row for each part tells how many lines come before it, so no task sees a whole file.
    """
    if path.lower().endswith((*OTHER_GZIP, *OTHER_BZIP)):
        lines, few = _other_text(spark, path), True
    else:
        text = spark.read.text(path)
        lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
        few = len(text.inputFiles()) + 2 * text.rdd.getNumPartitions() <= FEW_PARTS  # no more parts than that
    lines = (lines if keep is None else lines.where(keep)).withColumn("at", F.monotonically_increasing_id())
    parts = lines.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("file", "part")) - F.col("n")  # a row for each part of a file
    parts = parts.select("file", "part", "first", before.alias("before"))
    if few:
        parts = F.broadcast(parts)
    return lines.join(parts, ["file", "part"]).select("value", "file", (F.col("at") - F.col("first") + F.col("before")).alias("line"))


def _other_text(spark: SparkSession, path: str) -> DataFrame:
    """value, file, part of text whose ending Spark's reader does not know, decompressed by the task that has the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = io.BytesIO(content.as_buffer())
                text = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if file.lower().endswith(OTHER_GZIP) else bz2.BZ2File(raw), "utf-8", newline="\n")
                while some := text.readlines(1 << 20):
                    values = pa.array([x.removesuffix("\n").removesuffix("\r") for x in some], pa.string())
                    yield pa.RecordBatch.from_arrays([values, pa.array([file] * len(some), pa.string()), pa.array([0] * len(some), pa.int64())], ["value", "file", "part"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "value string, file string, part long")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of SAM text; rid is the record's place over all files, in order of path, without headers and blank lines."""
    return decode_sam(numbered_lines(spark, path, ~F.rlike("value", F.lit("^@[A-Z]{2}\t")) & (F.col("value") != "")).withColumnRenamed("line", "rid"))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, chrom, length of the headers, in their order; a contig of several files comes once."""
    lines = numbered_lines(spark, path, F.startswith("value", F.lit("@SQ\t")))
    rows = lines.select("line", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("length"))
    rows = rows.groupBy("chrom").agg(F.min_by("length", "line").alias("length"), F.min("line").alias("line"))
    return rows.select(F.expr("row_number() over (order by line) - 1").cast("int").alias("ref_id"), "chrom", "length")  # a row for each contig


def decode_sam(lines: DataFrame) -> DataFrame:
    """lines: rid, value (a record without its line end)."""
    f = F.split("value", "\t")
    star = lambda c: F.when(c != "*", c)
    place = lambda c: F.when(c.cast("long") > 0, c.cast("long") - 1)
    chrom = star(f[2])
    tags = F.transform(F.filter(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.rlike(t, F.lit("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))), lambda t: F.struct(
        F.substring(t, 1, 2).alias("key"),
        F.struct(F.substring(t, 4, 1).alias("t"), F.when(F.substring(t, 4, 1) == "i", F.substr(t, F.lit(6)).cast("long")).alias("i"), F.when(F.substring(t, 4, 1) != "i", F.substr(t, F.lit(6))).alias("s")).alias("value"),
    ))
    return lines.select(
        "rid", f[0].alias("qname"), f[1].cast("int").alias("flag"), chrom.alias("chrom"), place(f[3]).alias("pos0"), f[4].cast("int").alias("mapq"), parse_cigar(f[5]).alias("cigar"),
        F.when(f[6] == "=", chrom).otherwise(star(f[6])).alias("mate_chrom"), place(f[7]).alias("mate_pos0"), f[8].cast("int").alias("tlen"), F.when(f[9] != "*", f[9]).otherwise("").alias("seq"),
        F.when(f[10] != "*", F.transform(F.split(f[10], ""), lambda c: F.ascii(c) - 33)).otherwise(F.array().cast("array<int>")).alias("qual"), F.map_from_entries(tags).alias("tags"),
    )
