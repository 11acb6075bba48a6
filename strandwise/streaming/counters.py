"""Counters over alignments that keep arriving, as Structured Streaming aggregates.

They hold counts only, so state is bounded by the number of distinct keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandwise.operators import filters as R
from strandwise.operators.regions import junction_annotation
from strandwise.operators.reports import bam_stat, duplication_keys
from strandwise.sources.alignments import SAM_SCHEMA, decode_sam


def stream_sam(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Reads of SAM files as they arrive in a folder.  Order between files is not defined, so rid is null."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return decode_sam(lines.where(~F.rlike("value", F.lit("^@[A-Z]{2}\t"))).withColumn("rid", F.lit(None).cast("long")))


def running_bam_stat(reads: DataFrame, q_cut: int = 30) -> DataFrame:
    """bam_stat of all reads so far (output mode complete)."""
    return bam_stat(reads, q_cut)


def running_gc(reads: DataFrame, q_cut: int = 30) -> DataFrame:
    """gc, length, reads of all reads so far (output mode update or complete)."""
    rows = reads.where(R.keeps("read_gc", q_cut)).where(F.length("seq") > 0)
    gc = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    return rows.groupBy(gc.alias("gc"), F.length("seq").alias("length")).agg(F.count("*").alias("reads"))


class _Occurrence(StatefulProcessor):
    """Counts a key; a key that goes from n to m occurrences leaves n and enters m."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        now = before + sum(len(r) for r in rows)
        self.seen.update((now,))
        moves = [(now, 1)] if not before else [(before, -1), (now, 1)]
        yield pd.DataFrame(moves, columns=["occurrence", "change"])

    def close(self) -> None:
        pass


def duplication_changes(reads: DataFrame, by: str, q_cut: int = 30) -> DataFrame:
    """occurrence, change: how each batch moves keys between the counts of duplication (output mode append).

    State is a number for each sequence or placement, kept in RocksDB, so it may exceed memory; only keys go to Python.
    """
    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keys = duplication_keys(reads, by, q_cut)
    key = F.sha2(F.to_json(F.struct(*keys.columns)), 256)  # of one width, however long reads are
    return keys.select(key.alias("key")).groupBy("key").transformWithStateInPandas(_Occurrence(), "occurrence long, change long", "Append", "none")


def duplication_so_far(changes: DataFrame) -> DataFrame:
    """occurrence, keys: the histogram that all changes so far add up to."""
    sums = changes.groupBy("occurrence").agg(F.sum("change").cast("long").alias("keys"))
    return sums.where("keys > 0")


def running_junctions(reads: DataFrame, tx: DataFrame, shortest: int = 50, q_cut: int = 30) -> DataFrame:
    """chrom, start, end, reads, kind of all junctions so far (output mode complete or update); state is a count for each junction."""
    return junction_annotation(reads, tx, shortest, q_cut).drop("first_rid")


__all__ = ["SAM_SCHEMA", "duplication_changes", "duplication_so_far", "running_bam_stat", "running_gc", "running_junctions", "stream_sam"]
