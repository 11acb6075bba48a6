"""Record-level outputs: FASTQ rows, subsets, splits.  Each is a projection; ``write.partitionBy`` stores the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import oriented
from strandwise.operators import filters as R
from strandwise.operators.genes import exons
from strandwise.operators.intervals import as_right, merge, point_join


def fastq_rows(reads: DataFrame, paired: bool = True) -> DataFrame:
    """rid, mate, name, seq, qual (Phred+33 text), as read; paired rows are read 1 or read 2 and named so."""
    missing = F.when(F.col("seq").isNull() | (F.col("seq") == "") | (F.size("qual") <= 0), F.raise_error(F.concat(F.lit("no sequence or quality: "), "qname")))
    rows = reads.withColumn("_missing", missing).where(F.col("_missing").isNull())
    marks = F.array_join(F.transform(F.when(R.has(R.REVERSE), F.reverse("qual")).otherwise(F.col("qual")), lambda q: F.char(q + 33)), "")
    mate = F.when(R.has(R.READ1), 1).when(R.has(R.READ2), 2) if paired else F.lit(0)
    end = F.concat(F.lit("/"), F.col("mate").cast("string"))
    name = F.when(F.endswith("qname", end), F.col("qname")).otherwise(F.concat("qname", end)) if paired else F.col("qname")
    rows = rows.withColumn("mate", mate).where("mate is not null")
    return rows.select("rid", "mate", name.alias("name"), oriented(F.col("seq"), F.col("flag")).alias("seq"), marks.alias("qual"))


def divide_reads(reads: DataFrame, parts: int, seed: int = 0, skip_unmapped: bool = False) -> DataFrame:
    """reads with a column subset in 0 to parts - 1, the same for all reads of a name."""
    rows = reads.where(R.lacks(R.UNMAPPED)) if skip_unmapped else reads
    draw = F.conv(F.substring(F.md5(F.concat("qname", F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("long")
    lost = F.when(F.col("qname").isNull(), F.raise_error(F.lit("a read has no name")))
    return rows.withColumn("subset", F.coalesce(lost.cast("int"), (draw % parts).cast("int")))


def split_reads(reads: DataFrame, tx: DataFrame) -> DataFrame:
    """reads with a column category: junk, in (the read or its mate starts in an exon) or ex.

    The mate's start is looked up on the read's own contig, and only where the mate is mapped.
    """
    if not exons(tx).where("start < end").limit(1).count():
        raise ValueError("the gene model has no exons")
    regions = as_right(merge(exons(tx).withColumn("chrom", F.upper("chrom"))))
    live = reads.where(R.lacks(R.QC_FAIL | R.UNMAPPED)).select("rid", F.upper("chrom").alias("chrom"), F.col("pos0").alias("p"))
    mates = reads.where(R.lacks(R.QC_FAIL | R.UNMAPPED | R.MATE_UNMAPPED)).select("rid", F.upper("chrom").alias("chrom"), F.coalesce("mate_pos0", F.lit(0)).alias("p"))
    hits = point_join(live.unionByName(mates), "p", regions).select("rid").distinct().withColumn("_in", F.lit(True))
    category = F.when(R.has(R.QC_FAIL) | R.has(R.UNMAPPED), "junk").when(F.col("_in"), "in").otherwise("ex")
    return reads.join(hits, "rid", "left").withColumn("category", category).drop("_in")


def split_pairs(reads: DataFrame) -> DataFrame:
    """reads with a column output (R1, R2 or unmapped); mapped ones lose their mate and keep four flag bits."""
    output = F.when(R.has(R.UNMAPPED), "unmapped").when(R.has(R.READ1), "R1").otherwise("R2")
    mapped = F.col("output") != "unmapped"
    rows = reads.withColumn("output", output)
    return rows.withColumns({
        "flag": F.when(mapped, F.col("flag").bitwiseAND(F.lit(R.REVERSE | R.SECONDARY | R.QC_FAIL | R.DUPLICATE))).otherwise(F.col("flag")),
        "mate_chrom": F.when(~mapped, F.col("mate_chrom")),
        "mate_pos0": F.when(~mapped, F.col("mate_pos0")),
        "tlen": F.when(mapped, F.lit(0)).otherwise(F.col("tlen")),
    })
