"""Gene models in BED12 text: one transcript a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.sources.alignments import numbered_lines

#: What each report does with header lines and with lines that do not parse.
HEADERS_ARE_ERRORS = ("cds_exon", "exon")
ERRORS = ("cds_exon", "exon", "utr", "intergenic", "fpkm_transcripts", "fragment_size", "junction_integers")


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Every line: is_header, parse_error (null if none) and the model's columns; ``models`` applies a policy."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    f = F.split(F.trim("value"), "\\s+")
    numbers = lambda i: F.filter(F.split(F.get(f, F.lit(i)), ","), lambda x: x != "")
    whole = lambda c: F.rlike(F.coalesce(c, F.lit("")), F.lit("^-?[0-9]+$"))
    header = F.rlike("value", F.lit("^(#|track|browser)"))
    plain = F.forall(F.array(*[F.get(f, F.lit(i)) for i in (1, 2, 6, 7)]), whole) & F.forall(numbers(10), whole) & F.forall(numbers(11), whole)
    error = F.when(F.size(f) < 12, "fewer than 12 columns").when(~plain, "a number does not parse").when(F.size(numbers(10)) != F.size(numbers(11)), "block sizes and starts differ in number")
    rows = lines.select("line", "value", header.alias("is_header"), F.when(~header, error).alias("parse_error"), f.alias("f"), numbers(10).alias("sizes"), numbers(11).alias("starts"))
    ok = ~F.col("is_header") & F.col("parse_error").isNull()
    at = lambda i: F.when(ok, F.get("f", F.lit(i)).cast("long"))
    blocks = F.expr("zip_with(starts, sizes, (s, n) -> named_struct('start', tx_start + cast(s as bigint), 'end', tx_start + cast(s as bigint) + cast(n as bigint)))")
    rows = rows.withColumns({"tx_start": at(1), "tx_end": at(2), "cds_start": at(6), "cds_end": at(7)})
    return rows.select(
        "line", "is_header", "parse_error", F.get("f", F.lit(3)).alias("name"), F.get("f", F.lit(0)).alias("chrom"), "tx_start", "tx_end", F.get("f", F.lit(5)).alias("strand"), "cds_start", "cds_end", F.when(ok, blocks).alias("blocks")
    )


def models(lines: DataFrame, policy: str = "skip") -> DataFrame:
    """Transcripts of parsed lines.  policy: skip, or a name in ERRORS, under which a bad line (or header) stops the run."""
    bad = F.col("parse_error").isNotNull()
    if policy in ERRORS:
        stop = bad | F.col("is_header") if policy in HEADERS_ARE_ERRORS else bad
        message = F.concat(F.lit("bad line "), (F.col("line") + 1).cast("string"), F.lit(": "), F.coalesce("parse_error", F.lit("a header")))
        lines = lines.withColumn("parse_error", F.when(stop, F.raise_error(message).cast("string")).otherwise(F.col("parse_error")))
    rows = lines.where(~F.col("is_header") & F.col("parse_error").isNull())
    return rows.select(F.concat_ws(":", "name", "chrom", "tx_start", "tx_end", "line").alias("tx_id"), "name", "chrom", "tx_start", "tx_end", "strand", "cds_start", "cds_end", "blocks", "line")
