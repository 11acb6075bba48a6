"""Small text tables: contig sizes, gene descriptions, gene counts, intervals, lists of input files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.sources.alignments import numbered_lines


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).where(F.trim("value") != "").where(~F.startswith("value", F.lit("#")))
    return lines.select("line", F.split(F.trim("value"), "\\s+").alias("f"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """line, chrom, length; stops at lines of one column, sizes that are not positive, repeated names, and empty files."""
    rows = _fields(spark, path).select("line", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("length"))
    bad = rows.agg(F.count("*").alias("n"), F.count_if(F.col("length").isNull() | (F.col("length") <= 0)).alias("wrong"), F.countDistinct("chrom").alias("names")).first()
    if not bad["n"] or bad["wrong"] or bad["names"] != bad["n"]:
        raise ValueError(f"contig sizes are empty, wrong or repeated: {path}")
    return rows


def read_gene_information(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, symbol, chrom, start, end, strand, gene_type, exon_length of 11 columns."""
    f = _fields(spark, path)
    at = lambda i: F.get("f", F.lit(i))
    return f.select(at(0).alias("gene_id"), at(1).alias("symbol"), at(2).alias("chrom"), at(3).cast("long").alias("start"), at(4).cast("long").alias("end"), at(5).alias("strand"), at(6).alias("gene_type"), at(10).cast("long").alias("exon_length"))


def read_gene_counts(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, reads; summary rows start with two underscores and are left out."""
    f = _fields(spark, path)
    return f.select(F.get("f", F.lit(0)).alias("gene_id"), F.get("f", F.lit(1)).cast("long").alias("reads")).where(~F.startswith("gene_id", F.lit("__")))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value of bedGraph text."""
    f = _fields(spark, path).where(~F.get("f", F.lit(0)).isin("track", "browser"))
    at = lambda i: F.get("f", F.lit(i))
    return f.select(at(0).alias("chrom"), at(1).cast("long").alias("start"), at(2).cast("long").alias("end"), at(3).cast("float").alias("value"))


def float_text(value: Column) -> Column:
    """A double as the shortest text that reads back as it: 5.0, 0.25, 1e-05, 1.5e+16, nan, inf."""
    value = value.cast("double")
    text, size = value.cast("string"), F.abs(value)
    digits = F.when(size < 1e-3, value.cast("decimal(38,25)").cast("string")).otherwise(value.cast("decimal(38,18)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), "[.]$", ".0")
    power = F.regexp_extract(text, "E-?([0-9]+)", 1)
    short = F.concat(F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), "[.]0$", ""), F.when(F.contains(text, F.lit("E-")), "e-").otherwise("e+"), F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    named = F.when(F.isnan(value), "nan").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
    return F.coalesce(named, F.when(~F.contains(text, F.lit("E")), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short))


def digits_text(value: Column, digits: int = 12) -> Column:
    """A double with so many significant digits at most and no zeros at the end: 0.25, 1e-05, 1.5e+16; zeros are 0, nulls stay.

    The exact value is rounded; a JVM formatter would round the shortest text, which is another rule where that ends in a 5.
    """

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda x: "0" if x == 0 else format(x, f".{digits}g"))

    plain = F.when(F.isnan(value), "nan").otherwise(shown(F.coalesce(value.cast("double"), F.lit(0.0))))  # a null would come as NaN
    return F.when(value.isNotNull(), plain)


def write_bedgraph(track: DataFrame, path: str) -> None:
    """Lines chrom, start, end, value, in order inside ranges of contig and start."""
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), float_text(F.col("value")))
    track.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").select(line).write.mode("errorifexists").text(path)


def write_wig(track: DataFrame, path: str, sizes: DataFrame) -> None:
    """variableStep text: a line for each base, values with two decimals, contigs in the order of sizes (line, chrom).

    A listed contig without rows has its head line; rows of other contigs are left out.
    """
    heads = sizes.select("line", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("variableStep chrom="), "chrom").alias("text"))
    rows = track.where("start < end").join(sizes.select("line", "chrom"), "chrom").select("line", "value", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos"))
    body = rows.select("line", F.col("pos").cast("long").alias("pos"), F.concat_ws("\t", F.col("pos").cast("string"), F.format_string("%.2f", F.col("value").cast("double"))).alias("text"))
    heads.unionByName(body).repartitionByRange("line", "pos").sortWithinPartitions("line", "pos").select("text").write.mode("errorifexists").text(path)


def write_table(rows: DataFrame, path: str, order: list[str], sep: str = "\t", digits: int | None = None) -> None:
    """Rows as text with a head line in each file, in order inside ranges of the given columns.

    Doubles are written as float_text, or as digits_text if a number of digits is given.
    """
    number = float_text if digits is None else lambda c: digits_text(c, digits)
    shown = [number(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*shown).write.mode("errorifexists").option("sep", sep).option("header", True).csv(path)


def write_fastq(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Four lines a record, in file order inside ranges."""
    text = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    rows.repartitionByRange("rid").sortWithinPartitions("rid").select(text).write.mode("errorifexists").option("compression", compression).text(path)


# The colours by which browsers show kinds of junctions.
COLOURS = {"annotated": "205,0,0", "partial_novel": "0,205,0", "complete_novel": "0,0,205"}


def _flanked(junctions: DataFrame, size: int) -> DataFrame:
    """Junctions with their ends moved out by size, as low and high, and a colour."""
    colour = F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[F.col("kind")], F.lit("0,0,0"))
    return junctions.withColumns({"low": F.col("start") - size, "high": F.col("end") + size, "colour": colour})


def _write_in_order(rows: DataFrame, path: str) -> None:
    """The column text of rows, in order of the junctions' first reads inside ranges; nulls come first."""
    order = ["first_rid", "start", "end"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("errorifexists").text(path)


def _tabbed(*columns) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def write_junction_bed(junctions: DataFrame, path: str, size: int = 1) -> None:
    """BED12 lines of junctions with ``size`` bases on either side."""
    rows = _flanked(junctions, size)
    line = _tabbed("chrom", "low", "high", "kind", "reads", F.lit("."), "low", "high", "colour", F.lit(2), F.lit(f"{size},{size}"), F.concat(F.lit("0,"), (F.col("high") - size - F.col("low")).cast("string")))
    _write_in_order(rows.withColumn("text", line), path)


def write_interact(junctions: DataFrame, path: str, title: str, size: int = 1) -> None:
    """A line that names the track, then 18 columns that browsers read as arcs between the two sides of a junction."""
    span = lambda a, b: F.concat("chrom", F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"))
    low, high = F.col("low"), F.col("high")
    line = _tabbed(
        "chrom", low, high, F.concat(span(low, high), F.lit("_"), "kind"), "reads", F.concat(F.col("reads").cast("string"), F.lit(".0")), F.lit("RNAseq_junction"), "colour",
        "chrom", low, low + size, span(low, low + size), F.lit("."), "chrom", high - size, high, span(high - size, high), F.lit("."),
    )
    rows = _flanked(junctions, size).select("first_rid", "start", "end", line.alias("text"))
    head = f'track type=interact name="Splice junctions" description="Splice junctions detected from {title}" maxHeightPixels=200:200:50 visibility=full'
    none = F.lit(None).cast("long")
    first = junctions.sparkSession.range(1).select(none.alias("first_rid"), none.alias("start"), none.alias("end"), F.lit(head).alias("text"))
    _write_in_order(first.unionByName(rows), path)


def percent_text(numerator: int, denominator: int) -> str:
    """A percentage with two decimals as Python prints it; for the few distinct values at a sink."""
    return f"{numerator / denominator * 100:.2f}"
