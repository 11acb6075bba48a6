"""Parts of transcripts.  Models: tx_id, chrom, tx_start, tx_end, strand, cds_start, cds_end, blocks array<struct<start,end>>, line (file order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exons(tx: DataFrame, *keep: str) -> DataFrame:
    return tx.select("chrom", *keep, F.explode("blocks").alias("b")).select("chrom", *keep, F.col("b.start").alias("start"), F.col("b.end").alias("end"))


#: Kinds of parts, before the flanks: coding, 5' and 3' untranslated, introns.
CODING, UTR5, UTR3, INTRON = range(4)
_BLOCK_PARTS = f"""coalesce(flatten(transform(blocks, (b, i) -> array(
    named_struct('kind', if(b.end >= cds_start and b.start <= cds_end, {CODING}, null), 'start', greatest(b.start, cds_start), 'end', least(b.end, cds_end)),
    named_struct('kind', if(b.start < cds_start, case strand when '+' then {UTR5} when '-' then {UTR3} end, null), 'start', b.start, 'end', least(b.end, cds_start)),
    named_struct('kind', if(b.end > cds_end, case strand when '+' then {UTR3} when '-' then {UTR5} end, null), 'start', greatest(b.start, cds_end), 'end', b.end),
    named_struct('kind', {INTRON}, 'start', b.end, 'end', get(blocks, i + 1).start)))), array())"""


def _flank(side: str, size: int) -> tuple[Column, Column]:
    before = (F.col("strand") == "-") if side == "down" else (F.col("strand") != "-")
    start = F.when(before, F.greatest(F.col("tx_start") - size, F.lit(0))).otherwise(F.col("tx_end"))
    return start.cast("long").alias("start"), F.when(before, F.col("tx_start")).otherwise(F.col("tx_end") + size).cast("long").alias("end")


def model_parts(tx: DataFrame, sizes: tuple[int, ...] = ()) -> DataFrame:
    """chrom, start, end, kind of all parts of all transcripts, from one pass over the model.

    sizes: of flanks, whose kinds follow INTRON: those before the transcripts in the order of sizes, then those after them.
    """
    sides = [(side, n) for side in ("up", "down") for n in sizes]
    flank = [F.struct(F.lit(INTRON + 1 + i).alias("kind"), *_flank(*x)) for i, x in enumerate(sides)]
    rows = tx.select("chrom", F.explode(F.concat(F.expr(_BLOCK_PARTS), F.array(*flank)) if flank else F.expr(_BLOCK_PARTS)).alias("p"))
    return rows.select("chrom", "p.start", "p.end", "p.kind").where("kind is not null and start < end")


def cds_exons(tx: DataFrame) -> DataFrame:
    """Parts of exons inside the coding range."""
    return model_parts(tx).where(F.col("kind") == CODING).drop("kind")


def introns(tx: DataFrame, *keep: str) -> DataFrame:
    """Gaps between neighbouring blocks."""
    gaps = F.expr("transform(slice(blocks, 2, greatest(size(blocks) - 1, 0)), (b, i) -> named_struct('start', blocks[i].end, 'end', b.start))")
    return tx.select("chrom", *keep, F.explode(gaps).alias("g")).select("chrom", *keep, F.col("g.start").alias("start"), F.col("g.end").alias("end")).where("start < end")


def utr_exons(tx: DataFrame, side: int) -> DataFrame:
    """Parts of exons outside the coding range at the 5' or 3' end of the strand."""
    return model_parts(tx).where(F.col("kind") == (UTR5 if side == 5 else UTR3)).drop("kind")


def flanks(tx: DataFrame, up: int, down: int) -> tuple[DataFrame, DataFrame]:
    """Ranges before and after transcripts in the strand's direction, not below 0."""
    return tx.select("chrom", *_flank("up", up)), tx.select("chrom", *_flank("down", down))


def with_length(tx: DataFrame) -> DataFrame:
    return tx.withColumn("length", F.expr("aggregate(blocks, 0L, (a, b) -> a + b.end - b.start)"))
