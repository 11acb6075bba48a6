"""Reports over sequences: hexamers, barcode logos, barcode qualities, barcode edits, single-cell statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import cigar as C
from strandwise.functions.sequence import differences
from strandwise.operators import filters as R
from strandwise.operators.order import before_break, first_rows, near

CODES = "ACGT"


def hexamer_counts(seqs: DataFrame, k: int = 6, by: str | None = None) -> DataFrame:
    """kmer, reads, frequency for all 4^k words of ACGT; words with other letters count neither here nor in the total.

    by: a column, such as the input file, whose values have a table each; it comes first.  Values without words have one of zeros.
    """
    keys = [by] if by else []
    # places are exploded and words cut from them afterwards, in generated code; words of other letters are few once they are counted
    places = seqs.where(F.length("seq") >= k).select(*keys, "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - (k - 1))).alias("at"))
    counts = places.groupBy(*keys, F.substring(F.col("seq"), F.col("at"), F.lit(k)).alias("kmer")).agg(F.count("*").alias("reads"))
    counts = counts.where(F.translate("kmer", CODES, "") == "")
    spark = seqs.sparkSession
    digit = lambda i: F.substring(F.lit(CODES), ((F.shiftright(F.col("id"), 2 * (k - 1 - i)) % 4) + 1).cast("int"), F.lit(1))
    frame = spark.range(4**k).select(F.concat(*[digit(i) for i in range(k)]).alias("kmer"))
    if by:
        frame = seqs.select(by).distinct().crossJoin(F.broadcast(frame))  # 4^k words for each input file
    joined = frame.join(counts, [*keys, "kmer"], "left")
    total = counts.groupBy(*keys).agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("total"))
    joined = joined.join(total, by, "left") if by else joined.crossJoin(F.broadcast(total))  # the total is one row
    n = F.coalesce("reads", F.lit(0)).cast("long")
    return joined.select(*keys, "kmer", n.alias("reads"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(0.0)).alias("frequency"))


def logo_counts(seqs: DataFrame, most: int | None = None, without_n: bool = False) -> DataFrame:
    """pos, base, reads, rank: letters by position; rank orders letters as a scan by position meets them first.

    Records with N count towards ``most``, but when they are left out the stop comes with the next kept record.
    """
    rows = first_rows(seqs, most or None, "rec_no")
    if without_n:
        rows = rows.where(~F.contains("seq", F.lit("N")))
    letters = rows.select("rec_no", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    counts = letters.groupBy("pos", "base").agg(F.count("*").alias("reads"), F.min("rec_no").alias("_first"))
    first = counts.groupBy("base").agg(F.min(F.struct("pos", F.col("_first"))).alias("at"))
    # the alphabet is a few letters
    order = first.select("base", F.expr("row_number() over (order by at, base)").cast("int").alias("rank"))
    return counts.join(F.broadcast(order), "base").select("pos", "base", "reads", "rank")


def barcode_qualities(seqs: DataFrame, most: int | None = None, must_have: bool = False) -> DataFrame:
    """pos, score, reads, fraction: Phred scores (33 off) by position.  must_have: no records at all are an error, found while the query is made."""
    rows = first_rows(seqs, most or None, "rec_no")
    scores = rows.select(F.posexplode(F.split("qual", "")).alias("pos", "c")).where("c <> ''").select("pos", (F.ascii("c") - 33).alias("score"))
    counts = scores.groupBy("pos", "score").agg(F.count("*").alias("reads"))
    totals = counts.groupBy("pos").agg(F.sum("reads").alias("total"))
    if must_have:
        found = totals.count()  # a row for each position
        if not found:
            raise ValueError("no usable quality records")
    return counts.join(totals, "pos").select("pos", "score", "reads", (F.col("reads") / F.col("total")).alias("fraction"))


def tag_text(name: str):
    return F.expr(f"element_at(tags, '{name}').s")


def tag_number(name: str):
    return F.expr(f"element_at(tags, '{name}').i")


def _codes(reads: DataFrame, raw: str, corrected: str, limit: int | None) -> DataFrame:
    if limit is not None:
        if limit <= 0:
            raise ValueError("the limit must be above zero")
        reads = first_rows(reads, limit)
    clean = lambda t: F.replace(tag_text(t), F.lit("-1"), F.lit(""))
    return reads.select("rid", clean(raw).alias("raw"), clean(corrected).alias("code"))


def edit_summary(reads: DataFrame, raw: str, corrected: str, limit: int | None = None) -> DataFrame:
    """total, missing, same, edited over the first ``limit`` reads (all if None).

    Where the reads end before the limit the total is one above them, as the report that this stands for prints it.
    """
    rows = _codes(reads, raw, corrected, limit)
    both = F.col("raw").isNotNull() & F.col("code").isNotNull()
    total = F.count("*") + 1
    return rows.agg(
        (total if limit is None else F.least(total, F.lit(limit))).alias("total"),
        F.count_if(~both).alias("missing"),
        F.count_if(both & (F.col("raw") == F.col("code"))).alias("same"),
        F.count_if(both & (F.col("raw") != F.col("code"))).alias("edited"),
    )


def code_frequency(reads: DataFrame, raw: str, corrected: str, limit: int | None = None) -> DataFrame:
    """code, reads, first_rid: order by reads descending, then first_rid."""
    rows = _codes(reads, raw, corrected, limit).where("raw is not null and code is not null")
    return rows.groupBy("code").agg(F.count("*").alias("reads"), F.min("rid").alias("first_rid"))


def edit_matrix(reads: DataFrame, raw: str, corrected: str, limit: int | None = None) -> DataFrame:
    """pos, edit (from:to), reads: where raw and corrected codes of equal length differ."""
    rows = _codes(reads, raw, corrected, limit).where("raw <> code")
    found = rows.select(F.explode(differences("raw", "code")).alias("d"))
    return found.groupBy(F.col("d.pos").alias("pos"), F.concat_ws(":", "d.old", "d.new").alias("edit")).agg(F.count("*").alias("reads"))


def tag_given(name: str):
    return F.expr(f"element_at(tags, '{name}')").isNotNull()


def single_cell_stat(reads: DataFrame, mito: str = "chrM", contigs: DataFrame | None = None, names: bool = True) -> DataFrame:
    """One row of counters over placed reads; the confident ones have bit 0 of the tag xf.

    A confident read without the tag RE stops the run.  RE that begins with other letters than E and I counts nowhere.  contigs
    (ref_id, chrom): reads from the first on that breaks their order are left out; without it all reads are taken to be in order.
    names: count names as well, for which reads move to the place of their name as a name and a number of bits, and no task gathers the names
    of reads that lie anywhere; without it the two columns are left out and nothing moves.
    """
    reads = reads if contigs is None else before_break(reads, contigs)
    rows = reads.where("chrom is not null").select(
        "qname", "flag", "chrom", (F.coalesce(tag_number("xf"), F.lit(0)).bitwiseAND(F.lit(1)) == 1).alias("ok"), tag_given("RE").alias("has_re"), F.substring(tag_text("RE"), 1, 1).alias("re"),
        tag_given("TX").alias("sense"), tag_given("AN").alias("anti"), tag_given("CB").alias("cb"), tag_given("UB").alias("ub"),
    )
    rows = rows.withColumn("re", F.when(F.col("ok") & ~F.col("has_re"), F.raise_error(F.lit("a confident read has no RE tag"))).otherwise(F.col("re")))
    ok = F.col("ok")
    counters = {
        "confident": ok,
        "duplicates": ok & R.has(R.DUPLICATE),
        "not_duplicates": ok & ~R.has(R.DUPLICATE),
        "reverse": ok & R.has(R.REVERSE),
        "forward": ok & ~R.has(R.REVERSE),
        "exon": ok & (F.col("re") == "E"),
        "intron": ok & (F.col("re") == "I"),
        "sense": ok & F.col("sense"),
        "antisense": ok & ~F.col("sense") & F.col("anti"),
        "other_direction": ok & ~F.col("sense") & ~F.col("anti"),
        "mito": ok & (F.col("chrom") == mito),
        "with_cb": ok & F.col("cb"),
        "with_ub": ok & F.col("ub"),
    }
    if not names:
        return rows.agg(F.count("*").alias("alignments"), *[F.count_if(c).alias(n) for n, c in counters.items()])
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(counters.values())])
    rows = near(rows.select("qname", bits.alias("bits")), "qname")
    own = rows.groupBy("qname").agg(F.count("*").alias("alignments"), *[F.count_if(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(counters)])
    sums = {n: F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("alignments", *counters)}
    named = {"names": F.count("qname"), "confident_names": F.count_if(F.col("qname").isNotNull() & (F.col("confident") > 0))}
    first = ("alignments", "confident")
    return own.agg(*[sums.pop(n) for n in first], *[c.alias(n) for n, c in named.items()], *sums.values())


def single_cell_shares(stat: DataFrame) -> DataFrame:
    """One row of percentages: confident names of all names, and the other counters of confident names; either total at zero is an error."""

    def some(name: str):
        return F.when(F.col(name) > 0, F.col(name)).otherwise(F.raise_error(F.lit(f"no {name.replace('_', ' ')} to divide by")).cast("long"))

    parts = ("duplicates", "not_duplicates", "forward", "reverse", "sense", "antisense", "other_direction", "exon", "intron", "with_cb", "with_ub", "mito")
    return stat.select((F.col("confident_names") * 100.0 / some("names")).alias("confident_names"), *[(F.col(c) * 100.0 / some("confident_names")).alias(c) for c in parts])


def single_cell_shapes(reads: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """shape, reads of confident reads; contigs: as in single_cell_stat."""
    reads = reads if contigs is None else before_break(reads, contigs)
    rows = reads.where("chrom is not null").where(F.coalesce(tag_number("xf"), F.lit(0)).bitwiseAND(F.lit(1)) == 1)
    return rows.groupBy(C.shape().alias("shape")).agg(F.count("*").alias("reads"))
