"""Counting reports over reads: statistics, duplication, GC content, cycle matrices, CIGAR profiles, strand inference.

Reads: rid (file order), qname, flag, chrom, pos0, mapq, cigar, mate_chrom, mate_pos0, tlen, seq, qual array<int>, tags.
Results that follow file order use the smallest rid of a group; row counts that follow the last record use max_by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import cigar as C
from strandwise.functions.sequence import md_mismatches, oriented
from strandwise.operators import filters as R
from strandwise.operators.intervals import merge, overlap_join
from strandwise.operators.order import first_rows
from strandwise.operators.windows import at_home, sole_genes


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).cast("long").alias(name)


def stat_bucket(q_cut: int = 30) -> Column:
    """The first bucket that fits a read."""
    return (
        F.when(R.has(R.QC_FAIL), "qc_fail")
        .when(R.has(R.DUPLICATE), "duplicate")
        .when(R.has(R.SECONDARY), "non_primary")
        .when(R.has(R.UNMAPPED), "unmapped")
        .when(~R.good_quality(q_cut), "multi")
        .otherwise("unique")
    )


def spliced() -> Column:
    return F.coalesce(F.exists("cigar", lambda c: c["op"] == "N"), F.lit(False))


def elsewhere() -> Column:
    """Whether the mate lies on another contig."""
    return F.coalesce(F.col("chrom") != F.col("mate_chrom"), F.lit(False))


def bam_stat(reads: DataFrame, q_cut: int = 30) -> DataFrame:
    """One row of counters; a read falls in the first bucket that fits."""
    return stat_of(reads.select("flag", stat_bucket(q_cut).alias("bucket"), spliced().alias("spliced"), elsewhere().alias("elsewhere"), F.lit(1).alias("n")))


def stat_of(rows: DataFrame) -> DataFrame:
    """bam_stat of rows flag, bucket, spliced, elsewhere that stand for n reads each."""

    def count(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long").alias(name)

    unique = F.col("bucket") == "unique"
    proper = unique & R.has(R.PROPER)
    return rows.agg(
        count(F.lit(True), "total"),
        *[count(F.col("bucket") == b, b) for b in ("qc_fail", "duplicate", "non_primary", "unmapped", "multi", "unique")],
        count(unique & R.has(R.READ1), "read1"),
        count(unique & R.has(R.READ2), "read2"),
        count(unique & ~R.has(R.REVERSE), "forward"),
        count(unique & R.has(R.REVERSE), "reverse"),
        count(unique & ~F.col("spliced"), "non_splice"),
        count(unique & F.col("spliced"), "splice"),
        count(proper, "proper_pair"),
        count(proper & F.col("elsewhere"), "proper_other_contig"),
    )


def filter_matrix(reads: DataFrame, q_cut: int = 30) -> DataFrame:
    """report, kept: how many reads each report's filter keeps."""
    kept = reads.agg(*[_count(R.keeps(p, q_cut), p) for p in R.POLICIES])
    return kept.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("k"), F.col(p).alias("v")) for p in R.POLICIES]))).alias("report", "kept"))


def gc_bases() -> Column:
    return F.length("seq") - F.length(F.translate("seq", "GC", ""))


def read_gc(reads: DataFrame, q_cut: int = 30) -> DataFrame:
    """gc, length, reads, first_rid: the few distinct (gc, length) pairs; ``percent_text`` makes their key at the sink."""
    rows = reads.where(R.keeps("read_gc", q_cut)).where(F.length("seq") > 0)
    return rows.groupBy(gc_bases().alias("gc"), F.length("seq").alias("length")).agg(F.count("*").alias("reads"), F.min("rid").alias("first_rid"))


def read_nvc(reads: DataFrame, q_cut: int = 30) -> DataFrame:
    """pos, A, C, G, T, N, X: letters by read position, as read; as many rows as the last record is long."""
    rows = reads.where(R.keeps("read_nvc", q_cut)).select("rid", oriented(F.col("seq"), F.col("flag")).alias("seq"))
    last = rows.agg(F.max_by(F.length("seq"), "rid").alias("last"))
    letters = rows.select(F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    return nvc_of(letters.groupBy("pos", "base").agg(F.count("*").alias("n")), last)


def nvc_of(letters: DataFrame, last: DataFrame) -> DataFrame:
    """read_nvc of counts (pos, base, n) and the last record's length (one row, last)."""
    frame = last.select(F.explode(F.expr("if(last > 0, sequence(0, int(last) - 1), cast(array() as array<int>))")).alias("pos"))
    counts = letters.groupBy("pos").agg(*[F.sum(F.when(F.col("base") == b, F.col("n"))).alias(b) for b in "ACGTNX"])
    return frame.join(counts, "pos", "left").select("pos", *[F.coalesce(F.col(b), F.lit(0)).cast("long").alias(b) for b in "ACGTNX"])


def unclipped_qualities() -> Column:
    """Qualities without soft clips, as read."""
    lead, tail = C.clip_lengths()
    kept = F.slice("qual", lead + 1, F.greatest(F.size("qual") - lead - tail, F.lit(0)))
    return F.when(R.has(R.REVERSE), F.reverse(kept)).otherwise(kept)


def read_quality(reads: DataFrame, q_cut: int = 30) -> DataFrame:
    """pos, quality, reads: qualities without soft clips, as read; positions up to the last record's sequence length."""
    rows = reads.where(R.keeps("read_quality", q_cut))
    rows = rows.select("rid", F.length("seq").alias("n"), unclipped_qualities().alias("q"))
    last = rows.agg(F.max_by("n", "rid").alias("last"))
    counts = rows.select(F.posexplode("q").alias("pos", "quality")).groupBy("pos", "quality").agg(F.count("*").alias("reads"))
    return counts.join(F.broadcast(last), F.col("pos") < F.col("last")).drop("last")


def duplication(reads: DataFrame, by: str, q_cut: int = 30) -> DataFrame:
    """occurrence, keys: how many sequences (by='sequence') or placements (by='position') occur so often."""
    once = duplication_keys(reads, by, q_cut)
    return once.groupBy(*once.columns).agg(F.count("*").alias("occurrence")).groupBy("occurrence").agg(F.count("*").alias("keys"))


def duplication_keys(reads: DataFrame, by: str, q_cut: int = 30) -> DataFrame:
    """The key of each kept read: its sequence, or its placement."""
    rows = reads.where(R.keeps("read_duplication", q_cut))
    if by == "position":
        rows = rows.withColumn("_lost", F.when(F.col("chrom").isNull() | F.col("pos0").isNull(), F.raise_error(F.lit("a mapped read has no place"))))
        keys = ["chrom", "pos0", F.expr("array_join(transform(_blocks, b -> concat(b.start, '-', b.end)), ':')").alias("placement")]
        rows = rows.withColumn("_blocks", C.exon_blocks()).where(F.col("_lost").isNull())
    else:
        keys = ["seq"]
    return rows.select(*keys)


def cycle_profile(reads: DataFrame, op: str, report: str, q_cut: int = 30, pairs: bool = False) -> DataFrame:
    """mate, pos, with_op, without_op: reads whose base at a read position is clipped (op S) or inserted (op I).

    Rows reach to the last kept record's length.  mate is 0 for single-end runs, else 1 and 2.
    """
    rows = reads.where(R.keeps(report, q_cut))
    mate = F.when(R.has(R.READ1), 1).otherwise(2) if pairs else F.lit(0)
    if pairs:
        rows = rows.where(R.has(R.PAIRED))
    rows = rows.select("rid", mate.alias("mate"), C.expanded_length().alias("n"), cycles(op).alias("at"))
    sizes = rows.groupBy("mate").agg(F.count("*").alias("total"), F.max_by("n", "rid").alias("last"))
    hits = rows.where(F.size("at") > 0).select("mate", F.explode("at").alias("pos")).groupBy("mate", "pos").agg(F.count("*").alias("with_op"))
    return cycles_of(sizes, hits)


def cycles(op: str) -> Column:
    """Read positions, as read, of the bases that ``op`` covers."""
    n = C.expanded_length()
    at = F.flatten(F.transform(C.read_ranges(op), lambda r: F.when(r["end"] > r["start"], F.sequence(r["start"], r["end"] - 1)).otherwise(F.array().cast("array<bigint>"))))
    return F.when(R.has(R.REVERSE), F.transform(at, lambda p: n - 1 - p)).otherwise(at)


def cycles_of(sizes: DataFrame, hits: DataFrame) -> DataFrame:
    """cycle_profile of sizes (mate, total, last) and hits (mate, pos, with_op)."""
    frame = sizes.where("last > 0").select("mate", "total", F.explode(F.expr("sequence(0L, last - 1)")).alias("pos"))
    joined = frame.join(hits, ["mate", "pos"], "left").withColumn("with_op", F.coalesce("with_op", F.lit(0)).cast("long"))
    return joined.select("mate", "pos", "with_op", (F.col("total") - F.col("with_op")).alias("without_op"))


def shows_deletions(length: int, q_cut: int = 30) -> Column:
    return R.keeps("deletion_profile", q_cut) & F.exists("cigar", lambda c: c["op"] == "D") & (F.length("seq") == length) & (C.length_of("MSI") == length)


def deletion_profile(reads: DataFrame, length: int, most: int | None = None, q_cut: int = 30) -> DataFrame:
    """pos, deletions for read positions 0 to length - 1, over the first ``most`` reads (all if None) with a deletion."""
    rows = reads.where(shows_deletions(length, q_cut))
    rows = first_rows(rows.select("rid", deletion_places(length).alias("d")), most)
    return filled(rows.select(F.explode("d").alias("pos")).groupBy("pos").agg(F.count("*").alias("deletions")), length, ["deletions"])


def deletion_places(length: int) -> Column:
    """Read positions of deletions; reverse reads count from the other end."""
    return F.transform(C.deletion_starts(), lambda d: F.when(R.has(R.REVERSE), length - d["start"]).otherwise(d["start"]))


def filled(counts: DataFrame, length: int, columns: list[str]) -> DataFrame:
    frame = counts.sparkSession.range(length).select(F.col("id").alias("pos"))
    return frame.join(counts, "pos", "left").select("pos", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in columns])


GENOTYPES = [f"{a}2{b}" for a in "ACGT" for b in "ACGT" if a != b]


def mismatch_profile(reads: DataFrame, length: int, most: int | None = None, q_cut: int = 30) -> DataFrame:
    """pos, sum and a column for each of 12 genotypes, over the first ``most`` reads (all if None) with mismatches and no deletion.

    Reverse reads count from the other end; bases are not complemented.
    """
    rows = first_rows(reads.where(shows_mismatches(length, q_cut)).select("rid", "flag", "seq", _md().alias("md")), most).where("md is not null")
    found = rows.select(F.explode(mismatches("md", length)).alias("m"))
    return mismatches_of(found.groupBy("m.pos", "m.g").agg(F.count("*").alias("n")), length)


def _md() -> Column:
    return F.expr("element_at(tags, 'MD').s")


def shows_mismatches(length: int, q_cut: int = 30) -> Column:
    nm = F.expr("element_at(tags, 'NM').i")
    kept = R.keeps("mismatch_profile", q_cut) & (nm.isNull() | (nm != 0)) & (_md().isNull() | ~F.contains(_md(), F.lit("^")))
    return kept & (F.length("seq") == length) & (C.length_of("M") == length) & ~F.contains("seq", F.lit("N"))


def mismatches(md: str, length: int) -> Column:
    """(pos, g) of each mismatch: the read position, and its genotype."""
    pos = lambda m: F.when(R.has(R.REVERSE), length - 1 - m["pos"]).otherwise(m["pos"]).cast("long")
    return F.transform(md_mismatches(md, "seq"), lambda m: F.struct(pos(m).alias("pos"), F.concat(m["ref"], F.lit("2"), m["read"]).alias("g")))


def mismatches_of(counts: DataFrame, length: int) -> DataFrame:
    """mismatch_profile of counts (pos, g, n)."""
    sums = counts.groupBy("pos").agg(F.sum("n").alias("sum"), *[F.sum(F.when(F.col("g") == g, F.col("n"))).alias(g) for g in GENOTYPES])
    return filled(sums, length, ["sum", *GENOTYPES])


def strand_inference(reads: DataFrame, tx: DataFrame, sample: int | None = None, q_cut: int = 30) -> DataFrame:
    """paired, key, reads: how read strand and gene strand go together over the first ``sample`` usable reads (all if None)."""
    rows = reads.where(infers(q_cut))
    if sample is None:
        place = [c.alias(n) for c, n in zip(inference_key(), PLACE)]
        return inference_of(rows.groupBy(*place).agg(F.count_distinct("rid").alias("n")), tx, list(PLACE))
    return inference_of(rows.select("rid", *inference_key(), F.lit(1).alias("n")), tx, ["rid"], sample)


def infers(q_cut: int = 30) -> Column:
    return R.keeps("infer_experiment", q_cut) & (R.lacks(R.PAIRED) | R.has(R.READ1) | R.has(R.READ2))


#: Names of the columns of inference_key.
PLACE = ("chrom", "start", "end", "paired", "own")


def inference_key() -> list[Column]:
    """chrom, start, end, paired, own: all that strand inference looks at."""
    number = F.when(R.lacks(R.PAIRED), "").when(R.has(R.READ1), "1").otherwise("2")
    return [F.col("chrom"), F.col("pos0").alias("start"), (F.col("pos0") + C.aligned_length()).alias("end"), R.has(R.PAIRED).alias("paired"), F.concat(number, R.strand()).alias("own")]


def inference_of(rows: DataFrame, tx: DataFrame, key: list[str], sample: int | None = None) -> DataFrame:
    """strand_inference of rows with inference_key that stand for n reads each and differ in ``key``; a sample needs rid there."""
    # A read needs the strands that hold it, not their transcripts: those of a strand are merged.  A read without bases is held where the
    # base before it is in the same transcript, so it meets ranges of its own.
    hollow = tx.select("chrom", (F.col("tx_start") + 1).alias("start"), F.col("tx_end").alias("end"), "strand", F.lit(True).alias("hollow"))
    spans = tx.select("chrom", F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), "strand", F.lit(False).alias("hollow")).unionByName(hollow)
    genes = merge(spans.where("strand is not null"), "hollow", "strand", "chrom").select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("strand").alias("gene"), "hollow")
    own = list(dict.fromkeys([*key, "paired", "own", "n"]))
    rows = rows.withColumns({"_empty": F.col("start") >= F.col("end"), "end": F.greatest("end", F.col("start") + 1)})
    met = overlap_join(rows, genes).where("hollow = _empty").groupBy(*own).agg(F.array_join(F.array_sort(F.collect_set("gene")), ":").alias("genes"))
    return first_rows(met, sample).groupBy("paired", F.concat("own", "genes").alias("key")).agg(F.sum("n").cast("long").alias("reads"))


SPEC1, SPEC2 = ("1++", "1--", "2+-", "2-+"), ("1+-", "1-+", "2++", "2--")
SINGLE1, SINGLE2 = ("++", "--"), ("+-", "-+")


def infer_experiment(reads: DataFrame, tx: DataFrame, sample: int | None = None, q_cut: int = 30) -> DataFrame:
    """protocol, spec1, spec2, other: fractions of reads that each strand rule explains."""
    return protocol_of(strand_inference(reads, tx, sample, q_cut))


def protocol_of(keys: DataFrame) -> DataFrame:
    """infer_experiment of the counts that strand_inference gives."""
    sums = keys.agg(
        F.coalesce(F.sum("reads"), F.lit(0)).alias("n"),
        F.count_if("paired").alias("pe"),
        F.count_if(~F.col("paired")).alias("se"),
        *[F.coalesce(F.sum(F.when(F.col("key").isin(*s), F.col("reads"))), F.lit(0)).alias(n) for n, s in (("p1", SPEC1), ("p2", SPEC2), ("s1", SINGLE1), ("s2", SINGLE2))],
    )
    one = F.when((F.col("pe") > 0) & (F.col("se") == 0), "PairEnd").when((F.col("se") > 0) & (F.col("pe") == 0), "SingleEnd").otherwise("Mixture")
    rows = sums.select(one.alias("protocol"), "n", F.when(one == "PairEnd", F.col("p1")).when(one == "SingleEnd", F.col("s1")).otherwise(0).alias("a"), F.when(one == "PairEnd", F.col("p2")).when(one == "SingleEnd", F.col("s2")).otherwise(0).alias("b"))
    share = lambda c: F.when((F.col("protocol") == "Mixture") | (F.col("n") == 0), F.lit(0.0)).otherwise(F.col(c) / F.greatest("n", F.lit(1)))
    rows = rows.select("protocol", share("a").alias("spec1"), share("b").alias("spec2"))
    return rows.withColumn("other", F.when(F.col("protocol") == "Mixture", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("spec1") - F.col("spec2"))))


def gene_counts(reads: DataFrame, exon_rows: DataFrame, q_cut: int = 10) -> DataFrame:
    """gene_id, reads: unstranded counts of reads whose blocks all lie over one gene only (non-empty intersection).

    Each block's genes are those that cover all of it; blocks without any are passed over.  Reads with the same blocks are counted first.
    """
    rows = reads.where(R.lacks(R.UNMAPPED | R.SECONDARY | R.QC_FAIL)).where(R.good_quality(q_cut)).where("pos0 is not null")
    rows = rows.select("rid", "chrom", C.exon_blocks().alias("b")).where(F.size("b") > 0)
    r_start, r_end = F.col("b")[0]["start"], F.element_at("b", -1)["end"]
    rows = rows.select("rid", "chrom", r_start.alias("r_start"), F.greatest(r_end, r_start + 1).alias("r_end"), F.expr("flatten(transform(b, x -> array(int(x.start - b[0].start), int(x.end - b[0].start))))").alias("places"))
    genes = exon_rows.where("gene_id is not null and start < end").groupBy("chrom", "gene_id").agg(F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("x"))
    genes = genes.select("chrom", F.col("gene_id").alias("id"), F.col("x.start").alias("starts"), F.col("x.end").alias("ends"), F.array_min("x.start").alias("start"), F.array_max("x.end").alias("end"))
    kind = exon_rows.schema["gene_id"].dataType.simpleString()
    found = at_home(genes, rows, (["starts", "ends"], [F.min("id").alias("gene_id"), F.count("*").alias("many")]), (["r_start", "places"], [F.count_distinct("rid").alias("n")]), sole_genes, f"gene_id {kind}, reads long")
    return found.groupBy("gene_id").agg(F.sum("reads").alias("reads"))
