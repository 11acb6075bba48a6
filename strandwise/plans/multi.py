"""Several reports in one pass over the reads.

One generator makes tagged rows (report, key) of a read, for all reports that are asked for; one aggregate counts them, with the first
rid of each key and the last record's values; the reports are made of that table.  So reads are decoded once, and what is shuffled is
bounded by keys: cycles, letters, qualities, flags, and places for the reports that need a gene model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import cigar as C
from strandwise.functions.sequence import oriented
from strandwise.operators import filters as R
from strandwise.operators import regions as G
from strandwise.operators import reports as P
from strandwise.sources.storage import stored

#: A tagged row: two texts, two numbers, and a value of which the last record's is kept.
_TAG = "struct<s:string,u:string,a:bigint,b:bigint,v:bigint>"


def _tag(s=None, u=None, a=None, b=None, v=None) -> Column:
    fields = {"s": (s, "string"), "u": (u, "string"), "a": (a, "bigint"), "b": (b, "bigint"), "v": (v, "bigint")}
    return F.struct(*[(F.lit(c) if c is None or isinstance(c, str | int) else c).cast(t).alias(k) for k, (c, t) in fields.items()])


def _one(**fields) -> Column:
    return F.array(_tag(**fields))


def _nvc_tags(o: dict) -> Column:
    seq = oriented(F.col("seq"), F.col("flag"))
    letters = F.filter(F.transform(F.split(seq, ""), lambda c, i: _tag(s=c, a=i)), lambda t: t["s"] != "")
    return F.concat(letters, _one(s="last", v=F.length("seq")))


def _quality_tags(o: dict) -> Column:
    return F.concat(F.coalesce(F.transform(P.unclipped_qualities(), lambda q, i: _tag(a=i, b=q)), F.array().cast(f"array<{_TAG}>")), _one(s="last", v=F.length("seq")))


def _cycle_tags(op: str) -> Callable[[dict], Column]:
    return lambda o: F.concat(F.transform(P.cycles(op), lambda p: _tag(a=p)), _one(s="last", v=C.expanded_length()))


def _inference_tags(o: dict) -> Column:
    _, start, end, paired, own = P.inference_key()
    return F.array(_tag(s=F.col("chrom"), u=F.concat(F.when(paired, "p").otherwise("s"), own), a=start, b=end))


def _rows(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counted rows, and the one row that holds the last record's value."""
    return tags.where("s is null or s <> 'last'"), tags.where("s = 'last'").agg(F.max("last").alias("last"))


def _nvc(tags: DataFrame, tx, o) -> DataFrame:
    rows, last = _rows(tags)
    return P.nvc_of(rows.select(F.col("a").cast("int").alias("pos"), F.col("s").alias("base"), "n"), last)


def _quality(tags: DataFrame, tx, o) -> DataFrame:
    rows, last = _rows(tags)
    counts = rows.select(F.col("a").cast("int").alias("pos"), F.col("b").cast("int").alias("quality"), F.col("n").alias("reads"))
    return counts.join(F.broadcast(last), F.col("pos") < F.col("last")).drop("last")


def _cycles(tags: DataFrame, tx, o) -> DataFrame:
    mate = F.lit(0).alias("mate")
    sizes = tags.where("s = 'last'").select(mate, F.col("n").alias("total"), "last")
    return P.cycles_of(sizes, tags.where("s is null").select(mate, F.col("a").alias("pos"), F.col("n").alias("with_op")))


def _inference(tags: DataFrame, tx: DataFrame, o) -> DataFrame:
    key = ["chrom", "start", "end", "paired", "own"]
    rows = tags.select(F.col("s").alias("chrom"), F.col("a").alias("start"), F.col("b").alias("end"), F.startswith("u", F.lit("p")).alias("paired"), F.substr("u", F.lit(2)).alias("own"), "n")
    return P.protocol_of(P.inference_of(rows, tx, key))


@dataclass
class Report:
    """keeps: which reads have rows; tags: their rows; made: the report of the counted rows (s, u, a, b, n, first, last)."""

    keeps: Callable[[dict], Column]
    tags: Callable[[dict], Column]
    made: Callable[[DataFrame, DataFrame | None, dict], DataFrame]
    model: bool = False
    #: The report by itself, for options that need more than counts.
    alone: Callable[..., DataFrame] | None = None


def _q(o: dict) -> int:
    return o.get("q_cut", 30)


def _length(o: dict) -> int:
    return o.get("length", 100)


#: New reports are added here.
REPORTS: dict[str, Report] = {
    "bam_stat": Report(
        lambda o: F.lit(True),
        lambda o: _one(s=P.stat_bucket(_q(o)), a=F.col("flag"), b=P.spliced().cast("int") + 2 * P.elsewhere().cast("int")),
        lambda t, tx, o: P.stat_of(t.select(F.col("a").cast("int").alias("flag"), F.col("s").alias("bucket"), (F.col("b") % 2 == 1).alias("spliced"), (F.col("b") >= 2).alias("elsewhere"), "n")),
    ),
    "read_gc": Report(
        lambda o: R.keeps("read_gc", _q(o)) & (F.length("seq") > 0),
        lambda o: _one(a=P.gc_bases(), b=F.length("seq")),
        lambda t, tx, o: t.select(F.col("a").cast("int").alias("gc"), F.col("b").cast("int").alias("length"), F.col("n").alias("reads"), F.col("first").alias("first_rid")),
    ),
    "read_nvc": Report(lambda o: R.keeps("read_nvc", _q(o)), _nvc_tags, _nvc),
    "read_quality": Report(lambda o: R.keeps("read_quality", _q(o)), _quality_tags, _quality),
    "clipping_profile": Report(lambda o: R.keeps("clipping_profile", _q(o)), _cycle_tags("S"), _cycles),
    "insertion_profile": Report(lambda o: R.keeps("insertion_profile", _q(o)), _cycle_tags("I"), _cycles),
    "deletion_profile": Report(
        lambda o: P.shows_deletions(_length(o), _q(o)),
        lambda o: F.transform(P.deletion_places(_length(o)), lambda p: _tag(a=p)),
        lambda t, tx, o: P.filled(t.select(F.col("a").alias("pos"), F.col("n").alias("deletions")), _length(o), ["deletions"]),
        alone=lambda reads, length=100, **o: P.deletion_profile(reads, length, **o),
    ),
    "mismatch_profile": Report(
        lambda o: P.shows_mismatches(_length(o), _q(o)) & F.col("_md").isNotNull(),
        lambda o: F.transform(P.mismatches("_md", _length(o)), lambda m: _tag(s=m["g"], a=m["pos"])),
        lambda t, tx, o: P.mismatches_of(t.select(F.col("a").alias("pos"), F.col("s").alias("g"), "n"), _length(o)),
        alone=lambda reads, length=100, **o: P.mismatch_profile(reads, length, **o),
    ),
    "infer_experiment": Report(lambda o: P.infers(_q(o)) & F.col("chrom").isNotNull() & F.col("pos0").isNotNull(), _inference_tags, _inference, True, P.infer_experiment),
    "read_distribution": Report(
        lambda o: R.keeps("read_distribution") & F.col("chrom").isNotNull(),
        lambda o: F.transform(G.block_middles(), lambda p: _tag(s=F.upper("chrom"), a=p)),
        lambda t, tx, o: G.distribution_of(t.select(F.col("s").alias("chrom"), F.col("a").alias("p"), "n"), tx),
        True,
    ),
}


def tagged_counts(reads: DataFrame, names: list[str], options: dict[str, dict] | None = None) -> DataFrame:
    """report, s, u, a, b, n, first, last: the counted tags of all named reports."""
    none = F.array().cast(f"array<{_TAG}>")

    def tagged(name: str) -> Column:
        o = (options or {}).get(name, {})
        tags = F.when(REPORTS[name].keeps(o), REPORTS[name].tags(o)).otherwise(none)
        return F.transform(F.coalesce(tags, none), lambda t: F.struct(F.lit(name).alias("report"), t.alias("t")))

    rows = reads.withColumn("_md", F.expr("element_at(tags, 'MD').s")).select("rid", F.explode(F.concat(*map(tagged, names))).alias("x"))
    keys = [F.col("x.report").alias("report"), *[F.col(f"x.t.{k}").alias(k) for k in "suab"]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rid").alias("first"), F.max_by("x.t.v", "rid").alias("last"))


def run_reports(reads: DataFrame, names: list[str], tx: DataFrame | None = None, options: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """The named reports by name, of one pass over the reads; the counted tags are stored while the reports are made.

    options: by report; ``most`` and ``sample`` ask for the first reads in file order, so such a report reads by itself.
    """
    unknown = [n for n in names if n not in REPORTS]
    if unknown:
        raise ValueError(f"no such reports: {', '.join(unknown)}")
    lacking = [n for n in names if REPORTS[n].model and tx is None]
    if lacking:
        raise ValueError(f"a gene model is needed for {', '.join(lacking)}")
    options = options or {}
    alone = [n for n in names if any(options.get(n, {}).get(k) is not None for k in ("most", "sample"))]
    together = [n for n in names if n not in alone]
    out = {n: REPORTS[n].alone(reads, *([tx] if REPORTS[n].model else []), **options[n]) for n in alone}
    if together:
        tags = stored(tagged_counts(reads, together, options), "reports")
        out |= {n: REPORTS[n].made(tags.where(F.col("report") == n).drop("report"), tx, options.get(n, {})) for n in together}
    return {n: out[n] for n in names}
