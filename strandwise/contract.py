"""The driver's queries over the projected tables, each with DuckDB SQL made from the rules and not from our kernels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import cigar as C
from strandwise.operators import coverage as V
from strandwise.operators import expression as X
from strandwise.operators import filters as R
from strandwise.operators import intervals as I
from strandwise.operators import records as O
from strandwise.operators import regions as G
from strandwise.operators import reports as P
from strandwise.operators import sequences as S
from strandwise.operators import tracks as T
from strandwise.operators import windows as N
from strandwise.operators.genes import exons
from strandwise.plans import views as D

QUERIES, ORACLES = {}, {}

#: What each alignment template holds: kind, number, offset on the reference, length, offset in the read.
_PARTS = [
    (0, "M", 0, 0, 32, 0), (1, "M", 0, 0, 10, 0), (1, "N", 0, 10, 100, 10), (1, "M", 1, 110, 22, 10), (2, "S", 0, 0, 4, 0), (2, "M", 0, 4, 28, 4),
    (3, "M", 0, 0, 16, 0), (3, "I", 0, 16, 2, 16), (3, "M", 1, 16, 14, 18), (4, "M", 0, 0, 10, 0), (4, "D", 0, 10, 5, 10), (4, "M", 1, 15, 22, 10),
    (5, "M", 0, 0, 12, 0), (5, "N", 0, 12, 80, 12), (5, "M", 1, 92, 8, 12), (5, "N", 1, 100, 60, 20), (5, "M", 2, 160, 12, 20), (6, "M", 0, 0, 28, 0), (6, "S", 0, 28, 4, 28),
]
_SPANS = [(0, 32, 32, 0), (1, 132, 32, 100), (2, 28, 28, 0), (3, 30, 32, 0), (4, 37, 32, 0), (5, 172, 32, 140), (6, 28, 28, 0)]
_WITH = f"""WITH reads AS ({D.READS_SQL}),
parts AS (SELECT * FROM (VALUES {', '.join(str(p) for p in _PARTS)}) v(t, op, i, off, len, roff)),
spans AS (SELECT * FROM (VALUES {', '.join(str(p) for p in _SPANS)}) v(t, span, qlen, gap)),
tx0 AS (SELECT *, p.line * 7 AS seed FROM ({D.TRANSCRIPTS_SQL}) p),
exons AS (SELECT tx_id, chrom, strand, tx_start, line, nb, k, tx_start + k * 400 AS start, tx_start + k * 400 + 150 + (seed + k * 31) % 200 AS "end" FROM (SELECT *, unnest(range(nb)) AS k FROM tx0)),
tx AS (SELECT tx_id, any_value(chrom) AS chrom, any_value(strand) AS strand, any_value(tx_start) AS tx_start, max("end") AS tx_end, any_value(line) AS line, sum("end" - start) AS length FROM exons GROUP BY tx_id),
introns AS (SELECT * FROM (SELECT tx_id, chrom, "end" AS start, lead(start) OVER (PARTITION BY tx_id ORDER BY k) AS "end" FROM exons) WHERE "end" IS NOT NULL AND start < "end"),
a AS ({D.RANGES_A}), b AS ({D.RANGES_B}), ta AS ({D.TRACK_A}), tb AS ({D.TRACK_B})
"""


def _bits(*bits: int) -> str:
    return " AND ".join(f"flag & {b} = 0" for b in bits)


_LIVE = _bits(512, 1024, 256, 4)
_GC = _bits(512, 4) + " AND mapq >= 30"
_FULL = _LIVE + " AND mapq >= 30"
_JOIN = "reads r JOIN parts p ON r.t = p.t"


def _merge_sql(source: str, name: str) -> str:
    """CTEs that merge the ranges of ``source`` into ``name``."""
    return f"""{name}_0 AS (SELECT chrom, start, "end" FROM {source} WHERE start < "end"),
{name}_1 AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {name}_0),
{name}_2 AS (SELECT *, sum(CASE WHEN top IS NULL OR start > top THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}_1),
{name} AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM {name}_2 GROUP BY chrom, g)"""


def _subtract_sql(left: str, right: str, name: str) -> str:
    """CTEs for merged left minus merged right."""
    return _merge_sql(left, name + "_a") + ",\n" + _merge_sql(right, name + "_b") + f""",
{name}_e AS (
  SELECT chrom, x AS pt, sum(da) AS da, sum(db) AS db FROM (
    SELECT chrom, start AS x, 1 AS da, 0 AS db FROM {name}_a UNION ALL SELECT chrom, "end", -1, 0 FROM {name}_a
    UNION ALL SELECT chrom, start, 0, 1 FROM {name}_b UNION ALL SELECT chrom, "end", 0, -1 FROM {name}_b) GROUP BY 1, 2),
{name}_s AS (SELECT chrom, pt AS start, lead(pt) OVER (PARTITION BY chrom ORDER BY pt) AS "end", sum(da) OVER w AS na, sum(db) OVER w AS nb FROM {name}_e WINDOW w AS (PARTITION BY chrom ORDER BY pt)),
{name}_p AS (SELECT chrom, start, "end" FROM {name}_s WHERE na > 0 AND nb = 0 AND "end" IS NOT NULL),
""" + _merge_sql(name + "_p", name)


def _coverage_sql(source: str, keys: str = "chrom") -> str:
    """CTEs that end in ``runs``: depth between events of ``source``."""
    return f"""ev AS (SELECT {keys}, x AS start, sum(d) AS d FROM (SELECT {keys}, start AS x, 1 AS d FROM {source} WHERE start < "end" UNION ALL SELECT {keys}, "end", -1 FROM {source} WHERE start < "end") GROUP BY ALL HAVING sum(d) <> 0),
runs AS (SELECT * FROM (SELECT {keys}, start, lead(start) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY {keys} ORDER BY start)) WHERE depth <> 0)"""


def _kept(ctes: str) -> str:
    """Every common table expression is worked out once."""
    return re.sub(r"(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", ctes)


def query(sql: str | None = None, ctes: str = ""):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _kept(_WITH + (", " + ctes if ctes else "")) + "\n" + sql
        return f

    return add


_BUCKET = "CASE WHEN flag & 512 <> 0 THEN 'qc' WHEN flag & 1024 <> 0 THEN 'dup' WHEN flag & 256 <> 0 THEN 'sec' WHEN flag & 4 <> 0 THEN 'unm' WHEN mapq < 30 THEN 'multi' ELSE 'u' END"


@query(f"""SELECT count(*) AS total, count(*) FILTER (b = 'qc') AS qc_fail, count(*) FILTER (b = 'dup') AS duplicate, count(*) FILTER (b = 'sec') AS non_primary,
count(*) FILTER (b = 'unm') AS unmapped, count(*) FILTER (b = 'multi') AS multi, count(*) FILTER (b = 'u') AS "unique",
count(*) FILTER (b = 'u' AND flag & 64 <> 0) AS read1, count(*) FILTER (b = 'u' AND flag & 128 <> 0) AS read2, count(*) FILTER (b = 'u' AND flag & 16 = 0) AS forward,
count(*) FILTER (b = 'u' AND flag & 16 <> 0) AS reverse, count(*) FILTER (b = 'u' AND t NOT IN (1, 5)) AS non_splice, count(*) FILTER (b = 'u' AND t IN (1, 5)) AS splice,
count(*) FILTER (b = 'u' AND flag & 2 <> 0) AS proper_pair, count(*) FILTER (b = 'u' AND flag & 2 <> 0 AND chrom <> mate_chrom) AS proper_other_contig
FROM (SELECT *, {_BUCKET} AS b FROM reads)""")
def bam_stat(spark: SparkSession, sf: str) -> DataFrame:
    return P.bam_stat(D.reads(spark, sf))


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS report, count(*) AS kept FROM reads WHERE flag & {bits} = 0" + (" AND mapq >= 30" if by_quality else "") for name, (bits, by_quality) in R.POLICIES.items()))
def read_filter_matrix(spark, sf):
    return P.filter_matrix(D.reads(spark, sf))


@query(f"SELECT CAST(32 - length(replace(replace(seq, 'G', ''), 'C', '')) AS INTEGER) AS gc, CAST(32 AS INTEGER) AS length, count(*) AS reads, min(rid) AS first_rid FROM reads WHERE {_GC} GROUP BY 1")
def read_gc(spark, sf):
    return P.read_gc(D.reads(spark, sf))


_ORIENTED = "CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END"


@query("SELECT CAST(i AS INTEGER) AS pos, " + ", ".join(f"count(*) FILTER (c = '{b}') AS {b}" for b in "ACGTNX") + f" FROM (SELECT i, substr({_ORIENTED}, CAST(i + 1 AS INTEGER), 1) AS c FROM reads, range(32) x(i) WHERE mapq >= 30) GROUP BY i")
def read_nvc(spark, sf):
    return P.read_nvc(D.reads(spark, sf))


@query("""SELECT CAST(pos AS INTEGER) AS pos, CAST(ascii(c) - 33 AS INTEGER) AS quality, count(*) AS reads FROM (
  SELECT i AS pos, substr(CASE WHEN flag & 16 <> 0 THEN reverse(k) ELSE k END, CAST(i + 1 AS INTEGER), 1) AS c
  FROM (SELECT flag, CASE t WHEN 2 THEN substr(qual_text, 5) WHEN 6 THEN substr(qual_text, 1, 28) ELSE qual_text END AS k FROM reads WHERE mapq >= 30), range(32) x(i))
WHERE c <> '' GROUP BY 1, 2""")
def read_quality(spark, sf):
    return P.read_quality(D.reads(spark, sf))


@query(f"SELECT occurrence, count(*) AS keys FROM (SELECT count(*) AS occurrence FROM reads WHERE {_GC} GROUP BY seq) GROUP BY 1")
def read_duplication_sequence(spark, sf):
    return P.duplication(D.reads(spark, sf), "sequence")


@query(f"SELECT occurrence, count(*) AS keys FROM (SELECT count(*) AS occurrence FROM (SELECT chrom, pos0, string_agg(CAST(pos0 + off AS VARCHAR) || '-' || CAST(pos0 + off + len AS VARCHAR), ':' ORDER BY i) AS k FROM {_JOIN} WHERE op = 'M' AND {_GC} GROUP BY rid, seq, flag, chrom, pos0) GROUP BY chrom, pos0, k) GROUP BY 1")
def read_duplication_position(spark, sf):
    return P.duplication(D.reads(spark, sf), "position")


def _profile_sql(op: str, pairs: bool) -> str:
    mate = "CASE WHEN flag & 64 <> 0 THEN 1 ELSE 2 END" if pairs else "0"
    cond = _GC + (" AND flag & 1 <> 0" if pairs else "")
    return f"""SELECT CAST(m AS INTEGER) AS mate, CAST(x.i AS BIGINT) AS pos, coalesce(h.n, 0) AS with_op, total - coalesce(h.n, 0) AS without_op
FROM (SELECT {mate} AS m, count(*) AS total FROM reads WHERE {cond} GROUP BY 1) CROSS JOIN range(32) x(i)
LEFT JOIN (SELECT {mate} AS hm, CASE WHEN flag & 16 <> 0 THEN 31 - (roff + y.j) ELSE roff + y.j END AS q, count(*) AS n FROM {_JOIN}, range(4) y(j) WHERE op = '{op}' AND j < len AND {cond} GROUP BY 1, 2) h ON h.hm = m AND h.q = x.i"""


@query(_profile_sql("S", False))
def clipping_profile(spark, sf):
    return P.cycle_profile(D.reads(spark, sf), "S", "clipping_profile")


@query(_profile_sql("S", True))
def clipping_profile_pairs(spark, sf):
    return P.cycle_profile(D.reads(spark, sf), "S", "clipping_profile", pairs=True)


@query(_profile_sql("I", False))
def insertion_profile(spark, sf):
    return P.cycle_profile(D.reads(spark, sf), "I", "insertion_profile")


@query(f"SELECT CAST(i AS BIGINT) AS pos, coalesce(n, 0) AS deletions FROM range(32) x(i) LEFT JOIN (SELECT CASE WHEN flag & 16 <> 0 THEN 22 ELSE 10 END AS p, count(*) AS n FROM reads WHERE t = 4 AND {_FULL} GROUP BY 1) ON p = i")
def deletion_profile(spark, sf):
    return P.deletion_profile(D.reads(spark, sf), 32)


@query("SELECT CAST(x.i AS BIGINT) AS pos, coalesce(n, 0) AS \"sum\", " + ", ".join(f"coalesce(g{g}, 0) AS \"{g}\"" for g in P.GENOTYPES) + f""" FROM range(32) x(i) LEFT JOIN (
SELECT CASE WHEN flag & 16 <> 0 THEN 31 - k ELSE k END AS p, count(*) AS n, """ + ", ".join(f"count(*) FILTER (g = '{g}') AS g{g}" for g in P.GENOTYPES) + f"""
FROM (SELECT flag, (rid - l) // 1001 % 200001 % 32 AS k, translate(c, 'ACGT', 'CGTA') || '2' || c AS g FROM (
  SELECT *, rid % 1001 AS l, substr(seq, CAST((rid - rid % 1001) // 1001 % 200001 % 32 + 1 AS INTEGER), 1) AS c FROM reads WHERE t IN (0, 1, 4, 5) AND nm = 1 AND {_FULL})) GROUP BY 1) ON p = x.i""")
def mismatch_profile(spark, sf):
    return P.mismatch_profile(D.reads(spark, sf, "MD", "NM"), 32)


@query("""SELECT k AS kmer, coalesce(n, 0) AS reads, round(coalesce(n, 0) / (SELECT sum(n) FROM h), 12) AS frequency FROM (
  SELECT a.c || b.c || c.c || d.c || e.c || f.c AS k FROM l a, l b, l c, l d, l e, l f) LEFT JOIN h ON h.w = k""",
       "l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), h AS (SELECT substr(seq, CAST(i + 1 AS INTEGER), 6) AS w, count(*) AS n FROM reads, range(27) x(i) GROUP BY 1)")
def read_hexamer(spark, sf):
    return S.hexamer_counts(D.reads(spark, sf)).withColumn("frequency", F.round("frequency", 12))


@query("""SELECT side, k AS kmer, coalesce(n, 0) AS reads, round(coalesce(n, 0) / (SELECT sum(n) FROM h WHERE h.g = side), 12) AS frequency FROM (
  SELECT side, a.c || b.c || c.c || d.c || e.c || f.c AS k FROM l a, l b, l c, l d, l e, l f, (VALUES ('+'), ('-')) v(side)) LEFT JOIN h ON h.w = k AND h.g = side""",
       "l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), h AS (SELECT CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS g, substr(seq, CAST(i + 1 AS INTEGER), 6) AS w, count(*) AS n FROM reads, range(27) x(i) GROUP BY 1, 2)")
def read_hexamer_sides(spark, sf):
    return S.hexamer_counts(D.reads(spark, sf).select("seq", R.strand().alias("side")), by="side").withColumn("frequency", F.round("frequency", 12))


@query(f"""SELECT paired, own || g AS key, count(*) AS reads FROM (
  SELECT rid, any_value(paired) AS paired, any_value(own) AS own, string_agg(DISTINCT strand, ':' ORDER BY strand) AS g FROM (
    SELECT r.rid, flag & 1 <> 0 AS paired, CASE WHEN flag & 1 = 0 THEN '' WHEN flag & 64 <> 0 THEN '1' ELSE '2' END || CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS own, tx.strand
    FROM reads r JOIN spans s ON r.t = s.t JOIN tx ON tx.chrom = r.chrom AND pos0 < tx_end AND tx_start < pos0 + qlen WHERE {_FULL}) GROUP BY rid) GROUP BY 1, 2""")
def infer_experiment_keys(spark, sf):
    return P.strand_inference(D.reads(spark, sf), D.transcripts(spark, sf))


_REGION_CTES = (
    'cds0 AS (SELECT e.chrom, greatest(start, tx.tx_start + 60) AS start, least("end", tx_end - 60) AS "end" FROM exons e JOIN tx USING (tx_id)), '
    "ul AS (SELECT e.chrom, e.strand, start, least(\"end\", tx.tx_start + 60) AS \"end\" FROM exons e JOIN tx USING (tx_id) WHERE start < tx.tx_start + 60), "
    "ur AS (SELECT e.chrom, e.strand, greatest(start, tx_end - 60) AS start, \"end\" FROM exons e JOIN tx USING (tx_id) WHERE \"end\" > tx_end - 60), "
    "u5 AS (SELECT chrom, start, \"end\" FROM ul WHERE strand = '+' UNION ALL SELECT chrom, start, \"end\" FROM ur WHERE strand = '-'), "
    "u3 AS (SELECT chrom, start, \"end\" FROM ur WHERE strand = '+' UNION ALL SELECT chrom, start, \"end\" FROM ul WHERE strand = '-'), "
    + _merge_sql("cds0", "r1") + ", " + _subtract_sql("u5", "r1", "r2") + ", " + _subtract_sql("u3", "r1", "r3")
    + ", gene AS (SELECT chrom, start, \"end\" FROM r1 UNION ALL SELECT chrom, start, \"end\" FROM r2 UNION ALL SELECT chrom, start, \"end\" FROM r3), "
    + _subtract_sql("introns", "gene", "r4")
    + ", body AS (SELECT chrom, start, \"end\" FROM gene UNION ALL SELECT chrom, start, \"end\" FROM r4), "
    + ", ".join(
        f"f{k} AS (SELECT chrom, CASE WHEN strand {op} '-' THEN greatest(tx_start - {n}, 0) ELSE tx_end END AS start, CASE WHEN strand {op} '-' THEN tx_start ELSE tx_end + {n} END AS \"end\" FROM tx), " + _subtract_sql(f"f{k}", "body", f"r{k}")
        for k, n, op in ((5, 1000, "<>"), (6, 5000, "<>"), (7, 10000, "<>"), (8, 1000, "="), (9, 5000, "="), (10, 10000, "=")))
    + ", reg AS (" + " UNION ALL ".join(f"SELECT {k} AS k, chrom, start, \"end\" FROM r{k}" for k in range(1, 11)) + "), "
    + f"tags AS (SELECT row_number() OVER () AS tid, r.chrom, pos0 + off + len // 2 AS p FROM {_JOIN} WHERE op = 'M' AND {_LIVE}), "
    + "hit AS (SELECT tid, p, bit_or(1 << k) AS m FROM tags t JOIN reg ON reg.chrom = t.chrom AND start < p AND p < \"end\" GROUP BY tid, p), "
    + "spot AS (SELECT CASE WHEN m & 2 <> 0 THEN 1 WHEN m & 12 = 12 THEN 0 WHEN m & 4 <> 0 THEN 2 WHEN m & 8 <> 0 THEN 3 WHEN m & 16 <> 0 THEN 4 WHEN m & 128 <> 0 AND m & 1024 <> 0 THEN 0"
    + " WHEN m & 32 <> 0 THEN 5 WHEN m & 64 <> 0 THEN 6 WHEN m & 128 <> 0 THEN 7 WHEN m & 256 <> 0 THEN 8 WHEN m & 512 <> 0 THEN 9 WHEN m & 1024 <> 0 THEN 10 ELSE 0 END AS s FROM hit)"
)


@query("SELECT n AS name, CAST(bases AS BIGINT) AS bases, tags, round(tags * 1000 / (bases + 1), 6) AS tags_per_kb FROM (" + " UNION ALL ".join(
    f"SELECT '{G.GROUPS[k - 1].replace(chr(39), chr(39) * 2)}' AS n, (SELECT coalesce(sum(\"end\" - start), 0) FROM r{k}) AS bases, (SELECT count(*) FROM spot WHERE s BETWEEN {lo} AND {k}) AS tags"
    for k, lo in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (10, 8))) + ")", _REGION_CTES)
def read_distribution(spark, sf):
    return G.read_distribution(D.reads(spark, sf), D.transcripts(spark, sf)).withColumn("tags_per_kb", F.round("tags_per_kb", 6))


_DISTANCE_CTES = _merge_sql("exons", "mx") + f""",
pr AS (SELECT r.rid, qname, r.chrom, chrom <> mate_chrom AS apart, pos0, mate_pos0 AS mate, pos0 + qlen + gap AS done FROM reads r JOIN spans s ON r.t = s.t
  WHERE {_FULL} AND flag & 1 <> 0 AND flag & 8 = 0 AND mate_pos0 >= pos0 AND (mate_pos0 > pos0 OR flag & 64 = 0)),
own AS (SELECT pr.rid, sum(greatest(0, least(r.pos0 + off + len, done) - greatest(r.pos0 + off, mate))) AS n FROM pr JOIN reads r ON r.rid = pr.rid JOIN parts p ON p.t = r.t WHERE op = 'M' GROUP BY pr.rid),
g AS (SELECT pr.*, CASE WHEN mate >= done THEN mate - done ELSE -own.n END AS gap FROM pr JOIN own USING (rid)),
kt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY line) AS n FROM tx) WHERE n > 1),
sm AS (SELECT DISTINCT rid FROM g JOIN kt ON kt.chrom = g.chrom AND tx_start <= done - 1 AND done - 1 < tx_end AND tx_start <= mate AND mate < tx_end WHERE NOT apart),
sz AS (SELECT rid, sum(least(mate, "end") - greatest(done, start)) AS size FROM g JOIN mx ON mx.chrom = g.chrom AND start < mate AND done < "end" WHERE gap > 0 AND NOT apart GROUP BY rid),
dist AS (SELECT g.rid, qname, CAST(CASE WHEN apart THEN NULL WHEN sm.rid IS NOT NULL AND gap > 0 AND coalesce(size, 0) BETWEEN 1 AND gap THEN size ELSE gap END AS BIGINT) AS distance,
  CASE WHEN apart THEN 'sameChrom=No' WHEN sm.rid IS NULL THEN 'sameTranscript=No,dist=genomic' WHEN gap <= 0 THEN 'readPairOverlap' WHEN coalesce(size, 0) = gap THEN 'sameTranscript=Yes,sameExon=Yes,dist=mRNA'
    WHEN coalesce(size, 0) BETWEEN 1 AND gap - 1 THEN 'sameTranscript=Yes,sameExon=No,dist=mRNA' ELSE 'sameTranscript=Yes,nonExonic=Yes,dist=genomic' END AS label
  FROM g LEFT JOIN sm USING (rid) LEFT JOIN sz USING (rid))"""


@query("SELECT rid, qname, coalesce(CAST(distance AS VARCHAR), 'NA') AS distance, label FROM dist", _DISTANCE_CTES)
def inner_distance(spark, sf):
    return G.inner_distance(D.reads(spark, sf), D.transcripts(spark, sf)).withColumn("distance", F.coalesce(F.col("distance").cast("string"), F.lit("NA")))


@query("SELECT CAST(b AS BIGINT) AS bin_start, CAST(b + 5 AS BIGINT) AS bin_end, (SELECT count(*) FROM dist WHERE distance > b AND distance <= b + 5) AS pairs FROM range(-250, 250, 5) x(b)", _DISTANCE_CTES)
def inner_distance_histogram(spark, sf):
    return G.inner_distance_histogram(G.inner_distance(D.reads(spark, sf), D.transcripts(spark, sf)))


@query("SELECT round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(stddev_samp(c), 6) AS std FROM (SELECT (bin_start + bin_end) / 2.0::DOUBLE AS c, unnest(range(pairs)) FROM (" + ORACLES["inner_distance_histogram"] + "))")
def inner_distance_summary(spark, sf):
    rows = G.inner_distance_histogram(G.inner_distance(D.reads(spark, sf), D.transcripts(spark, sf)))
    return G.distance_summary(rows).select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@query("""SELECT tx_id, coalesce(n, 0) AS fragments, round(CASE WHEN n >= 3 THEN mean ELSE 0 END, 6) AS mean, round(CASE WHEN n >= 3 THEN med ELSE 0 END, 6) AS median, round(CASE WHEN n >= 3 THEN sd ELSE 0 END, 6) AS std
FROM tx LEFT JOIN (SELECT tx_id, count(*) AS n, avg(size) AS mean, quantile_cont(size, 0.5) AS med, stddev_pop(size) AS sd FROM fs GROUP BY tx_id) USING (tx_id)""",
       f"""fr AS (SELECT r.rid, chrom, pos0, span, least(pos0, mate_pos0) AS lo, greatest(pos0, mate_pos0) AS hi FROM reads r JOIN spans s ON r.t = s.t WHERE {_bits(512, 1024, 256)} AND mapq >= 30 AND flag & 1 <> 0 AND flag & 128 = 0 AND flag & 8 = 0),
fm AS (SELECT tx_id, rid, lo, hi FROM fr JOIN tx ON tx.chrom = fr.chrom AND pos0 < tx_end AND tx_start < pos0 + span AND lo >= tx_start AND hi <= tx_end),
fs AS (SELECT tx_id, rid, CAST(32 + sum(greatest(0, least(e."end" + 1, hi) - greatest(e.start + 1, lo + 1) + 1)) AS BIGINT) AS size FROM fm JOIN exons e USING (tx_id) GROUP BY tx_id, rid, lo, hi)""")
def fragment_size(spark, sf):
    return G.fragment_size(D.reads(spark, sf), D.transcripts(spark, sf)).select("tx_id", "fragments", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


_JUNCTION_CTES = f"""sj AS (SELECT rid, i, r.chrom, pos0 + off AS start, pos0 + off + len AS "end" FROM {_JOIN} WHERE op = 'N' AND {_FULL}),
jx AS (SELECT chrom, start, "end", count(*) AS reads, min(rid) AS first_rid FROM sj WHERE "end" - start >= 50 GROUP BY ALL),
ja AS (SELECT jx.*, EXISTS (SELECT 1 FROM introns n WHERE n.chrom = jx.chrom AND n.start = jx.start) AS l, EXISTS (SELECT 1 FROM introns n WHERE n.chrom = jx.chrom AND n."end" = jx."end") AS r FROM jx)"""


@query("SELECT chrom, start, \"end\", reads, first_rid, CASE WHEN l AND r THEN 'annotated' WHEN l OR r THEN 'partial_novel' ELSE 'complete_novel' END AS kind FROM ja", _JUNCTION_CTES)
def junction_annotation(spark, sf):
    return G.junction_annotation(D.reads(spark, sf), D.transcripts(spark, sf))


@query("""SELECT (SELECT count(*) FROM sj) AS events, (SELECT count(*) FROM sj WHERE "end" - start < 50) AS filtered,
CAST(coalesce(sum(CASE WHEN l AND r THEN reads END), 0) AS BIGINT) AS annotated_events, CAST(coalesce(sum(CASE WHEN l <> r THEN reads END), 0) AS BIGINT) AS partial_novel_events, CAST(coalesce(sum(CASE WHEN NOT l AND NOT r THEN reads END), 0) AS BIGINT) AS complete_novel_events,
count(*) FILTER (l AND r) AS annotated_junctions, count(*) FILTER (l <> r) AS partial_novel_junctions, count(*) FILTER (NOT l AND NOT r) AS complete_novel_junctions FROM ja""", _JUNCTION_CTES)
def junction_summary(spark, sf):
    return G.junction_summary(D.reads(spark, sf), D.transcripts(spark, sf))


_DRAW = "CAST('0x' || substr(md5(CAST(rid AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|0'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * 100"
_PERCENTS = [*range(5, 100, 5), 100]
_STEPS = f"ps AS (SELECT unnest({_PERCENTS}) AS percent)"


@query("""SELECT CAST(percent AS INTEGER) AS percent, (SELECT count(*) FROM jf WHERE pt < percent) AS "all", (SELECT count(*) FROM jf WHERE pt < percent AND k) AS known, (SELECT count(*) FROM jf WHERE pt < percent AND NOT k) AS novel FROM ps""",
       _JUNCTION_CTES + f""", {_STEPS}, jf AS (SELECT chrom, start, "end", min({_DRAW}) AS pt, any_value(EXISTS (SELECT 1 FROM introns n WHERE n.chrom = sj.chrom AND n.start = sj.start AND n."end" = sj."end")) AS k
FROM sj WHERE "end" - start >= 50 AND chrom IN (SELECT chrom FROM tx) GROUP BY chrom, start, "end")""")
def junction_saturation(spark, sf):
    return G.junction_saturation(D.reads(spark, sf), D.transcripts(spark, sf))


_SIGNAL = f"""mb AS (SELECT '.' AS strand, r.chrom, pos0 + off AS start, pos0 + off + len AS "end" FROM {_JOIN} WHERE op = 'M' AND {_LIVE}), """ + _coverage_sql("mb", "strand, chrom")


@query("SELECT strand, chrom, start, \"end\", depth FROM runs", _SIGNAL)
def bam2wig_signal(spark, sf):
    return V.signal(D.reads(spark, sf))


@query("SELECT strand, chrom, start, \"end\", depth FROM runs", _SIGNAL.replace(_LIVE, _FULL))
def bam2wig_unique(spark, sf):
    return V.signal(D.reads(spark, sf), unique=True)


@query("""SELECT strand, chrom, start, "end", depth, round(CASE WHEN strand = '-' THEN -1 ELSE 1 END * depth * 1e6::DOUBLE / (SELECT sum("end" - start) FROM mb), 6) AS value FROM runs""",
       f"""mb AS (SELECT CASE WHEN (flag & 64 <> 0) = (flag & 16 = 0) THEN '+' ELSE '-' END AS strand, r.chrom, pos0 + off AS start, pos0 + off + len AS "end" FROM {_JOIN} WHERE op = 'M' AND {_LIVE} AND flag & 1 <> 0), """ + _coverage_sql("mb", "strand, chrom"))
def bam2wig_stranded(spark, sf):
    return V.scaled_signal(D.reads(spark, sf).where(R.has(R.PAIRED)), 1e6, "1++,1--,2+-,2-+").withColumn("value", F.round("value", 6))


@query("""SELECT strand, chrom, start, "end", depth, round(depth * 1e6::DOUBLE / (SELECT sum("end" - start) FROM mb), 6) AS value FROM runs""",
       f"""mb AS (SELECT '.' AS strand, r.chrom, pos0 + off AS start, pos0 + off + len AS "end" FROM {_JOIN} WHERE op = 'M' AND {_LIVE} AND r.chrom IN ('chr1', 'chr3')), """ + _coverage_sql("mb", "strand, chrom"))
def bam2wig_listed(spark, sf):
    contigs = spark.createDataFrame([("chr1", 1_000_500), ("chr3", 1_000_500)], "chrom string, length long")
    return V.scaled_signal(D.reads(spark, sf), 1e6, contigs=contigs).withColumn("value", F.round("value", 6))


@query(f"SELECT CAST(sum(len) AS BIGINT) AS bases FROM {_JOIN} WHERE op = 'M' AND {_LIVE}")
def bam2wig_sum(spark, sf):
    return V.signal_sum(D.reads(spark, sf))


@query("""SELECT rid, CAST(CASE WHEN flag & 64 <> 0 THEN 1 ELSE 2 END AS INTEGER) AS mate, qname || CASE WHEN flag & 64 <> 0 THEN '/1' ELSE '/2' END AS name,
CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual_text) ELSE qual_text END AS qual FROM reads WHERE flag & 192 <> 0""")
def fastq_rows(spark, sf):
    return O.fastq_rows(D.reads(spark, sf))


@query("SELECT rid, CAST(CAST('0x' || substr(md5(qname || '|0'), 1, 12) AS BIGINT) % 3 AS INTEGER) AS subset FROM reads")
def divide_reads(spark, sf):
    return O.divide_reads(D.reads(spark, sf), 3).select("rid", "subset")


@query("""SELECT rid, CASE WHEN flag & 516 <> 0 THEN 'junk' WHEN EXISTS (SELECT 1 FROM mx WHERE mx.chrom = r.chrom AND ((start <= pos0 AND pos0 < "end") OR (flag & 8 = 0 AND start <= mate_pos0 AND mate_pos0 < "end"))) THEN 'in' ELSE 'ex' END AS category FROM reads r""", _merge_sql("exons", "mx"))
def split_reads(spark, sf):
    return O.split_reads(D.reads(spark, sf), D.transcripts(spark, sf)).select("rid", "category")


@query("""SELECT rid, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 64 <> 0 THEN 'R1' ELSE 'R2' END AS output, CAST(CASE WHEN flag & 4 <> 0 THEN flag ELSE flag & 1808 END AS INTEGER) AS flag, coalesce(CAST(CASE WHEN flag & 4 <> 0 THEN mate_pos0 END AS VARCHAR), '*') AS mate_pos0, CASE WHEN flag & 4 <> 0 THEN tlen ELSE 0 END AS tlen FROM reads""")
def split_pairs(spark, sf):
    return O.split_pairs(D.reads(spark, sf)).select("rid", "output", "flag", F.coalesce(F.col("mate_pos0").cast("string"), F.lit("*")).alias("mate_pos0"), "tlen")


_FRAGMENTS = f"""w AS (SELECT r.*, greatest(span, 1) AS sp, CASE WHEN flag & 1 = 0 THEN 1.0 WHEN flag & 128 <> 0 OR flag & 12 = 12 THEN 0.0 ELSE 1.0 END AS w FROM reads r JOIN spans s ON r.t = s.t WHERE {_bits(512, 1024, 256)}),
tf AS (SELECT tx_id, sum(w) AS n FROM (SELECT DISTINCT tx.tx_id, w.rid, w.w FROM w JOIN tx ON tx.chrom = w.chrom AND pos0 < tx_end AND tx.tx_start < pos0 + sp JOIN exons e ON e.tx_id = tx.tx_id
  AND CASE WHEN flag & 1 = 0 THEN e.start < pos0 + 32 AND pos0 < e."end" ELSE (e.start <= pos0 AND pos0 < e."end") OR (e.start <= mate_pos0 AND mate_pos0 < e."end") END WHERE w.w > 0) GROUP BY tx_id)"""


@query("SELECT tx_id, CAST(coalesce(n, 0) AS DOUBLE) AS fragments, round(CAST(coalesce(n, 0) AS DOUBLE) * 1e6 / big, 6) AS fpm, round(CAST(coalesce(n, 0) AS DOUBLE) * 1e9 / (big * length), 6) AS fpkm FROM tx LEFT JOIN tf USING (tx_id), (SELECT CAST(sum(w) AS DOUBLE) AS big FROM w)", _FRAGMENTS)
def fpkm(spark, sf):
    return X.fpkm(D.reads(spark, sf), D.transcripts(spark, sf)).select("tx_id", "fragments", F.round("fpm", 6).alias("fpm"), F.round("fpkm", 6).alias("fpkm"))


@query("""SELECT CAST(sum(w) AS DOUBLE) AS total, CAST(coalesce(sum(CASE WHEN CASE WHEN flag & 1 = 0 OR (flag & 4 = 0 AND flag & 8 <> 0) THEN o WHEN flag & 4 <> 0 THEN m ELSE o AND m END THEN w END), 0) AS DOUBLE) AS exonic FROM (
SELECT w, flag, EXISTS (SELECT 1 FROM mx WHERE mx.chrom = w.chrom AND start < pos0 + 32 AND pos0 < "end") AS o, EXISTS (SELECT 1 FROM mx WHERE mx.chrom = w.chrom AND start < mate_pos0 + 32 AND mate_pos0 < "end") AS m FROM w WHERE w > 0)""", _FRAGMENTS + ", " + _merge_sql("exons", "mx"))
def fragment_totals(spark, sf):
    return X.fragment_totals(D.reads(spark, sf), D.transcripts(spark, sf))


#: Fragments by strand: of pairs 1++,1--,2+-,2-+; single ends have no rule and count on neither strand.
_STRANDED = _FRAGMENTS + ", " + _merge_sql("exons", "mx") + """,
ef AS (SELECT CAST(sum(w) AS DOUBLE) AS big FROM (SELECT w, flag, EXISTS (SELECT 1 FROM mx WHERE mx.chrom = w.chrom AND start < pos0 + 32 AND pos0 < "end") AS o, EXISTS (SELECT 1 FROM mx WHERE mx.chrom = w.chrom AND start < mate_pos0 + 32 AND mate_pos0 < "end") AS m FROM w WHERE w > 0)
  WHERE CASE WHEN flag & 1 = 0 OR (flag & 4 = 0 AND flag & 8 <> 0) THEN o WHEN flag & 4 <> 0 THEN m ELSE o AND m END),
sf AS (SELECT tx_id, sum(w) AS n FROM (SELECT DISTINCT tx.tx_id, w.rid, w.w FROM w JOIN tx ON tx.chrom = w.chrom AND pos0 < tx_end AND tx.tx_start < pos0 + sp JOIN exons e ON e.tx_id = tx.tx_id
  AND ((e.start <= pos0 AND pos0 < e."end") OR (e.start <= mate_pos0 AND mate_pos0 < e."end")) WHERE w.w > 0 AND flag & 1 <> 0 AND (flag & 16 <> 0) = (tx.strand = '-')) GROUP BY tx_id)"""


@query("SELECT tx_id, CAST(coalesce(n, 0) AS DOUBLE) AS fragments, round(CAST(coalesce(n, 0) AS DOUBLE) * 1e6 / big, 6) AS fpm, round(CAST(coalesce(n, 0) AS DOUBLE) * 1e9 / (big * length), 6) AS fpkm FROM tx LEFT JOIN sf USING (tx_id), ef", _STRANDED)
def fpkm_stranded(spark, sf):
    rows = X.fpkm(D.reads(spark, sf), D.transcripts(spark, sf), "1++,1--,2+-,2-+", only_exonic=True)
    return rows.select("tx_id", "fragments", F.round("fpm", 6).alias("fpm"), F.round("fpkm", 6).alias("fpkm"))


@query("SELECT tx_id, CAST(coalesce(n, 0) AS DOUBLE) AS fragments, round(CAST(coalesce(n, 0) AS DOUBLE) * 1e6 / big, 6) AS fpm, round(CAST(coalesce(n, 0) AS DOUBLE) * 1e9 / (big * length), 6) AS fpkm FROM tx LEFT JOIN tf USING (tx_id), (SELECT CAST(sum(w) AS DOUBLE) AS big FROM w)",
       _FRAGMENTS.replace("ELSE 1.0 END AS w", "WHEN flag & 12 <> 0 THEN 0.5 ELSE 1.0 END AS w").replace(_bits(512, 1024, 256), _bits(512, 1024, 256) + " AND mapq >= 30"))
def fpkm_single_ends(spark, sf):
    rows = X.fpkm(D.reads(spark, sf), D.transcripts(spark, sf), single=0.5, unique=True)
    return rows.select("tx_id", "fragments", F.round("fpm", 6).alias("fpm"), F.round("fpkm", 6).alias("fpkm"))


def _gene_tables(spark, sf):
    counts = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_id")).agg(F.count("*").alias("reads"))
    info = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 50 <> 0").selectExpr("concat('g', cast(p_partkey as string)) AS gene_id", "CASE WHEN p_partkey % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS gene_type", "cast(500 + p_size * 20 as bigint) AS exon_length")
    return counts, info


_GENES = """gc AS (SELECT 'g' || CAST(l_partkey AS VARCHAR) AS gene_id, count(*) AS reads FROM lineitem GROUP BY 1),
gi AS (SELECT 'g' || CAST(p_partkey AS VARCHAR) AS gene_id, p_partkey % 3 <> 0 AS coding, 500 + p_size * 20 AS len FROM part WHERE p_partkey % 50 <> 0),
gk AS (SELECT * FROM gc JOIN gi USING (gene_id)), gq AS (SELECT CAST(sum(reads) AS DOUBLE) AS s, quantile_cont(reads, 0.75) AS q FROM gk WHERE coding)"""


@query("SELECT gene_id, reads, round(reads * 1e9 / (s * len), 6) AS fpkm, round(reads * 1e9 / (q * len), 6) AS fpkm_uq FROM gk, gq", _GENES)
def fpkm_uq(spark, sf):
    return X.fpkm_uq(*_gene_tables(spark, sf)).select("gene_id", "reads", F.round("fpkm", 6).alias("fpkm"), F.round("fpkm_uq", 6).alias("fpkm_uq"))


@query("SELECT gene_id FROM gc WHERE gene_id NOT IN (SELECT gene_id FROM gi)", _GENES)
def fpkm_uq_unmatched(spark, sf):
    return X.unmatched_genes(*_gene_tables(spark, sf))


@query("""SELECT tx_id, CAST(percent AS INTEGER) AS percent, (CASE WHEN c IS NULL THEN 0 ELSE c END) AS count, round(coalesce(c, 0) * 1e9 / (length * n), 6) AS rpkm FROM tx CROSS JOIN (SELECT percent, (SELECT count(*) FROM rp WHERE pt < percent) AS n FROM ps)
LEFT JOIN (SELECT tx_id, percent AS pp, count(*) AS c FROM rh JOIN ps ON pt < percent GROUP BY 1, 2) h USING (tx_id) WHERE false""", f"{_STEPS}, rp AS (SELECT rid, i, r.chrom, pos0 + off + len // 2 AS p, {_DRAW} AS pt FROM (SELECT rid, i, r.chrom, pos0, off, len FROM {_JOIN} WHERE op = 'M' AND {_FULL}) r), rh AS (SELECT tx_id, pt FROM rp JOIN exons e ON e.chrom = rp.chrom AND start <= p AND p < \"end\")")
def rpkm_saturation(spark, sf):
    return X.rpkm_saturation(D.reads(spark, sf), D.transcripts(spark, sf)).withColumn("rpkm", F.round("rpkm", 6))


ORACLES["rpkm_saturation"] = ORACLES["rpkm_saturation"].rpartition("SELECT tx_id, CAST(percent")[0] + """SELECT tx_id, CAST(x.percent AS INTEGER) AS percent, coalesce(c, 0) AS count, round(coalesce(c, 0) * 1e9 / (length * n), 6) AS rpkm
FROM tx CROSS JOIN (SELECT percent, (SELECT count(*) FROM rp WHERE pt < percent) AS n FROM ps) x
LEFT JOIN (SELECT tx_id AS h, percent AS pp, count(*) AS c FROM rh JOIN ps ON pt < percent GROUP BY 1, 2) ON h = tx_id AND pp = x.percent"""

_DEPTH = f"""pl AS (SELECT r.rid, r.chrom, op, pos0 + off AS s, pos0 + off + len AS e, roff, qual_text FROM (SELECT r.*, op, i, CASE WHEN r.t = 2 THEN off - 4 ELSE off END AS off, len, roff FROM {_JOIN} WHERE op = 'M' AND {_bits(512, 256, 4, 1024)} AND (flag & 1 = 0 OR flag & 2 <> 0)) r),
dp AS (SELECT tx_id, pos, count(*) FILTER (ascii(substr(qual_text, CAST(roff + pos - 1 - s + 1 AS INTEGER), 1)) - 33 >= 13) AS v FROM ps JOIN pl ON pl.chrom = ps.chrom AND s <= pos - 1 AND pos - 1 < e GROUP BY tx_id, pos)"""
_TIN = f"""eb AS (SELECT tx_id, start + x.i + 1 AS pos, row_number() OVER (PARTITION BY tx_id ORDER BY start, x.i) - 1 AS n FROM (SELECT *, unnest(range("end" - start)) AS i FROM exons) x),
ps AS (SELECT tx_id, any_value(chrom) AS chrom, pos FROM (
  SELECT tx_id, chrom, start + 1 AS pos FROM exons UNION ALL SELECT tx_id, chrom, "end" FROM exons UNION ALL SELECT eb.tx_id, chrom, pos FROM eb JOIN tx USING (tx_id) WHERE n % greatest(1, length // 100) = 0) GROUP BY tx_id, pos), {_DEPTH},
st AS (SELECT tx_id FROM tx JOIN (SELECT DISTINCT chrom, pos0 FROM reads WHERE {_bits(512, 256, 4)}) r ON r.chrom = tx.chrom AND tx_start <= pos0 AND pos0 < tx_end GROUP BY tx_id HAVING count(*) > 10),
sc AS (SELECT tx_id, sum(v) AS s, sum(v * ln(v)) AS l FROM dp WHERE v > 0 AND tx_id IN (SELECT tx_id FROM st) GROUP BY tx_id)"""


@query("SELECT tx_id, round(coalesce(100 * exp(ln(s) - l / s) / k, 0), 6) AS tin FROM (SELECT tx_id, count(*) AS k FROM ps GROUP BY tx_id) LEFT JOIN sc USING (tx_id)", _TIN)
def tin(spark, sf):
    return V.tin(D.reads(spark, sf), D.transcripts(spark, sf)).select("tx_id", F.round("tin", 6).alias("tin"))



@query("SELECT round(avg(tin), 6) AS mean, round(quantile_cont(tin, 0.5), 6) AS median, round(stddev_pop(tin), 6) AS std FROM (SELECT 100 * exp(ln(s) - l / s) / k AS tin FROM (SELECT tx_id, count(*) AS k FROM ps GROUP BY tx_id) JOIN sc USING (tx_id)) WHERE tin > 0", _TIN)
def tin_summary(spark, sf):
    return V.tin_summary(V.tin(D.reads(spark, sf), D.transcripts(spark, sf))).select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@query("SELECT tx_id, round(coalesce(100 * exp(ln(s) - l / s) / k, 0), 6) AS tin FROM (SELECT tx_id, count(*) AS k FROM ps GROUP BY tx_id) LEFT JOIN sn USING (tx_id)",
       _TIN + f""", nz AS (SELECT tx_id, CAST(sum(32) AS DOUBLE) / any_value(tx_end - tx_start - length) AS noise FROM (
  SELECT chrom, pos0 FROM reads r WHERE {_bits(512, 256, 4)} AND NOT EXISTS (SELECT 1 FROM exons e WHERE e.chrom = r.chrom AND e.start < pos0 + 32 AND pos0 < e."end")) r
  JOIN tx ON tx.chrom = r.chrom AND tx_start <= pos0 AND pos0 < tx_end WHERE tx_end - tx_start > length GROUP BY tx_id),
sn AS (SELECT tx_id, sum(v) AS s, sum(v * ln(v)) AS l FROM (SELECT tx_id, floor(v - coalesce(noise, 0)) AS v FROM dp LEFT JOIN nz USING (tx_id) WHERE tx_id IN (SELECT tx_id FROM st)) WHERE v > 0 GROUP BY tx_id)""")
def tin_subtracted(spark, sf):
    return V.tin(D.reads(spark, sf), D.transcripts(spark, sf), subtract=True).select("tx_id", F.round("tin", 6).alias("tin"))


_BODY = f"""eb AS (SELECT tx_id, start + x.i + 1 AS pos, row_number() OVER (PARTITION BY tx_id ORDER BY start, x.i) - 1 AS n FROM (SELECT *, unnest(range("end" - start)) AS i FROM exons) x),
kk AS (SELECT *, k // 100 AS kl, (k + 99) // 100 AS kh FROM (SELECT tx_id, chrom, strand, i, (CAST(length AS BIGINT) - 1) * i AS k FROM tx, range(1, 101) x(i) WHERE length >= 100)),
p1 AS (SELECT kk.*, eb.pos AS lo FROM kk JOIN eb ON eb.tx_id = kk.tx_id AND eb.n = kl),
pp AS (SELECT p1.tx_id, chrom, strand, i, CAST(CASE WHEN k % 100 = 0 THEN lo ELSE round_even(lo * (ceil(k / 100.0::DOUBLE) - k / 100.0::DOUBLE) + eb.pos * (k / 100.0::DOUBLE - floor(k / 100.0::DOUBLE)), 0) END AS BIGINT) AS pos
  FROM p1 JOIN eb ON eb.tx_id = p1.tx_id AND eb.n = kh),
ps AS (SELECT DISTINCT tx_id, chrom, strand, pos FROM pp), {_DEPTH}"""


@query("""SELECT CAST(slot AS INTEGER) AS slot, CAST(sum(coalesce(v, 0)) AS BIGINT) AS covered FROM (
  SELECT tx_id, pos, CASE WHEN strand = '-' THEN row_number() OVER (PARTITION BY tx_id ORDER BY pos DESC) ELSE row_number() OVER (PARTITION BY tx_id ORDER BY pos) END - 1 AS slot FROM ps) LEFT JOIN dp USING (tx_id, pos) GROUP BY slot""", _BODY)
def genebody_coverage(spark, sf):
    return V.genebody_coverage(D.reads(spark, sf), D.transcripts(spark, sf))


#: Places of a list that is turned round first where the strand is reverse: base number n there is number length - 1 - n here.
_TRACK_BODY = """ex AS (SELECT tx_id, start - before AS off, before, before + len AS after FROM (
  SELECT tx_id, start, "end" - start AS len, coalesce(sum("end" - start) OVER (PARTITION BY tx_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM exons)),
bp AS (SELECT tx_id, chrom, i, (CAST(length AS BIGINT) - 1) * i AS k, CAST(length AS BIGINT) - 1 AS last, strand = '-' AS back FROM tx, range(1, 101) x(i) WHERE length >= 100),
bn AS (SELECT *, CASE WHEN back THEN last - k // 100 ELSE k // 100 END AS lo, CASE WHEN back THEN last - (k + 99) // 100 ELSE (k + 99) // 100 END AS hi FROM bp),
tp AS (SELECT bn.chrom, i, CAST(CASE WHEN k % 100 = 0 THEN a.off + lo + 1 ELSE round_even((a.off + lo + 1) * (ceil(k / 100.0::DOUBLE) - k / 100.0::DOUBLE) + (b.off + hi + 1) * (k / 100.0::DOUBLE - floor(k / 100.0::DOUBLE)), 0) END AS BIGINT) AS pos
  FROM bn JOIN ex a ON a.tx_id = bn.tx_id AND a.before <= lo AND lo < a.after JOIN ex b ON b.tx_id = bn.tx_id AND b.before <= hi AND hi < b.after),
tv AS (SELECT i, sum(value) AS v FROM (SELECT chrom, i, pos, pos // 16 AS c FROM tp) p
  JOIN (SELECT chrom, start, "end", value, unnest(range((start + 1) // 16, "end" // 16 + 1)) AS c FROM ta) t ON t.chrom = p.chrom AND t.c = p.c AND start <= pos - 1 AND pos - 1 < "end" GROUP BY i)"""


@query("SELECT CAST(i - 1 AS INTEGER) AS slot, coalesce(v, 0.0::DOUBLE) AS value FROM (SELECT DISTINCT i FROM tp) LEFT JOIN tv USING (i)", _TRACK_BODY)
def genebody_from_track(spark, sf):
    return V.genebody_from_track(D.track(spark, sf, "a"), D.transcripts(spark, sf))


@query("SELECT CAST(sum(value * (\"end\" - start)) AS DOUBLE) AS total FROM ta")
def track_sum(spark, sf):
    return T.track_sum(D.track(spark, sf, "a"))


@query("""SELECT CAST(coalesce(sum(value * (least(ta."end", mx."end") - greatest(ta.start, mx.start))), 0) AS DOUBLE) AS total FROM ta JOIN mx ON ta.chrom = mx.chrom AND ta.start < mx."end" AND mx.start < ta."end" """, _merge_sql("exons", "mx"))
def track_sum_exons(spark, sf):
    return T.track_sum(D.track(spark, sf, "a"), exons(D.transcripts(spark, sf)))


@query("""SELECT chrom, min(start) AS start, max("end") AS "end", round(any_value(value), 6) AS value FROM (
  SELECT *, sum(CASE WHEN pe = start AND pv = value THEN 0 ELSE 1 END) OVER (PARTITION BY chrom, c ORDER BY start) AS g FROM (
    SELECT *, lag("end") OVER w AS pe, lag(value) OVER w AS pv FROM cut WINDOW w AS (PARTITION BY chrom, c ORDER BY start))) GROUP BY chrom, c, g""",
       """cut AS (SELECT chrom, c, greatest(start, c * 1000) AS start, least("end", c * 1000 + 1000) AS "end", value * 1e6 / tot AS value FROM (
  SELECT *, unnest(range(start // 1000, ("end" - 1) // 1000 + 1)) AS c FROM ta WHERE value <> 0), (SELECT sum(value * ("end" - start)) AS tot FROM ta))""")
def normalize_track(spark, sf):
    return T.normalize_track(D.track(spark, sf, "a"), 1e6, 1000).withColumn("value", F.round("value", 6))


_OVERLAY = """pa AS (SELECT chrom, start + unnest(range("end" - start)) AS p, value FROM ta), pb AS (SELECT chrom, start + unnest(range("end" - start)) AS p, value FROM tb),
xy AS (SELECT coalesce(pa.chrom, pb.chrom) AS chrom, coalesce(pa.value, 0) AS x, coalesce(pb.value, 0) AS y FROM pa FULL JOIN pb ON pa.chrom = pb.chrom AND pa.p = pb.p)"""
_OPS = {"Add": "x + y", "Subtract": "x - y", "Product": "x * y", "Average": "(x + y) / 2", "geometricMean": "sqrt(x * y)", "Max": "greatest(x, y)", "Min": "least(x, y)"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS operation, chrom, round({e}, 6) AS value, count(*) AS bases FROM xy WHERE {e} <> 0 GROUP BY ALL" for n, e in _OPS.items()), _OVERLAY)
def overlay_tracks(spark, sf):
    a, b = D.track(spark, sf, "a"), D.track(spark, sf, "b")
    out = None
    for n in T.OPERATIONS:
        part = T.overlay_tracks(a, b, n).groupBy(F.lit(n).alias("operation"), "chrom", F.round("value", 6).alias("value")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
        out = part if out is None else out.unionByName(part)
    return out


_OK = "xf % 2 = 1"


@query(f"""SELECT count(*) AS alignments, count(*) FILTER ({_OK}) AS confident, count(DISTINCT qname) AS names, count(DISTINCT qname) FILTER ({_OK}) AS confident_names, count(*) FILTER ({_OK} AND flag & 1024 <> 0) AS duplicates,
count(*) FILTER ({_OK} AND flag & 1024 = 0) AS not_duplicates, count(*) FILTER ({_OK} AND flag & 16 <> 0) AS reverse, count(*) FILTER ({_OK} AND flag & 16 = 0) AS forward, count(*) FILTER ({_OK} AND re = 'E') AS exon, count(*) FILTER ({_OK} AND re = 'I') AS intron,
count(*) FILTER ({_OK} AND tx IS NOT NULL) AS sense, count(*) FILTER ({_OK} AND tx IS NULL AND an IS NOT NULL) AS antisense, count(*) FILTER ({_OK} AND tx IS NULL AND an IS NULL) AS other_direction,
count(*) FILTER ({_OK} AND chrom = 'chr3') AS mito, count(*) FILTER ({_OK} AND cb IS NOT NULL) AS with_cb, count(*) FILTER ({_OK} AND ub IS NOT NULL) AS with_ub FROM reads""")
def single_cell_stat(spark, sf):
    return S.single_cell_stat(D.reads(spark, sf, "xf", "RE", "TX", "AN", "CB", "UB"), "chr3")


#: Reads contig by contig, but for some of chr1 that stand among those of chr3: the first of these ends the counts.
_PLACED = "(CASE WHEN chrom = 'chr1' AND mapq = 17 AND tlen % 10 = 3 THEN 3 ELSE CAST(substr(chrom, 4) AS BIGINT) END) * 2000000000000000000 + rid"


@query(f"""SELECT count(*) AS alignments, count(*) FILTER ({_OK}) AS confident, count(*) FILTER ({_OK} AND re = 'E') AS exon, count(*) FILTER ({_OK} AND cb IS NOT NULL) AS with_cb FROM scanned WHERE NOT broken""",
       f"""numbered AS (SELECT *, CAST(substr(chrom, 4) AS BIGINT) AS c, {_PLACED} AS place FROM reads),
topped AS (SELECT *, max(c) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM numbered),
scanned AS (SELECT *, bool_or(c < coalesce(top, 0)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM topped)""")
def single_cell_in_order(spark, sf):
    reads = D.reads(spark, sf, "xf", "RE", "TX", "AN", "CB", "UB").withColumn("rid", F.expr(_PLACED))
    contigs = spark.createDataFrame([(i, f"chr{i}") for i in range(5)], "ref_id int, chrom string")
    return S.single_cell_stat(reads, "chr3", contigs, names=False).select("alignments", "confident", "exon", "with_cb")


@query(f"SELECT CASE WHEN t = 0 THEN 'Map consecutively (M)' WHEN t = 1 THEN 'Map with splicing (MNM)' WHEN t IN (2, 6) THEN 'Map with clipping (SM or MS)' ELSE 'Others' END AS shape, count(*) AS reads FROM reads WHERE {_OK} GROUP BY 1")
def single_cell_shapes(spark, sf):
    return S.single_cell_shapes(D.reads(spark, sf, "xf"))


@query("SELECT count(*) + 1 AS total, count(*) FILTER (cb IS NULL) AS missing, count(*) FILTER (cr = replace(cb, '-1', '')) AS same, count(*) FILTER (cr <> replace(cb, '-1', '')) AS edited FROM reads")
def barcode_edit_summary(spark, sf):
    return S.edit_summary(D.reads(spark, sf, "CR", "CB"), "CR", "CB")


@query("SELECT ub AS code, count(*) AS reads, min(rid) AS first_rid FROM reads WHERE ub IS NOT NULL GROUP BY 1")
def umi_frequency(spark, sf):
    return S.code_frequency(D.reads(spark, sf, "UR", "UB"), "UR", "UB")


@query("SELECT CAST(3 AS INTEGER) AS pos, substr(cr, 4, 1) || ':' || substr(cb, 4, 1) AS edit, count(*) AS reads FROM reads WHERE cr <> replace(cb, '-1', '') GROUP BY 2")
def barcode_edit_matrix(spark, sf):
    return S.edit_matrix(D.reads(spark, sf, "CR", "CB"), "CR", "CB")


def _barcodes(spark, sf):
    return D.reads(spark, sf).select(F.col("rid").alias("rec_no"), F.substring("seq", 1, 16).alias("seq"), F.array_join(F.transform(F.slice("qual", 1, 16), lambda q: F.char(q + 33)), "").alias("qual"))


@query("SELECT CAST(i AS INTEGER) AS pos, CAST(s AS INTEGER) AS score, n AS reads, round(n / sum(n) OVER (PARTITION BY i), 6) AS fraction FROM (SELECT i, ascii(substr(qual_text, CAST(i + 1 AS INTEGER), 1)) - 33 AS s, count(*) AS n FROM reads, range(16) x(i) GROUP BY 1, 2)")
def barcode_qualities(spark, sf):
    return S.barcode_qualities(_barcodes(spark, sf)).withColumn("fraction", F.round("fraction", 6))


@query("SELECT CAST(i AS INTEGER) AS pos, c AS base, n AS reads, CAST(dense_rank() OVER (ORDER BY f) AS INTEGER) AS rank FROM (SELECT i, c, n, min(CASE WHEN i = 0 THEN r END) OVER (PARTITION BY c) AS f FROM (SELECT i, substr(seq, CAST(i + 1 AS INTEGER), 1) AS c, count(*) AS n, min(rid) AS r FROM reads, range(16) x(i) GROUP BY 1, 2))")
def sequence_logo(spark, sf):
    return S.logo_counts(_barcodes(spark, sf))


@query('SELECT chrom, start, "end" FROM m', _merge_sql("a", "m"))
def interval_merge(spark, sf):
    return I.merge(D.ranges(spark, sf, "a"))


@query('SELECT m.chrom, greatest(m.start, n.start) AS start, least(m."end", n."end") AS "end" FROM m JOIN n ON m.chrom = n.chrom AND m.start < n."end" AND n.start < m."end"', _merge_sql("a", "m") + ", " + _merge_sql("b", "n"))
def interval_intersect(spark, sf):
    return I.intersect(D.ranges(spark, sf, "a"), D.ranges(spark, sf, "b"))


@query('SELECT chrom, start, "end" FROM d', _subtract_sql("a", "b", "d"))
def interval_subtract(spark, sf):
    return I.subtract(D.ranges(spark, sf, "a"), D.ranges(spark, sf, "b"))


@query('SELECT id, CAST(coalesce((SELECT sum(least(a."end", n."end") - greatest(a.start, n.start)) FROM n WHERE n.chrom = a.chrom AND n.start < a."end" AND a.start < n."end"), 0) AS BIGINT) AS bases FROM a', _merge_sql("b", "n"))
def interval_overlap_length(spark, sf):
    return I.overlap_length(D.ranges(spark, sf, "a"), D.ranges(spark, sf, "b"), "id")


@query('SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"')
def interval_join(spark, sf):
    a, b = D.ranges(spark, sf, "a"), I.as_right(D.ranges(spark, sf, "b").withColumnRenamed("id", "b_id"), "b_id")
    return N.overlap_pairs(a.withColumnRenamed("id", "a_id"), b, "a_id", "b_id")


@query('SELECT chrom, start, "end", depth FROM runs', _coverage_sql("a"))
def coverage_runs(spark, sf):
    return I.coverage(D.ranges(spark, sf, "a"))


def _block_query(op: str, sql_op: str):
    return f"SELECT rid, CAST(i AS INTEGER) AS i, pos0 + off AS start, pos0 + off + len AS \"end\" FROM {_JOIN} WHERE op = '{sql_op}'"


@query(_block_query("M", "M"))
def cigar_exon_blocks(spark, sf):
    return D.reads(spark, sf).select("rid", F.posexplode(C.exon_blocks()).alias("i", "b")).select("rid", "i", "b.start", "b.end")


@query(_block_query("N", "N"))
def cigar_intron_blocks(spark, sf):
    return D.reads(spark, sf).select("rid", F.posexplode(C.intron_blocks()).alias("i", "b")).select("rid", "i", "b.start", "b.end")


@query("SELECT rid, CAST(span AS BIGINT) AS span, CAST(qlen AS BIGINT) AS aligned FROM reads r JOIN spans s ON r.t = s.t")
def cigar_spans(spark, sf):
    return D.reads(spark, sf).select("rid", C.reference_span().alias("span"), C.aligned_length().alias("aligned"))


@query('SELECT tx_id, CAST(sum(greatest(0, least(e."end", runs."end") - greatest(e.start, runs.start)) * depth) AS BIGINT) AS bases FROM exons e JOIN runs ON runs.chrom = e.chrom AND runs.start < e."end" AND e.start < runs."end" GROUP BY tx_id', _SIGNAL)
def exon_coverage(spark, sf):
    return V.exon_coverage(D.reads(spark, sf), D.transcripts(spark, sf))


@query(f"""SELECT tx_id AS gene_id, count(*) AS reads FROM (SELECT rid, min(tx_id) AS tx_id FROM (
  SELECT rid, tx_id FROM gb GROUP BY rid, tx_id HAVING count(DISTINCT i) = (SELECT count(DISTINCT i) FROM gb g2 WHERE g2.rid = gb.rid)) GROUP BY rid HAVING count(*) = 1) GROUP BY 1""",
       f"""gb AS (SELECT DISTINCT rid, i, e.tx_id FROM (SELECT r.rid, r.chrom, i, pos0 + off AS s, pos0 + off + len AS e FROM {_JOIN} WHERE op = 'M' AND {_bits(512, 256, 4)} AND mapq >= 10) m JOIN exons e ON e.chrom = m.chrom AND e.start <= m.s AND m.e <= e."end")""")
def gene_counts(spark, sf):
    return P.gene_counts(D.reads(spark, sf), exons(D.transcripts(spark, sf), "tx_id").withColumnRenamed("tx_id", "gene_id"))
