"""Kernels, intervals, readers and reports on small hand-made inputs."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise import contract
from strandwise.functions import cigar as C
from strandwise.functions.sequence import md_mismatches, name_bit, reverse_complement, strand_rule
from strandwise.operators import coverage as V
from strandwise.operators import intervals as I
from strandwise.operators import regions as G
from strandwise.operators import reports as P
from strandwise.operators import sequences as S
from strandwise.operators import tracks as T
from strandwise.operators.genes import cds_exons, model_parts, utr_exons
from strandwise.plans.multi import run_reports
from strandwise.sources import alignments, bed, fastx, tables

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500
""" + "".join(
    f"{n}\t{flag}\t{chrom}\t{pos}\t{mapq}\t20M\t{mate}\t{mpos}\t{tlen}\t{'A' * 20}\t{'I' * 20}{tags}\n"
    for n, flag, chrom, pos, mapq, mate, mpos, tlen, tags in [
        ("u1", 0, "chr1", 11, 40, "*", 0, 0, "\tNM:i:1\tCB:Z:AC-1\txx:A:q"), ("u2", 0, "chr1", 51, 40, "*", 0, 0, ""), ("u3", 0, "chr1", 91, 40, "*", 0, 0, ""), ("low", 0, "chr1", 131, 5, "*", 0, 0, ""),
        ("dup", 1024, "chr1", 171, 40, "*", 0, 0, ""), ("qc", 512, "chr1", 211, 40, "*", 0, 0, ""), ("sec", 256, "chr1", 251, 40, "*", 0, 0, ""), ("un", 4, "*", 0, 0, "*", 0, 0, ""),
        ("p1", 67, "chr2", 21, 40, "=", 61, 60, ""), ("p1", 147, "chr2", 61, 40, "=", 21, -60, ""),
    ]
)


@pytest.fixture(scope="module")
def reads(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sam") / "a.sam"
    path.write_text(SAM)
    return alignments.read_alignments(spark, str(path)), str(path)


def test_sam_and_bam_stat(spark, reads):
    table, path = reads
    row = P.bam_stat(table).first().asDict()
    want = dict(total=10, qc_fail=1, duplicate=1, non_primary=1, unmapped=1, multi=1, unique=5, read1=1, read2=1, forward=4, reverse=1, non_splice=5, splice=0, proper_pair=2, proper_other_contig=0)
    assert row == want
    rows = table.orderBy("rid").collect()
    assert [r["rid"] for r in rows] == list(range(10)) and rows[7]["chrom"] is None and rows[8]["mate_chrom"] == "chr2" and rows[9]["mate_pos0"] == 20
    assert rows[0]["tags"]["NM"]["i"] == 1 and rows[0]["tags"]["CB"]["s"] == "AC-1" and rows[0]["tags"]["xx"]["s"] == "q" and rows[0]["qual"] == [40] * 20
    assert [(r["ref_id"], r["chrom"], r["length"]) for r in alignments.sam_contigs(spark, path).orderBy("ref_id").collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]


def bgzf(data):
    out = b""
    for i in range(0, len(data) or 1, 60):  # small blocks, so that records cross them
        part = data[i : i + 60]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_is_read_like_sam(spark, reads, tmp_path):
    table, _ = reads
    names = ["chr1", "chr2"]
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n.encode() + b"\0" + struct.pack("<i", 1000) for n in names)
    ref = lambda c: names.index(c) if c else -1
    rows = table.orderBy("rid").collect()
    for r in rows:
        seq = r["seq"]
        packed = bytes("=ACMGRSVTWYHKDBN".index(seq[i]) << 4 | "=ACMGRSVTWYHKDBN".index(seq[i + 1]) for i in range(0, len(seq), 2))
        tags = b"".join(k.encode() + (b"C" + bytes([v["i"]]) if v["t"] == "i" else b"Z" + v["s"].encode() + b"\0" if v["t"] == "Z" else b"A" + v["s"].encode()) for k, v in r["tags"].items())
        name = r["qname"].encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref(r["chrom"]), -1 if r["pos0"] is None else r["pos0"], len(name), r["mapq"], 0, len(r["cigar"]), r["flag"], len(seq), ref(r["mate_chrom"]), -1 if r["mate_pos0"] is None else r["mate_pos0"], r["tlen"])
        body += name + b"".join(struct.pack("<I", c["len"] << 4 | "MIDNSHP=X".index(c["op"])) for c in r["cigar"]) + packed + bytes(r["qual"]) + tags
        data += struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(bgzf(data))
    got = alignments.read_alignments(spark, str(tmp_path / "a.bam")).orderBy("rid").collect()
    assert [r.asDict(True) for r in got] == [r.asDict(True) for r in rows]
    with pytest.raises(ValueError):
        alignments.read_alignments(spark, "a.txt")


@pytest.mark.parametrize(
    "text, exons, introns, deletions, span",
    [
        ("10M5D10M", [(100, 110), (115, 125)], [], [(10, 15)], 25),
        ("5S10M20N5M3S", [(105, 115), (135, 140)], [(110, 130)], [], 35),
        ("4M2I4M", [(100, 104), (104, 108)], [], [], 8),
        ("3H4=1X2M", [(100, 102)], [], [], 7),
        ("2S3M1D2M", [(102, 105), (106, 108)], [], [(5, 6)], 6),
    ],
)
def test_cigar_kernels(spark, text, exons, introns, deletions, span):
    row = spark.range(1).select(C.parse_cigar(F.lit(text)).alias("cigar"), F.lit(100).cast("long").alias("pos0")).select(
        C.exon_blocks().alias("e"), C.intron_blocks().alias("i"), C.deletion_starts().alias("d"), C.reference_span().alias("s")
    ).first()
    pairs = lambda x: [(b["start"], b["end"]) for b in x]
    assert (pairs(row["e"]), pairs(row["i"]), pairs(row["d"]), row["s"]) == (exons, introns, deletions, span)


def test_sequence_functions(spark):
    row = spark.range(1).select(reverse_complement(F.lit("ACGTNX")).alias("r"), F.lit("AAAAACAAAA").alias("seq"), F.lit("5A4").alias("md")).select("r", md_mismatches("md", "seq").alias("m")).first()
    assert row["r"] == "XNACGT" and [tuple(m) for m in row["m"]] == [(5, "A", "C")]
    assert strand_rule("1++,1--,2+-,2-+") == {"1+": "+", "1-": "-", "2+": "-", "2-": "+"} and strand_rule("++,--") == {"+": "+", "-": "-"}
    with pytest.raises(ValueError):
        strand_rule("odd")


def bases(rows):
    out = {}
    for c, s, e in rows:
        for p in range(s, e):
            out[c, p] = out.get((c, p), 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_interval_algebra(spark, seed):
    rng = np.random.RandomState(seed)
    draw = lambda n: [(f"c{rng.randint(2)}", int(s), int(s) + int(rng.randint(0, 40))) for s in rng.randint(0, 600, size=n)] + [("only", 5, 9)] * (n % 2)
    a, b = draw(41), draw(30)
    make = lambda rows: spark.createDataFrame(rows, "chrom string, start long, end long")
    old, I.BIN = I.BIN, 64
    try:
        x, y = bases(a), bases(b)
        got = lambda d: [tuple(r) for r in d.select("chrom", "start", "end").collect()]
        merged = got(I.merge(make(a)))
        assert set(bases(merged)) == set(x) and max(bases(merged).values()) == 1
        assert all((c, s - 1) not in x and (c, e) not in x for c, s, e in merged)
        assert set(bases(got(I.intersect(make(a), make(b))))) == set(x) & set(y)
        assert set(bases(got(I.subtract(make(a), make(b))))) == set(x) - set(y)
        depth = {}
        for r in I.coverage(make(a)).collect():
            for p in range(r["start"], r["end"]):
                depth[r["chrom"], p] = r["depth"]
        assert depth == x
        pairs = I.overlap_join(make(a).withColumn("i", F.monotonically_increasing_id()), I.as_right(make(b)), size=64)
        assert pairs.count() == sum(p[0] == q[0] and p[1] < q[2] and q[1] < p[2] and True for p in a for q in b)
    finally:
        I.BIN = old


def test_strict_points(spark):
    regions = spark.createDataFrame([("c", 100, 200), ("d", 100, 101)], "chrom string, r_start long, r_end long")
    points = spark.createDataFrame([("c", p) for p in (99, 100, 101, 199, 200)] + [("d", 100)], "chrom string, p long")
    hits = lambda strict: sorted(tuple(r) for r in I.point_join(points, "p", regions, strict).select("chrom", "p").collect())
    assert hits(True) == [("c", 101), ("c", 199)] and hits(False) == [("c", 100), ("c", 101), ("c", 199), ("d", 100)]


def test_bed12(spark, tmp_path):
    (tmp_path / "m.bed").write_text("track x\n# y\nchr1 100 500 geneA 0 + 150 450 0 2 100,100, 0,300,\nchr1\t1\t2\nchr1 a 500 g 0 + 1 2 0 1 5, 0,\n")
    lines = bed.read_bed12(spark, str(tmp_path / "m.bed"))
    assert lines.where("is_header").count() == 2 and lines.where("parse_error is not null").count() == 2
    row = bed.models(lines).first()
    assert [(b["start"], b["end"]) for b in row["blocks"]] == [(100, 200), (400, 500)] and row["strand"] == "+" and row["cds_start"] == 150
    with pytest.raises(Exception, match="bad line"):
        bed.models(lines, "exon").collect()
    tx = bed.models(lines)
    parts = {r["region"]: (r["start"], r["end"]) for r in G.gene_regions(tx).where("region in (2, 3, 4)").collect()}
    assert parts == {2: (100, 150), 3: (450, 500), 4: (200, 400)}


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nacgt\nAC\n>two\nNNAC\n")
    got = {r["name"]: r["seq"] for r in fastx.read_permissive(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"ONE": "ACGTAC", "TWO": "NNAC"}
    assert fastx.read_fasta_lines(spark, str(tmp_path / "a.fa")).count() == 3
    (tmp_path / "b.fq").write_text("@r\nACG\n+\n#II\n\n@s\nTTT\n+\nIII\n")
    rows = fastx.read_fastq(spark, str(tmp_path / "b.fq"))
    assert [(r["seq"], r["qual"]) for r in rows.orderBy("rec_no").collect()] == [("ACG", "#II"), ("TTT", "III")]
    scores = {(r["pos"], r["score"]): r["fraction"] for r in S.barcode_qualities(rows).collect()}
    assert scores[0, 2] == 0.5 and scores[1, 40] == 1.0


def test_tables(spark, tmp_path):
    (tmp_path / "s").write_text("chr2 24000\nchr1 30000\n")
    assert [r["chrom"] for r in tables.read_chrom_sizes(spark, str(tmp_path / "s")).orderBy("line").collect()] == ["chr2", "chr1"]
    (tmp_path / "t").write_text("chr2 24000\nchr2 5\n")
    with pytest.raises(ValueError):
        tables.read_chrom_sizes(spark, str(tmp_path / "t"))
    (tmp_path / "c").write_text("g1\t5\n__no_feature\t9\n")
    assert tables.read_gene_counts(spark, str(tmp_path / "c")).count() == 1


TRACK1 = [("chr1", 100, 150, 5.0), ("chr1", 150, 160, 2.5), ("chr1", 300, 310, -3.0), ("chr1", 500, 505, 0.0), ("chr1", 900, 1000, 1.5)]
TRACK2 = [("chr1", 100, 150, 1.0), ("chr1", 150, 160, 4.0), ("chr1", 300, 310, 2.0), ("chr1", 700, 710, 10.0)]


def test_tracks(spark, tmp_path):
    a, b = (spark.createDataFrame(t, "chrom string, start long, end long, value float") for t in (TRACK1, TRACK2))
    assert T.track_sum(a).first()["total"] == 395
    add = {(r["start"], r["end"]): r["value"] for r in T.overlay_tracks(a, b, "Add").collect()}
    assert add[100, 150] == 6 and add[150, 160] == 6.5 and add[300, 310] == -1 and add[700, 710] == 10 and (500, 505) not in add
    assert T.overlay_tracks(a, a, "Subtract").count() == 0
    with pytest.raises(ValueError):
        T.overlay_tracks(a, b, "Division")
    tables.write_bedgraph(a, str(tmp_path / "w"))
    assert tables.read_bedgraph(spark, str(tmp_path / "w")).count() == 5


def test_even_coverage_scores_100(spark):
    reads = spark.createDataFrame([(i, f"q{i}", 0, "c", p, 60, [("M", 10)], None, None, 0, "A" * 10, [30] * 10) for i, p in enumerate(range(90, 420, 10))], "rid long, qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>, mate_chrom string, mate_pos0 long, tlen int, seq string, qual array<int>")
    tx = spark.createDataFrame([("t", "c", 100, 400, "+", 100, 400, [(100, 400)], 0), ("far", "c", 9000, 9300, "-", 9000, 9300, [(9000, 9300)], 1)], "tx_id string, chrom string, tx_start long, tx_end long, strand string, cds_start long, cds_end long, blocks array<struct<start:bigint,end:bigint>>, line long")
    got = {r["tx_id"]: r["tin"] for r in V.tin(reads, tx).collect()}
    assert got["t"] == pytest.approx(100) and got["far"] == 0
    curve = {r["slot"]: r["covered"] for r in V.genebody_coverage(reads, tx).collect()}
    assert len(curve) == 100 and set(curve.values()) == {1}


def test_reports_share_a_scan(spark, reads):
    table, _ = reads
    got = run_reports(table, ["bam_stat", "read_gc"])
    assert got["bam_stat"].first()["total"] == 10 and got["read_gc"].count() == 1
    with pytest.raises(ValueError):
        run_reports(table, ["infer_experiment"])
    with pytest.raises(ValueError):
        run_reports(table, ["nothing"])


def test_streaming_counters(spark, tmp_path):
    from strandwise.streaming.counters import running_bam_stat, stream_sam

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text(SAM)
    (tmp_path / "in" / "b.sam").write_text(SAM)
    q = running_bam_stat(stream_sam(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName("stat").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.sql("select total, `unique` from stat").first().asDict() == {"total": 20, "unique": 10}
    finally:
        q.stop()


def test_name_bit(spark):
    def bit(name):
        h = 0
        for c in name.encode():
            h = (h * 31 + c) & 0xFFFFFFFF
        k = (h + (~(h << 15) & 0xFFFFFFFF)) & 0xFFFFFFFF
        k ^= k >> 10
        k = (k + (k << 3)) & 0xFFFFFFFF
        k ^= k >> 6
        k = (k + (~(k << 11) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return (k ^ k >> 16) & 1

    names = ["a", "read/1", "q123", "HWI-ST:1:2:3", "zz"] + [f"r{i}" for i in range(40)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "qname string").coalesce(1).select(name_bit("qname")).collect()]
    assert got == [bit(n) for n in names]


def test_overlapping_mates_count_once(spark):
    read = lambda i, name, flag, pos, mate, tlen, seq, qual: (i, name, flag, "c", pos, 60, [("M", 10)], "c", mate, tlen, seq, [qual] * 10)
    rows = [
        read(0, "same", 3 | 64, 100, 105, 15, "A" * 10, 10), read(1, "same", 3 | 128, 105, 100, -15, "A" * 10, 10),
        read(2, "differ", 3 | 64, 200, 205, 15, "A" * 10, 15), read(3, "differ", 3 | 128, 205, 200, -15, "C" * 10, 14),
        read(4, "lone", 0, 300, None, 0, "A" * 10, 20),
    ]
    reads = spark.createDataFrame(rows, "rid long, qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>, mate_chrom string, mate_pos0 long, tlen int, seq string, qual array<int>")
    positions = spark.createDataFrame([("t", "c", [103, 108, 203, 208, 303])], "tx_id string, chrom string, positions array<bigint>")
    got = {r["pos"]: r["covered"] for r in V.position_depth(reads, positions).collect()}
    # 10 alone is too low, 10 + 10 is enough; 15 counts alone, 0.8 of it does not
    assert got == {103: 0, 108: 1, 203: 1, 208: 0, 303: 1}


@pytest.mark.parametrize("name", ["infer_experiment_keys", "inner_distance", "inner_distance_histogram", "deletion_profile", "mismatch_profile"])
def test_registered_reports_have_no_cap(spark, name):
    plan = contract.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_reports_count_all_reads_unless_capped(spark):
    n = 200_001
    array = "cast(array(named_struct('op', 'M', 'len', 10), named_struct('op', 'D', 'len', 1), named_struct('op', 'M', 'len', 10)) as array<struct<op:string,len:int>>)"
    reads = spark.range(n).selectExpr("id as rid", "concat('q', id) as qname", "0 as flag", "'c' as chrom", "100L as pos0", "60 as mapq", f"{array} as cigar", "cast(null as string) as mate_chrom", "cast(null as long) as mate_pos0", "0 as tlen", "repeat('A', 20) as seq")
    tx = spark.createDataFrame([("t", "c", 0, 400, "+")], "tx_id string, chrom string, tx_start long, tx_end long, strand string")
    assert [tuple(r) for r in P.strand_inference(reads, tx).collect()] == [(False, "++", n)]
    assert [tuple(r) for r in P.strand_inference(reads, tx, sample=5).collect()] == [(False, "++", 5)]
    few = reads.where("rid < 9")
    assert P.deletion_profile(few, 20).agg(F.sum("deletions")).first()[0] == 9
    assert P.deletion_profile(few, 20, most=4).agg(F.sum("deletions")).first()[0] == 4
    odd = few.withColumn("cigar", F.expr("cast(array(named_struct('op', 'M', 'len', 20)) as array<struct<op:string,len:int>>)"))
    odd = odd.withColumn("tags", F.expr("map('MD', named_struct('s', '5C14', 'i', cast(null as long)), 'NM', named_struct('s', cast(null as string), 'i', 1L))"))
    assert P.mismatch_profile(odd, 20).agg(F.sum("sum")).first()[0] == 9
    assert P.mismatch_profile(odd, 20, most=4).agg(F.sum("sum")).first()[0] == 4
    pairs = odd.withColumns({"flag": F.lit(3 | 64), "mate_chrom": F.lit("c"), "mate_pos0": F.lit(150).cast("long")})
    model = tx.withColumns({"blocks": F.expr("array(named_struct('start', 0L, 'end', 400L))"), "line": F.lit(0).cast("long")})
    assert G.inner_distance(pairs, model).count() == 9 and G.inner_distance(pairs, model, sample=4).count() == 4


@pytest.mark.parametrize("depth", [1, 7, 12, 40, 8000])
def test_deep_positions_pool_mates_before_the_cut(spark, monkeypatch, depth):
    monkeypatch.setattr(V, "DEPTH", depth)
    rng = np.random.RandomState(depth)
    rows = []  # qname, flag, pos0, mate_pos0, tlen, seq, qual; mates overlap at 105 to 109
    for i in range(30):
        for flag, pos, mate in ((64, 100, 105), (128, 105, 100)):
            rows.append((f"p{i}", 3 | flag, pos, mate, 15 if flag == 64 else -15, str(rng.choice(list("AC"))) * 10, int(rng.choice([5, 8, 12, 13, 16, 20, 30]))))
    rows += [(f"s{i}", 0, 100 if i % 2 else 103, None, 0, "A" * 10, 10 + i % 7) for i in range(20)]
    rows = [(k, *rows[j]) for k, j in enumerate(rng.permutation(len(rows)))]
    table = [(rid, name, flag, "c", pos, 60, [("M", 10)], "c" if mate else None, mate, tlen, seq, [q] * 10) for rid, name, flag, pos, mate, tlen, seq, q in rows]
    reads = spark.createDataFrame(table, "rid long, qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>, mate_chrom string, mate_pos0 long, tlen int, seq string, qual array<int>")
    names = spark.createDataFrame([(f"p{i}",) for i in range(30)], "qname string").select("qname", name_bit("qname")).collect()
    bits = {r[0]: r[1] for r in names}
    want = {}
    for p in (103, 107, 109):
        over = sorted(([pos, rid, name, seq[0], q] for rid, name, _, pos, _, _, seq, q in rows if pos < p <= pos + 10), key=lambda r: r[:2])
        for name, bit in bits.items():
            two = [r for r in over if r[2] == name]
            if len(two) < 2:
                continue
            (a, b), mul = two, (bit, 1 - bit)
            if a[3] == b[3]:
                a[4], b[4] = (m * (a[4] + b[4]) for m in mul)
            elif a[4] == b[4]:
                a[4], b[4] = (m * int(0.8 * a[4]) for m in mul)
            else:
                a[4], b[4] = (int(0.8 * x[4]) if x[4] > y[4] else 0 for x, y in ((a, b), (b, a)))
        want[p] = sum(r[4] >= 13 for r in over[:depth])
    positions = spark.createDataFrame([("t", "c", [103, 107, 109])], "tx_id string, chrom string, positions array<bigint>")
    assert {r["pos"]: r["covered"] for r in V.position_depth(reads, positions).collect()} == want


@pytest.mark.parametrize("depth", [3, 9, 25, 8000])
def test_long_reads_in_pieces_and_skips_against_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(V, "DEPTH", depth)
    rng = np.random.RandomState(depth)
    rows, counts = [], {}
    edge = 2 * I.BIN  # bins and pieces are crossed
    for rid in range(60):
        pos, ops = int(edge - 400 + rng.randint(300)), [("S", 3), ("M", int(rng.randint(1, 300))), (["D", "N"][rid % 2], int(rng.randint(1, 500))), ("I", 2), ("=", int(rng.randint(1, 200))), ("X", 5)]
        n = sum(k for op, k in ops if op in "SMI=X")
        qual = [int(q) for q in rng.choice([5, 12, 13, 30], n)]
        rows.append((rid, f"q{rid}", 0, "c", pos, 60, ops, None, None, 0, "A" * n, qual))
        at, off = pos, 0
        for op, k in ops:
            for j in range(k if op in "MDN=X" else 0):
                counts.setdefault(at + j, []).append((pos, rid, op != "N", op in "M=X" and qual[off + j] >= V.BASE_QUALITY))
            at, off = at + (k if op in "MDN=X" else 0), off + (k if op in "MSI=X" else 0)
    reads = spark.createDataFrame(rows, "rid long, qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>, mate_chrom string, mate_pos0 long, tlen int, seq string, qual array<int>")
    asked = list(range(edge - 450, edge + 950, 3))
    positions = spark.createDataFrame([("t", "c", [p + 1 for p in asked])], "tx_id string, chrom string, positions array<bigint>")
    got = {r["pos"] - 1: r["covered"] for r in V.position_depth(reads, positions).collect()}
    assert got == {p: sum(good for *_, good in sorted(counts[p])[:depth]) for p in asked if any(base for _, _, base, _ in counts.get(p, []))}


def test_parts_of_a_model(spark):
    rows = [
        ("+", 150, 450, [(100, 200), (300, 350), (400, 500)]), ("-", 150, 450, [(100, 200), (400, 500)]), (".", 150, 450, [(100, 200)]),
        ("+", None, None, [(100, 200), (200, 300)]), ("-", 100, 300, None), ("+", 300, 300, [(100, 300)]),
    ]
    table = [(f"t{i}", f"c{i}", 100, 500, *row, i) for i, row in enumerate(rows)]
    tx = spark.createDataFrame(table, "tx_id string, chrom string, tx_start long, tx_end long, strand string, cds_start long, cds_end long, blocks array<struct<start:bigint,end:bigint>>, line long")
    want = []
    for i, (strand, low, high, blocks) in enumerate(rows):
        for k, (a, b) in enumerate(blocks or []):
            first, last = {"+": (1, 2), "-": (2, 1)}.get(strand, (None, None))
            if low is not None:
                want += [(i, 0, max(a, low), min(b, high)), (i, first, a, min(b, low)), (i, last, max(a, high), b)]
            if k + 1 < len(blocks):
                want.append((i, 3, b, blocks[k + 1][0]))
        before, after = (50, 100), (500, 550)
        want += [(i, 4, *(after if strand == "-" else before)), (i, 5, *(before if strand == "-" else after))]
    got = [(int(r["chrom"][1:]), r["kind"], r["start"], r["end"]) for r in model_parts(tx, (50,)).collect()]
    assert sorted(got) == sorted(w for w in want if w[1] is not None and w[2] < w[3])
    assert sorted(tuple(r) for r in utr_exons(tx, 3).collect()) == sorted((f"c{i}", a, b) for i, k, a, b in want if k == 2 and a < b)
    assert sorted(tuple(r) for r in cds_exons(tx).collect()) == sorted((f"c{i}", a, b) for i, k, a, b in want if k == 0 and a < b)


def test_track_bases_are_listed_from_the_end_on_the_reverse_strand(spark):
    """250 bases 1 to 250: place i of the forward list is base 1 + 2.49 i, of the reverse list base 250 - 2.49 i, half to even."""
    block = "array<struct<start:bigint,end:bigint>>"
    tx = spark.createDataFrame([("f", "c", 0, 250, "+", [(0, 250)]), ("r", "d", 0, 250, "-", [(0, 250)]), ("s", "d", 0, 900, "-", [(0, 99), (300, 900)])], f"tx_id string, chrom string, tx_start long, tx_end long, strand string, blocks {block}")
    track = spark.createDataFrame([(c, p, p + 1, float(p + 1)) for c in "cd" for p in range(250)], "chrom string, start long, end long, value double")
    for chrom, want in (("c", [round(1 + 249 * i / 100) for i in range(1, 101)]), ("d", [round(250 - 249 * i / 100) for i in range(1, 101)])):
        got = {r["slot"]: r["value"] for r in V.genebody_from_track(track.where(F.col("chrom") == chrom), tx).collect()}
        assert got == dict(enumerate(map(float, want)))
    assert want[:3] == [248, 245, 243]
    sizes = spark.createDataFrame([("c", 250), ("d", 249)], "chrom string, size long")
    assert V.genebody_from_track(track, tx.where("chrom = 'c'"), sizes).count() == 100
    assert V.genebody_from_track(track, tx.where("tx_id = 'r'"), sizes).count() == 100  # base 250 itself is not among the places
    with pytest.raises(Exception, match="outside its contig"):
        V.genebody_from_track(track, tx, sizes.withColumn("size", F.lit(200).cast("long"))).collect()


def test_places_are_those_of_listed_bases(spark):
    """Positions from sums of exon lengths against lists of all bases."""
    rng = np.random.RandomState(2)
    rows = []
    for i in range(40):
        at, blocks = int(rng.randint(500)), []
        for _ in range(rng.randint(1, 6)):
            size = int(rng.choice([0, 1, 7, 60, 180]))
            blocks.append((at, at + size))
            at += size + int(rng.randint(1, 90))
        rows.append((f"t{i}", "c", blocks[0][0], blocks[-1][1], "+-"[i % 2], blocks))
    tx = spark.createDataFrame(rows, "tx_id string, chrom string, tx_start long, tx_end long, strand string, blocks array<struct<start:bigint,end:bigint>>")
    every = {r[0]: [p for a, b in r[5] for p in range(a + 1, b + 1)] for r in rows}
    listed, ends = {}, {r[0]: r for r in rows}
    for t, bases in every.items():
        _, _, a, b, _, blocks = ends[t]
        if not bases:
            continue
        full = [a + 1, b, *bases] if len(bases) <= 100 else list(dict.fromkeys([p for x, y in blocks for p in (x + 1, y)] + bases[:: max(1, len(bases) // 100)]))
        listed[t] = (set(full), len(full))
    got = {r["tx_id"]: (set(r["positions"]), r["listed"]) for r in V.sampled_positions(tx).collect()}
    assert got == listed
    for from_end in (False, True):
        got = {r["tx_id"]: r["positions"] for r in V.percentile_positions(tx, 100, False, from_end).collect()}
        for t, bases in every.items():
            if len(bases) >= 100:
                line = sorted(bases, reverse=from_end and ends[t][4] == "-")
                k = [(len(line) - 1) * i / 100 for i in range(1, 101)]
                assert got[t] == [round(line[math.floor(x)] * (math.ceil(x) - x) + line[math.ceil(x)] * (x - math.floor(x))) if x % 1 else line[int(x)] for x in k]


def test_noise_of_introns_is_taken_off(spark):
    """Two exons of 60 bases and an intron of 80: eight reads of 10 bases inside it are one base of noise for each of its bases."""
    block = "array<struct<start:bigint,end:bigint>>"
    tx = spark.createDataFrame([("t", "c", 0, 200, "+", [(0, 60), (140, 200)])], f"tx_id string, chrom string, tx_start long, tx_end long, strand string, blocks {block}")
    rows = [(i, f"q{i}", 0, "c", p, 60, [("M", 10)], None, None, 0, "A" * 10, [30] * 10) for i, p in enumerate([60 + 5 * k for k in range(8)] + list(range(0, 50)) + list(range(0, 50, 2)) + [145])]
    reads = spark.createDataFrame(rows, "rid long, qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>, mate_chrom string, mate_pos0 long, tlen int, seq string, qual array<int>")
    assert V.intron_noise(reads, tx).first()["noise"] == 1.0
    starts = [r[4] for r in rows]
    values = [max(0, sum(s < p <= s + 10 for s in starts) - 1) for p in [*range(1, 61), *range(141, 201)]]
    # 120 bases and step 1: every base is listed, and the exons' ends are among them
    shares = [v / sum(values) for v in values if v]
    want = 100 * math.exp(-sum(x * math.log(x) for x in shares)) / 120
    assert abs(V.tin(reads, tx, subtract=True).first()["tin"] - want) < 1e-9
    assert V.tin(reads, tx).first()["tin"] > want


def test_stored_tables_are_dropped(spark):
    from strandwise.sources import storage

    storage.drop_stored(spark)
    table = storage.stored(spark.range(3).toDF("id"), "three")
    assert table.count() == 3 and storage.drop_stored(spark) == 1 and storage.drop_stored(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0])


def test_track_slots_without_signal_are_zero(spark):
    """A track over a third of a transcript's bases still gives a hundred slots."""
    tx = spark.createDataFrame([("t", "c", 100, 400, "+", 100, 400, [(100, 400)], 0)], "tx_id string, chrom string, tx_start long, tx_end long, strand string, cds_start long, cds_end long, blocks array<struct<start:long,end:long>>, line long")
    track = spark.createDataFrame([("c", 100, 200, 2.0)], "chrom string, start long, end long, value double")
    got = {r["slot"]: r["value"] for r in V.genebody_from_track(track, tx).collect()}
    places = {i: 101 + 299 * (i + 1) / 100 for i in range(100)}
    assert got == {i: 2.0 if round(p) <= 200 else 0.0 for i, p in places.items()}
    assert V.genebody_from_track(track, tx.where("false")).count() == 0


def test_signal_of_listed_contigs(spark):
    rows = [(i, f"q{i}", 0, c, 10 * i, 60, [("M", 10)], None, None, 0, "A" * 10, [30] * 10, None) for i, c in enumerate(["a", "a", "b", "x"])]
    from strandwise.sources.alignments import SAM_SCHEMA

    reads = spark.createDataFrame(rows, SAM_SCHEMA)
    some = spark.createDataFrame([("a",), ("b",), ("b",)], "chrom string")
    assert V.signal_sum(reads).first()["bases"] == 40 and V.signal_sum(reads, contigs=some).first()["bases"] == 30
    got = V.scaled_signal(reads, 300.0, contigs=some).collect()
    assert {r["chrom"] for r in got} == {"a", "b"} and all(r["value"] == 10.0 * r["depth"] for r in got)
    for wrong in (lambda: V.scaled_signal(reads, 0.0), lambda: V.genebody_coverage(reads, some, 99)):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("mixed, hot", [(True, None), (False, 40), (True, 40)])
def test_range_join_of_mixed_lengths_and_hot_bins(spark, mixed, hot):
    draw = np.random.RandomState(7)
    lengths = [1, 30, I.JOIN_BIN, I.JOIN_BIN + 1, 20_000, 300_000, 40_000_000]
    make = lambda n: [(i, "ab"[draw.randint(2)], s, s + lengths[draw.randint(len(lengths))]) for i, s in enumerate(draw.randint(0, 50_000_000, n).tolist())]
    left, right = make(300) + [(1000 + i, "a", 5_000 + i % 7, 5_030 + i % 7) for i in range(400)], make(200) + [(900, "a", 5_000, 5_003), (901, "a", 4_000, 900_000)]
    a = spark.createDataFrame(left, "id long, chrom string, start long, end long")
    b = spark.createDataFrame(right, "r_id long, chrom string, r_start long, r_end long")
    got = I.overlap_join(a, b, mixed=mixed, hot=hot)
    assert sorted((r["id"], r["r_id"]) for r in got.collect()) == sorted((i, j) for i, c, s, e in left for j, d, t, f in right if c == d and s < f and t < e)
    assert got.columns == ["id", "chrom", "start", "end", "r_id", "r_start", "r_end"]
    got = I.point_join(a, "start", b, hot=hot)
    assert sorted((r["id"], r["r_id"]) for r in got.collect()) == sorted((i, j) for i, c, s, e in left for j, d, t, f in right if c == d and t <= s < f)


def test_long_ranges_have_few_rows_and_a_hot_bin_many_parts(spark):
    long = spark.createDataFrame([(0, 1_000_000_000), (7, 1_000_007)], "start long, end long")
    rows = I._leveled(long, F.col("start"), F.col("end"), I.JOIN_BIN, F.array(*map(F.lit, range(I.LEVELS))))
    assert rows.where("end > 2000000").count() <= 16 and rows.where("end < 2000000").count() <= 2 * I.LEVELS
    reads = spark.range(4000).select("id", F.lit("c").alias("chrom"), F.when(F.col("id") < 2000, 5).otherwise(F.col("id") * 4000).alias("start")).withColumn("end", F.col("start") + 30)
    a, b = I._salted(I._exploded(reads, F.col("start"), F.col("end"), I.JOIN_BIN), I._renamed(I._exploded(reads, F.col("start"), F.col("end"), I.JOIN_BIN)), {"chrom": "_chrom", "_bin": "_rbin"}, 100)
    assert a.groupBy("chrom", "_bin", "_salt").count().agg(F.max("count")).first()[0] < 200 and a.where("_bin = 0").select("_salt").distinct().count() == 20
    assert b.where("_rbin = 0").count() == 20 * 2000


def test_ten_reports_of_one_pass(spark):
    from strandwise.plans import multi, views

    sf = "/root/testdata/sf0.001"
    reads, tx = views.reads(spark, sf, "MD", "NM"), views.transcripts(spark, sf)
    names = list(multi.REPORTS)
    options = {"deletion_profile": {"length": 32}, "mismatch_profile": {"length": 32}, "read_gc": {"q_cut": 20}}
    got = run_reports(reads, names, tx, options)
    alone = {
        "bam_stat": P.bam_stat(reads), "read_gc": P.read_gc(reads, 20), "read_nvc": P.read_nvc(reads), "read_quality": P.read_quality(reads),
        "clipping_profile": P.cycle_profile(reads, "S", "clipping_profile"), "insertion_profile": P.cycle_profile(reads, "I", "insertion_profile"),
        "deletion_profile": P.deletion_profile(reads, 32), "mismatch_profile": P.mismatch_profile(reads, 32), "infer_experiment": P.infer_experiment(reads, tx), "read_distribution": G.read_distribution(reads, tx),
    }
    assert list(got) == names == list(alone)
    for name in names:
        assert got[name].columns == alone[name].columns and sorted(map(str, got[name].collect())) == sorted(map(str, alone[name].collect())), name
    plan = multi.tagged_counts(reads, names, options)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1 and plan.count("Generate") == 1
    first = run_reports(reads, ["deletion_profile", "infer_experiment"], tx, {"deletion_profile": {"length": 32, "most": 5}, "infer_experiment": {"sample": 50}})
    assert first["deletion_profile"].agg(F.sum("deletions")).first()[0] == 5 and first["infer_experiment"].count() == 1


def test_first_rows(spark, monkeypatch):
    from strandwise.operators import order

    monkeypatch.setattr(order, "ONE_TASK", 50)
    monkeypatch.setattr(order, "RANGES", 8)
    for keys in ([(7 * i) % 1009 for i in range(900)], [2**60 + i * i * i for i in range(900)], [5] * 900, [None] * 30 + [-(2**40) + 3 * i for i in range(600)], []):
        rows = spark.createDataFrame([(k,) for k in keys], "rid long").repartition(5)
        order_of = sorted(keys, key=lambda k: (k is not None, k or 0))
        for n in (3, 20, 333, 899, 900, 5000, None):
            got = [r["rid"] for r in order.first_rows(rows, n).collect()]
            assert sorted(got, key=lambda k: (k is not None, k or 0)) == order_of[: len(order_of) if n is None else n]


@pytest.mark.parametrize("n", [0, 1, 7, 100, 70_000, 300_001])
def test_sums_in_numpy_order(spark, n):
    from strandwise.operators.order import ordered_mean_std

    values = (np.random.RandomState(n).standard_normal(n) * 10.0 ** np.random.RandomState(n + 1).randint(-8, 9, n)).tolist()
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(7)
    mean, std = ordered_mean_std(rows, "v", ["i"])
    if not n:
        assert math.isnan(mean) and math.isnan(std)
    else:
        x = np.array(values)
        assert mean == np.sum(x) / n and std == np.sqrt(np.sum((x - mean) * (x - mean)) / n)
        assert V.tin_summary(rows.select("i", F.abs("v").alias("tin")), ["i"]).first()["mean"] == np.mean(np.abs(x[x != 0]))


def test_reads_that_break_the_order_of_contigs(spark):
    import random

    from strandwise.operators.order import before_break

    contigs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ref_id int, chrom string")
    for seed in range(6):
        draw = random.Random(seed)
        chroms = sorted(draw.choice("aabc") for _ in range(40))
        for _ in range(seed % 3):
            chroms[draw.randrange(40)] = draw.choice(["a", "c", None, "elsewhere"])
        kept, top = 0, 0
        for c in chroms:
            k = {"a": 0, "b": 1, "c": 2}.get(c)
            if k is None or k < top:
                break
            kept, top = kept + 1, k
        rows = spark.createDataFrame([(i, c) for i, c in enumerate(chroms)], "rid long, chrom string").repartition(4)
        assert sorted(r["rid"] for r in before_break(rows, contigs).collect()) == list(range(kept))


def test_single_cell_letters_and_totals(spark):
    tags = "map<string,struct<t:string,i:bigint,s:string>>"
    rows = [(0, "q", 0, "a", [("M", 5)], {"xf": ("i", 1, None), "RE": ("Z", None, "Exon")}), (1, "r", 0, "a", [("M", 5)], {"xf": ("i", 1, None), "RE": ("i", 4, None)})]
    reads = spark.createDataFrame(rows, f"rid long, qname string, flag int, chrom string, cigar array<struct<op:string,len:int>>, tags {tags}")
    stat = S.single_cell_stat(reads, "a")
    assert (stat.first()["exon"], stat.first()["confident"]) == (1, 2) and S.single_cell_shares(stat).first()["exon"] == 50
    with pytest.raises(Exception, match="to divide by"):
        S.single_cell_shares(S.single_cell_stat(reads.where("false"))).collect()
    with pytest.raises(ValueError):
        S.barcode_qualities(spark.createDataFrame([], "rec_no long, qual string"), must_have=True)


@pytest.mark.parametrize("by", ["sequence", "position"])
def test_duplication_over_three_batches(spark, tmp_path, by):
    from strandwise.plans import views
    from strandwise.streaming.counters import duplication_changes, duplication_so_far

    reads = views.reads(spark, "/root/testdata/sf0.001").where("rid % 23 = 0").withColumns({"seq": F.substring("seq", 1, 4), "pos0": F.col("pos0") % 5, "cigar": F.slice("cigar", 1, 1)})
    for k in range(3):
        reads.where(f"rid % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"b{k}").glob("part-*"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = duplication_changes(stream, by).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert len(query.recentProgress) >= 3 and query.exception() is None
    whole = P.duplication(spark.read.parquet(str(tmp_path / "in")), by)
    got = duplication_so_far(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 2


def test_running_junctions(spark, tmp_path):
    from strandwise.plans import views
    from strandwise.streaming.counters import running_junctions

    reads, tx = views.reads(spark, "/root/testdata/sf0.001"), views.transcripts(spark, "/root/testdata/sf0.001")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_junctions(stream, tx).writeStream.outputMode("complete").format("memory").queryName("junctions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert sorted(map(tuple, spark.table("junctions").collect())) == sorted(map(tuple, G.junction_annotation(reads, tx).drop("first_rid").collect()))
