"""Readers of several files and of parts, sinks, and the reports' summaries, on small inputs."""

import glob
import math
import random
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandwise.operators import coverage as V
from strandwise.operators import expression as X
from strandwise.operators import intervals as I
from strandwise.operators import regions as G
from strandwise.operators import sequences as S
from strandwise.sources import alignments, bam, bam_writer, bgzf, fastx, inputs, tables
from strandwise.streaming import counters

HEAD = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100000\n@SQ\tSN:chr2\tLN:500\n"


def sam_line(n, pos=None, tags="\tNM:i:-3\tXB:B:s,1,-2\tXF:f:0.5\tCB:Z:AC-1\tXA:A:q\tXI:i:70000"):
    return f"r{n}\t0\tchr1\t{pos or n * 7 + 1}\t40\t4S10M5N3M1I2M\t*\t0\t0\t{'ACGTN' * 4}\t{'I' * 20}{tags}\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sams") / "in.sam"
    path.mkdir()
    (path / "a.sam").write_text(HEAD + "".join(sam_line(n) for n in range(5)))
    (path / "b.sam").write_text(HEAD + "\n" + "".join(sam_line(n) for n in range(5, 12)))
    return str(path)


def text(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))).splitlines()


def test_lines_are_numbered_over_files_and_their_parts(spark, folder, tmp_path):
    rows = alignments.read_sam(spark, folder).orderBy("rid").select("rid", "qname").collect()
    assert [(r["rid"], r["qname"]) for r in rows] == [(n, f"r{n}") for n in range(12)]
    assert [r["chrom"] for r in alignments.sam_contigs(spark, folder).orderBy("ref_id").collect()] == ["chr1", "chr2"]
    (tmp_path / "l").write_text("".join(f"{n}\n" for n in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many parts of one file
    try:
        lines = alignments.numbered_lines(spark, str(tmp_path / "l"))
        assert lines.rdd.getNumPartitions() > 3 and lines.where("line <> cast(value as long)").count() == 0 and lines.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bam_comes_back_as_written(spark, folder, tmp_path):
    reads = alignments.read_sam(spark, folder).orderBy("rid")
    contigs = alignments.sam_contigs(spark, folder)
    bam_writer.write_bam(reads, str(tmp_path / "out"), contigs)
    files = sorted(glob.glob(f"{tmp_path}/out/*.bam"))
    got = [r.asDict(True) | {"rid": 0} for f in files for r in alignments.read_alignments(spark, f).orderBy("rid").collect()]
    assert got == [r.asDict(True) | {"rid": 0} for r in reads.collect()] and len(got) == 12
    with pytest.raises(FileExistsError):
        bam_writer.write_bam(reads, str(tmp_path / "out"), contigs)


def small_blocks(path, rows, n_contigs=2, size=150):
    """A BAM file whose blocks hold ``size`` bytes, so that records cross them."""
    names = [f"chr{i + 1}".encode() for i in range(n_contigs)]
    held = b"BAM\1" + struct.pack("<ii", 0, n_contigs) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 9) for n in names)
    for r in rows:
        held += bam_writer.record(r, {n.decode(): i for i, n in enumerate(names)})
    path.write_bytes(b"".join(bam_writer.bgzf_block(held[i : i + size]) for i in range(0, len(held), size)) + bam_writer.bgzf_block(b""))


@pytest.mark.parametrize("split", [60, 200, 333, 1000, 10**6])
def test_bam_is_read_in_parts(spark, folder, tmp_path, split):
    """Without an index; rid counts records over parts and files, wherever parts begin."""
    rows = alignments.read_sam(spark, folder).orderBy("rid").collect()
    small_blocks(tmp_path / "a.bam", rows)
    small_blocks(tmp_path / "b.bam", rows[:5], size=40)
    small_blocks(tmp_path / "c.bam", [])
    paths = ",".join(str(tmp_path / n) for n in ("a.bam", "c.bam", "b.bam"))
    assert len(bam.BamReader({"path": paths, "split": split}).partitions()) >= (3 if split == 10**6 else 5)
    got = bam.read_bam(spark, paths, split).orderBy("rid").collect()
    want = [*rows, *rows[:5]]
    assert [r.asDict(True) for r in got] == [r.asDict(True) | {"rid": i} for i, r in enumerate(want)]


def test_long_records_and_damage(spark, folder, tmp_path):
    """A record over many blocks and parts, unmapped reads, reads without bases or qualities."""
    row = alignments.read_sam(spark, folder).orderBy("rid").first()
    long = Row(**row.asDict() | {"cigar": [], "seq": "ACGTN" * 40_000, "qual": [7] * 200_000})
    bare = Row(**row.asDict() | {"chrom": None, "pos0": None, "mapq": None, "cigar": [], "seq": "", "qual": [], "tags": {}, "flag": 4})
    plain = Row(**row.asDict() | {"seq": "ACG", "qual": [], "cigar": []})
    rows = [row, long, bare, plain, long, *[row] * 40]
    small_blocks(tmp_path / "a.bam", rows, size=20_000)
    got = bam.read_bam(spark, str(tmp_path / "a.bam"), 5_000).orderBy("rid").collect()
    assert [r["rid"] for r in got] == list(range(len(rows))) and [len(r["seq"]) for r in got] == [len(r["seq"]) for r in rows]
    assert got[1]["seq"] == long["seq"] and got[2]["mapq"] == 255 and got[2]["chrom"] is None and got[2]["tags"] == {} and got[3]["qual"] == [] and got[3]["seq"] == "ACG"
    data = (tmp_path / "a.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut short"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()


def placed_reads(spark):
    """Reads over two contigs, in no order."""
    draw = random.Random(3)
    rows = []
    for n in range(900):
        chrom = draw.choice(["chr1", "chr2", None])
        span = draw.choice([20, 500, 40_000])
        pos = None if chrom is None else draw.randrange(400_000)
        rows.append((n, f"q{n}", 0 if chrom else 4, chrom, pos, 30, [("M", 10), ("N", span), ("M", 10)] if chrom else [], None, None, 0, "ACGTA" * 4, [20] * 20, {"RG": ("Z", None, "g")}))
    return spark.createDataFrame(rows, alignments.SAM_SCHEMA)


CONTIGS = [(0, "chr1", 500_000), (1, "chr2", 500_000)]
LINES = ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:chr1\tLN:500000\tM5:abc", "@RG\tID:g\tSM:s", "@PG\tID:p", "@CO\tfree text"]


def test_one_file_with_header_and_index(spark, tmp_path, monkeypatch):
    reads, contigs = placed_reads(spark).repartition(5), spark.createDataFrame(CONTIGS, "ref_id int, chrom string, length long")
    path = str(tmp_path / "one.bam")
    bam_writer.write_bam(reads, path, contigs, LINES, single=True, by_place=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one.bam", "one.bam.bai"]
    assert bam.bam_header(spark, path) == ["@HD\tVN:1.6\tSO:coordinate", LINES[1], "@SQ\tSN:chr2\tLN:500000", *LINES[2:]]
    got = bam.read_bam(spark, path, 3_000).orderBy("rid").collect()
    order = sorted(reads.collect(), key=lambda r: (r["chrom"] is None, r["chrom"] or "", r["pos0"] or 0, r["rid"]))
    assert [r.asDict(True) | {"rid": 0} for r in got] == [r.asDict(True) | {"rid": 0} for r in order]
    for chrom, start, end in (("chr1", 100_000, 130_000), ("chr2", 0, 1), ("chr2", 399_000, 500_000), ("chr1", 250_000, 250_001), ("chrX", 0, 9)):
        found = sorted(r["qname"] for r in bam.read_region(spark, path, chrom, start, end).collect())
        assert found == sorted(r["qname"] for r in order if r["chrom"] == chrom and r["pos0"] < end and r["pos0"] + sum(c["len"] for c in r["cigar"]) > start)
        within = (F.col("chrom") == chrom) & (F.col("pos0") >= start) & (F.col("pos0") < end)
        assert sorted(r["qname"] for r in bam.read_indexed(spark, path).where(within).collect()) == sorted(r["qname"] for r in order if r["chrom"] == chrom and start <= r["pos0"] < end)


def test_a_region_reads_only_its_blocks(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reads, contigs = placed_reads(spark).where("chrom is not null and size(cigar) > 0 and cigar[1].len < 1000"), spark.createDataFrame(CONTIGS, "ref_id int, chrom string, length long")
    more = reads.crossJoin(spark.range(70)).drop("id").withColumn("rid", F.monotonically_increasing_id())
    bam_writer.write_bam(more.coalesce(1), str(tmp_path / "a.bam"), contigs, single=True, by_place=True)
    read = []
    old = bgzf.bgzf_blocks

    def counted(raw, at=0):
        for found in old(raw, at):
            read.append(found[0])
            yield found

    monkeypatch.setattr(bgzf, "bgzf_blocks", counted)
    monkeypatch.setattr(bgzf, "RUN", 1)

    def rows(filters):
        read.clear()
        reader = bam.IndexedBamReader({"path": str(tmp_path / "a.bam")})
        assert list(reader.pushFilters(filters)) == filters
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p)), len(set(read))

    everything, blocks = rows([])
    some, fewer = rows([EqualTo(("chrom",), "chr2"), GreaterThanOrEqual(("pos0",), 200_000), LessThan(("pos0",), 210_000)])
    assert everything == more.count() and 0 < some < everything / 5 and fewer < blocks / 4
    assert some >= more.where("chrom = 'chr2' and pos0 >= 200000 and pos0 < 210000").count() > 0


def test_writes_that_append_and_overwrite(spark, folder, tmp_path):
    reads, contigs = alignments.read_sam(spark, folder), alignments.sam_contigs(spark, folder)
    path = str(tmp_path / "out")
    for mode, n in (("append", 12), ("append", 24), ("overwrite", 12)):
        bam_writer.write_bam(reads, path, contigs, mode=mode)
        assert bam.read_bam(spark, ",".join(sorted(glob.glob(f"{path}/*.bam")))).count() == n
        assert len(glob.glob(f"{path}/*.bai")) == len(glob.glob(f"{path}/*.bam"))


def test_samples_and_gene_tables(spark, folder, tmp_path):
    reads, contigs = alignments.read_sam(spark, folder), alignments.sam_contigs(spark, folder)
    bam_writer.write_bam(reads.coalesce(1), str(tmp_path / "out"), contigs)
    (tmp_path / "in").mkdir()
    for name in ("1a.bam", "b.c.bam"):
        (tmp_path / "in" / name).write_bytes(open(glob.glob(f"{tmp_path}/out/*.bam")[0], "rb").read())
    rows = inputs.read_samples(spark, str(tmp_path / "in"), index=False).groupBy("sample").count().collect()
    assert {r["sample"] for r in rows} == {"V1a", "b_c"} and len({r["count"] for r in rows}) == 1
    (tmp_path / "g").write_text("#id\ng1 A chr1 10 90 + coding x x x 80\n\ng2 B chr2 1 9 - nc x x x 7\n")
    info = tables.read_gene_information(spark, str(tmp_path / "g")).orderBy("gene_id").collect()
    assert [(r["gene_id"], r["start"], r["gene_type"], r["exon_length"]) for r in info] == [("g1", 10, "coding", 80), ("g2", 1, "nc", 7)]


@pytest.mark.parametrize("seed", range(3))
def test_merge_over_edges_of_bins(spark, seed):
    draw, size = random.Random(seed), I.BIN
    rows = [(c, s, s + draw.choice([1, 7, size // 2, size, 3 * size])) for c in "ab" for s in (draw.randrange(9 * size) for _ in range(9))]
    rows += [("e", 0, size), ("e", size, size + 5), ("e", 2 * size, 3 * size), ("e", 3 * size + 1, 3 * size + 2), ("e", -5, -1), ("e", -1, 0)]
    want = []
    for c, s, e in sorted(rows):
        if want and want[-1][0] == c and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([c, s, e])
    got = I.merge(spark.createDataFrame(rows, "chrom string, start long, end long"))
    assert sorted(map(list, got.collect())) == want


def test_text_of_numbers(spark):
    values = [0.0, -0.0, 5.0, 0.25, 1e7, 123456789.125, -2.5e15, 1e16, 1.5e16, -3.25e22, 1e-3, 1.25e-4, 1e-5, -2.5e-7, 1e100, float("nan"), float("inf"), -float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", tables.float_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == [repr(v) for v in values]
    assert tables.percent_text(1, 3) == "33.33"


def test_text_of_a_number_of_digits(spark, tmp_path):
    values = [0.0, -0.0, 5.0, 0.25, 1 / 3, -2 / 3, 1e11, 1e12, 123456789012.5, 123456789013.5, 1234567890125.0, 0.1234567890125, 1.0000000000005, 1e-4, 0.00012345678901250001, 1e-5, -2.5e-7, 1e100, 5e-324, 1.7976931348623157e308, float("nan"), float("inf"), -float("inf")]
    rows = spark.createDataFrame([*enumerate(values), (99, None)], "i long, v double")
    want = ["0" if v == 0 else "%.12g" % v for v in values]
    got = rows.select("i", tables.digits_text(F.col("v")).alias("t"), tables.digits_text(F.col("v"), 3).alias("short")).orderBy("i").collect()
    assert [r["t"] for r in got] == [*want, None]
    assert [r["short"] for r in got] == [*["0" if v == 0 else "%.3g" % v for v in values], None]
    tables.write_table(rows.where("i in (2, 4)").coalesce(1), str(tmp_path / "t"), ["i"], digits=12)
    lines = {line for part in (tmp_path / "t").glob("part-*") for line in part.read_text().split("\n") if line}
    assert lines == {"i\tv", "2\t5", "4\t0.333333333333"}


def test_sinks(spark, tmp_path):
    track = spark.createDataFrame([("c2", 4, 6, 1.5), ("c1", 0, 1, -2.0), ("x", 0, 9, 1.0)], "chrom string, start long, end long, value double")
    sizes = spark.createDataFrame([(0, "c2"), (1, "none"), (2, "c1")], "line long, chrom string")
    tables.write_wig(track, str(tmp_path / "w"), sizes)
    assert text(tmp_path / "w") == ["variableStep chrom=c2", "5\t1.50", "6\t1.50", "variableStep chrom=none", "variableStep chrom=c1", "1\t-2.00"]
    found = spark.createDataFrame([("c", 10, 30, 4, 7, "annotated"), ("c", 5, 9, 1, 2, "complete_novel")], "chrom string, start long, end long, reads long, first_rid long, kind string")
    tables.write_junction_bed(found, str(tmp_path / "j"))
    assert text(tmp_path / "j") == ["c\t4\t10\tcomplete_novel\t1\t.\t4\t10\t0,0,205\t2\t1,1\t0,5", "c\t9\t31\tannotated\t4\t.\t9\t31\t205,0,0\t2\t1,1\t0,21"]
    tables.write_interact(found, str(tmp_path / "i"), "a.bam")
    lines = text(tmp_path / "i")
    assert lines[0].startswith("track type=interact ") and "a.bam" in lines[0] and len(lines) == 3
    assert lines[2].split("\t") == ["c", "9", "31", "c:9-31_annotated", "4", "4.0", "RNAseq_junction", "205,0,0", "c", "9", "10", "c:9-10", ".", "c", "30", "31", "c:30-31", "."]
    tables.write_table(found.select("first_rid", (F.col("reads") / 8).alias("part")), str(tmp_path / "t"), ["first_rid"])
    assert [x for x in text(tmp_path / "t") if x != "first_rid\tpart"] == ["2\t0.125", "7\t0.5"]
    tables.write_fastq(spark.createDataFrame([(1, "b", "CC", "II"), (0, "a", "A", "#")], "rid long, name string, seq string, qual string"), str(tmp_path / "q"))
    assert text(tmp_path / "q") == ["@a", "A", "+", "#", "@b", "CC", "+", "II"]
    assert [(r["seq"], r["qual"]) for r in fastx.read_fastq(spark, str(tmp_path / "q")).orderBy("rec_no").collect()] == [("A", "#"), ("CC", "II")]
    for write in (lambda p: tables.write_wig(track, p, sizes), lambda p: tables.write_bedgraph(track, p)):
        with pytest.raises(Exception, match="exists|EXISTS"):
            write(str(tmp_path / "w"))


def test_hexamers_by_file(spark):
    rows = spark.createDataFrame([("f", "AAAC"), ("g", "AAA"), ("h", "NNN")], "file string, seq string")
    got = {(r["file"], r["kmer"]): (r["reads"], r["frequency"]) for r in S.hexamer_counts(rows, 2, "file").collect()}
    assert len(got) == 48 and got["f", "AA"] == (2, 2 / 3) and got["f", "AC"] == (1, 1 / 3) and got["g", "AA"] == (2, 1.0) and got["h", "AA"] == (0, 0.0)


def test_edits_up_to_a_limit(spark):
    tags = "map<string,struct<t:string,i:bigint,s:string>>"
    rows = spark.sql(f"select id as rid, cast(map('CR', named_struct('t', 'Z', 'i', null, 's', 'AC'), 'CB', named_struct('t', 'Z', 'i', null, 's', if(id % 2 = 0, 'AC-1', 'AG-1'))) as {tags}) as tags from range(6)")
    row = lambda n: tuple(S.edit_summary(rows, "CR", "CB", n).first())
    assert row(None) == (7, 0, 3, 3) and row(4) == (4, 0, 2, 2) and row(6) == (6, 0, 3, 3) and row(9) == (7, 0, 3, 3)
    assert S.edit_matrix(rows, "CR", "CB", 3).collect()[0]["reads"] == 1 and S.code_frequency(rows, "CR", "CB", 1).count() == 1
    with pytest.raises(ValueError):
        S.edit_summary(rows, "CR", "CB", 0)


def test_summaries(spark):
    hist = spark.createDataFrame([(-5, 0, 1), (0, 5, 2), (5, 10, 1), (10, 15, 0)], "bin_start long, bin_end long, pairs long")
    row = G.distance_summary(hist).first()
    assert row["mean"] == 2.5 and row["median"] == 2.5 and math.isclose(row["std"], math.sqrt(50 / 3))
    assert G.distance_summary(hist.where("pairs > 5")).first()["mean"] is None
    tin = V.tin_summary(spark.createDataFrame([("a", 0.0), ("b", 10.0), ("c", 20.0), ("d", 60.0)], "tx_id string, tin double")).first()
    assert (tin["mean"], tin["median"]) == (30, 20) and math.isclose(tin["std"], math.sqrt(1400 / 3))
    curve = [n * n for n in range(100)]
    shape = V.curve_shape(spark.createDataFrame([("s", n, v) for n, v in enumerate(curve)], "sample string, slot int, covered long")).orderBy("slot").collect()
    mean = sum(curve) / 100
    sd = math.sqrt(sum((v - mean) ** 2 for v in curve) / 99)
    assert shape[99]["scaled"] == 1 and shape[0]["scaled"] == 0 and math.isclose(shape[3]["skewness"], sum(((v - curve[50]) / sd) ** 3 for v in curve) / 100)
    with pytest.raises(Exception, match="flat"):
        V.curve_shape(spark.createDataFrame([("s", n, 4) for n in range(100)], "sample string, slot int, covered long")).collect()
    series = spark.createDataFrame([("a", 50, 2.0), ("a", 100, 4.0), ("b", 50, 30.0), ("b", 100, 20.0), ("z", 50, 0.0), ("z", 100, 0.0)], "tx_id string, percent int, rpkm double")
    errors = {(r["quartile"], r["percent"]): r["error"] for r in X.saturation_errors(series).collect()}
    assert errors == {(1, 50): 0.5, (1, 100): 0.0, (4, 50): 0.5, (4, 100): 0.0}


def test_stranded_signal_is_negative_on_the_reverse_strand(spark):
    schema = "rid long, qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>, mate_chrom string, mate_pos0 long, tlen int, seq string, qual array<int>"
    reads = spark.createDataFrame([(i, f"q{i}", flag, "c", 5, 60, [("M", 4)], None, None, 0, "ACGT", [30] * 4) for i, flag in enumerate([0, 16, 16])], schema)
    got = {r["strand"]: (r["start"], r["end"], r["depth"], r["value"]) for r in V.scaled_signal(reads, 24.0, "++,--").collect()}
    assert got == {"+": (5, 9, 1, 2.0), "-": (5, 9, 2, -4.0)}
    with pytest.raises(Exception, match="strand rule"):
        V.signal(reads, "1++,1--,2+-,2-+").collect()


def test_running_gc(spark, tmp_path):
    schema = alignments.SAM_SCHEMA
    rows = alignments.decode_sam(spark.createDataFrame([(n, sam_line(n).rstrip("\n")) for n in range(3)], "rid long, value string"))
    rows.write.parquet(str(tmp_path / "p"))
    stream = counters.running_gc(spark.readStream.schema(schema).parquet(str(tmp_path / "p")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("gc").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sum(r["reads"] for r in spark.table("gc").collect()) == 3


def test_other_endings_of_compressed_text(spark, tmp_path):
    import bz2
    import gzip

    data = (HEAD + "".join(sam_line(n) for n in range(7))).encode()
    want = None
    for ending, pack in ((".gz", gzip.compress), (".Z", gzip.compress), (".z", lambda d: gzip.compress(d[:300]) + gzip.compress(d[300:])), (".bz2", bz2.compress), (".bz", bz2.compress), (".bzip2", bz2.compress)):
        path = tmp_path / f"a.sam{ending}"
        path.write_bytes(pack(data))
        got = [r.asDict(True) for r in alignments.read_alignments(spark, str(path)).orderBy("rid").collect()]
        want = want or got
        assert got == want and [r["rid"] for r in got] == list(range(7))


def test_sequences_of_several_files_keep_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">one\nACG\nTTN\n")
    (tmp_path / "in" / "b.fa").write_text("GGG\n>two\nCC\n")
    got = {r["name"]: r["seq"] for r in fastx.read_permissive(spark, str(tmp_path / "in")).collect()}
    assert got == {"ONE": "ACGTTN", "TWO": "CC"}


def test_curves_of_samples_are_those_of_each(spark):
    from strandwise.plans import views

    tx = views.transcripts(spark, "/root/testdata/sf0.001")
    reads = views.reads(spark, "/root/testdata/sf0.001").withColumn("sample", F.concat(F.lit("s"), (F.col("rid") % 3).cast("string")))
    got = {(r["sample"], r["slot"]): r["covered"] for r in V.genebody_by_sample(reads, tx).collect()}
    want = {(s, r["slot"]): r["covered"] for s in ("s0", "s1", "s2") for r in V.genebody_coverage(reads.where(F.col("sample") == s), tx).collect()}
    assert got == want and len(got) == 300 and len(set(got.values())) > 20


def test_error_rules(spark):
    from strandwise.operators import records as O
    from strandwise.operators import tracks as T

    track = spark.createDataFrame([("c", 0, 5, 1.0)], "chrom string, start long, end long, value double")
    sizes = lambda n: spark.createDataFrame([("c", n), ("d", 5)], "chrom string, length long")
    assert T.overlay_tracks(track, track, "Add", (sizes(9), sizes(9))).first()["value"] == 2
    with pytest.raises(Exception, match="sizes differ"):
        T.overlay_tracks(track, track, "Add", (sizes(9), sizes(8))).collect()
    with pytest.raises(ValueError):
        T.normalize_track(track, 0)
    tx = spark.createDataFrame([], "tx_id string, chrom string, tx_start long, tx_end long, strand string, cds_start long, cds_end long, blocks array<struct<start:long,end:long>>, line long")
    with pytest.raises(ValueError, match="no exons"):
        O.split_reads(spark.createDataFrame([], alignments.SAM_SCHEMA), tx)
