"""BigWig files made by hand, of all three kinds of data block."""

import struct
import zlib

import pytest

from strandwise.sources.bigwig import CONTIGS, FILE, INDEX, BigWigReader, bigwig_contigs, read_bigwig


def bigwig(path, packed):
    names = [(b"chr1", 1000), (b"chr10", 300)]
    block = lambda number, start, end, step, span, kind, n, body: struct.pack("<IIIIIBBH", number, start, end, step, span, kind, 0, n) + body
    made = [
        block(0, 100, 160, 0, 0, 1, 2, struct.pack("<IIfIIf", 100, 150, 5.0, 150, 160, 2.5)),
        block(0, 300, 310, 0, 5, 2, 2, struct.pack("<IfIf", 300, -3.0, 305, 1.0)),
        block(1, 10, 40, 10, 10, 3, 3, struct.pack("<fff", 1.0, 0.0, 2.0)),
    ]
    tree = struct.pack("<IIIIQQ", CONTIGS, 2, 5, 8, 2, 0)
    tree += struct.pack("<BBH", 0, 0, 1) + names[0][0].ljust(5, b"\0") + struct.pack("<Q", 64 + 32 + 17)
    tree += struct.pack("<BBH", 1, 0, 2) + b"".join(n.ljust(5, b"\0") + struct.pack("<II", i, s) for i, (n, s) in enumerate(names))
    data, places, at = b"", [], 64 + len(tree)
    for m in made:
        m = zlib.compress(m) if packed else m
        places.append((at + len(data), len(m)))
        data += m
    index = at + len(data)
    bounds = [(0, 100, 0, 160), (0, 300, 0, 310), (1, 10, 1, 40)]
    leaf = struct.pack("<BBH", 1, 0, 3) + b"".join(struct.pack("<IIIIQQ", *b, *p) for b, p in zip(bounds, places))
    tail = struct.pack("<IIQIIIIQII", INDEX, 4, 3, 0, 0, 1, 300, index, 2, 0) + struct.pack("<BBH", 0, 0, 1) + struct.pack("<IIIIQ", 0, 0, 1, 300, index + 48 + 28) + leaf
    head = struct.pack("<IHHQQQHHQQI", FILE, 4, 0, 64, at, index, 0, 0, 0, 0, 4096 if packed else 0).ljust(64, b"\0")
    path.write_bytes(head + tree + data + tail)


@pytest.mark.parametrize("packed", [True, False])
def test_bigwig(spark, tmp_path, packed):
    bigwig(tmp_path / "a.bw", packed)
    got = sorted(tuple(r) for r in read_bigwig(spark, str(tmp_path / "a.bw")).collect())
    assert got == [("chr1", 100, 150, 5.0), ("chr1", 150, 160, 2.5), ("chr1", 300, 305, -3.0), ("chr1", 305, 310, 1.0), ("chr10", 10, 20, 1.0), ("chr10", 20, 30, 0.0), ("chr10", 30, 40, 2.0)]
    assert [tuple(r) for r in bigwig_contigs(spark, str(tmp_path / "a.bw")).collect()] == [("chr1", 1000), ("chr10", 300)]


def test_input_lists(spark, tmp_path):
    from strandwise.sources.inputs import alignment_files, sample_name

    (tmp_path / "in").mkdir()
    for n in ("b.bam", "a.bam", "a.bam.bai", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"")
    a, b = str(tmp_path / "in" / "a.bam"), str(tmp_path / "in" / "b.bam")
    assert alignment_files(spark, str(tmp_path / "in")) == [a]
    assert alignment_files(spark, str(tmp_path / "in"), index=False) == [a, b]
    assert alignment_files(spark, f"{b}, {a}", index=False) == [b, a]
    (tmp_path / "list").write_text(f"# x\n{a}\n")
    assert alignment_files(spark, str(tmp_path / "list")) == [a]
    with pytest.raises(FileNotFoundError):
        alignment_files(spark, "nowhere.bam")
    assert sample_name("/x/1-a.b.bam") == "V1_a_b"


@pytest.mark.parametrize("where, n_blocks", [
    ("chrom = 'chr1'", 2), ("chrom = 'chr10' and start < 25", 1), ("chrom = 'chr1' and end > 155 and start < 300", 1), ("chrom = 'chr1' and start < 150", 1), ("chrom = 'chr1' and start >= 160", 2),
    ("chrom = 'chr2'", 0), ("chrom = 'chr1' and end >= 310", 1), ("chrom = 'chr1' and end > 311", 0), ("chrom = 'chr1' and start = 305", 1), ("start > 0", 3), ("chrom in ('chr1', 'chr10') and start = 10", 3),
])
def test_regions_choose_blocks(spark, tmp_path, where, n_blocks):
    bigwig(tmp_path / "a.bw", True)
    whole = read_bigwig(spark, str(tmp_path / "a.bw"))
    kept = spark.createDataFrame(whole.collect(), whole.schema).where(where)
    got = whole.where(where)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept.collect()))
    from pyspark.sql import datasource as ds

    kinds = {"=": ds.EqualTo, "<": ds.LessThan, ">": ds.GreaterThan, ">=": ds.GreaterThanOrEqual, "<=": ds.LessThanOrEqual}
    filters = []
    for part in where.split(" and "):
        name, op, value = part.split(" ", 2)
        if op in kinds:
            filters.append(kinds[op]((name,), value.strip("'") if name == "chrom" else int(value)))
    reader = BigWigReader(str(tmp_path / "a.bw"))
    reader.pushFilters(filters)
    assert sum(len(p.blocks) for p in reader.partitions()) == n_blocks
