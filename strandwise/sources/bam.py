"""BAM as a Python data source that reads any byte ranges of files, with or without an index.

A part finds its first block and its first record by itself and reads on to the first record that begins beyond it, so the parts of
a file hold each record once.  Numbers of records come from a table of counts, a row for each part; it also checks that each part
began where the part before it ended.  Rows leave as Arrow batches, decoded a column at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from strandwise.functions.cigar import reference_span
from strandwise.sources.bgzf import Records, first_block, first_record, header, record_runs

#: Bytes of a file that a part has.
SPLIT = 1 << 26
#: Parts of files up to which their table is broadcast.
FEW_PARTS = 10_000
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
RECORD = (
    "qname string, flag int, chrom string, pos0 long, mapq int, cigar array<struct<op:string,len:int>>,"
    " mate_chrom string, mate_pos0 long, tlen int, seq string, qual array<int>, tags map<string,struct<t:string,i:bigint,s:string>>"
)
SAM_SCHEMA = "rid long, " + RECORD
_TAG = pa.struct([("t", pa.string()), ("i", pa.int64()), ("s", pa.string())])
_PLACED = "part int, at long, place long, " + RECORD
_COUNTS = "part int, file int, n long, first long, after long"


def open_place(path: str):
    """The file system of a path, and the path there."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def tag_values(data: bytes) -> list[tuple[str, str, int | None, str | None]]:
    """Key, type, number and text of each tag."""
    out, at = [], 0
    while at < len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in NUMBERS:
            out.append((key, "i", struct.unpack_from(NUMBERS[kind], data, at)[0], None))
            at += struct.calcsize(NUMBERS[kind])
        elif kind == "A":
            out.append((key, "A", None, chr(data[at])))
            at += 1
        elif kind == "f":
            out.append((key, "f", None, repr(struct.unpack_from("<f", data, at)[0])))
            at += 4
        elif kind in "ZH":
            end = data.index(b"\0", at)
            out.append((key, kind, None, data[at:end].decode()))
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = NUMBERS.get(sub, "<f")
            size = struct.calcsize(form)
            out.append((key, "B", None, ",".join([sub, *(str(struct.unpack_from(form, data, at + 5 + k * size)[0]) for k in range(n))])))
            at += 5 + n * size
        else:
            raise ValueError(f"unknown tag type {kind}")
    return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _list(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _texts(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat, np.uint8).tobytes())])


_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
_OP_NAMES, _PAIRS = pa.array(list(OPS)), np.array([[ord(a), ord(b)] for a in BASES for b in BASES], np.uint8)


def columns(data: bytes, starts: np.ndarray, names: list[str]) -> list[pa.Array]:
    """The columns of RECORD for records that begin at starts (the last is the end)."""
    raw, at, n = np.frombuffer(data, np.uint8), starts[:-1], len(starts) - 1
    fixed = np.ascontiguousarray(raw[at[:, None] + np.arange(36)]).view(_FIXED).ravel()
    wide = {k: fixed[k].astype(np.int64) for k in ("ref", "pos", "mate", "mate_pos", "n_name", "n_ops", "n_seq")}
    contigs = pa.array(names, pa.string())
    contig = lambda k: contigs.take(pa.array(wide[k], mask=wide[k] < 0))
    place = lambda k: pa.array(wide[k], mask=wide[k] < 0)
    name_size = np.maximum(wide["n_name"] - 1, 0)
    ops_at = at + 36 + wide["n_name"]
    ops = np.ascontiguousarray(raw[_spread(ops_at, 4 * wide["n_ops"])]).view("<u4").astype(np.int64)
    cigar = pa.StructArray.from_arrays([_OP_NAMES.take(pa.array(ops & 15)), pa.array((ops >> 4).astype(np.int32))], ["op", "len"])
    seq_at = ops_at + 4 * wide["n_ops"]
    packed = (wide["n_seq"] + 1) // 2
    letters = _PAIRS[raw[_spread(seq_at, packed)]].ravel()
    letters = letters[_spread(np.cumsum(2 * packed) - 2 * packed, wide["n_seq"])]
    qual_at = seq_at + packed
    n_qual = np.where((wide["n_seq"] > 0) & (raw[np.minimum(qual_at, len(raw) - 1)] == 255), 0, wide["n_seq"])
    tags_at = (qual_at + wide["n_seq"]).tolist()
    tags = [tag_values(data[a:b]) if a < b else [] for a, b in zip(tags_at, starts[1:].tolist())]
    flat = [x for t in tags for x in {v[0]: v for v in t}.values()]
    counts = np.array([len({v[0] for v in t}) for t in tags], np.int64)
    key, kind, number, text = zip(*flat) if flat else ((), (), (), ())
    entry = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(number, pa.int64()), pa.array(text, pa.string())], fields=list(_TAG))
    tag_map = pa.MapArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(key, pa.string()), entry)
    return [
        _texts(raw[_spread(at + 36, name_size)], name_size), pa.array(fixed["flag"].astype(np.int32)), contig("ref"), place("pos"), pa.array(fixed["mapq"].astype(np.int32)), _list(cigar, wide["n_ops"]),
        contig("mate"), place("mate_pos"), pa.array(fixed["tlen"]), _texts(letters, wide["n_seq"]), _list(pa.array(raw[_spread(qual_at, n_qual)].astype(np.int32)), n_qual), tag_map,
    ]


_NAMES = [x.split(" ")[0] for x in "part int, at long, place long, qname x, flag x, chrom x, pos0 x, mapq x, cigar x, mate_chrom x, mate_pos0 x, tlen x, seq x, qual x, tags x".split(", ")]


@dataclass
class _Part(InputPartition):
    """Bytes [start, end) of a file, or with ``chunk`` its virtual offsets."""

    part: int
    file: int
    path: str
    start: int
    end: int
    size: int
    chunk: bool = False


def part_runs(part: _Part) -> tuple[list[str], Records, Iterator[tuple[bytes, np.ndarray, np.ndarray]]]:
    """Contigs, and the runs of records of a part, with the bytes that they are walked in."""
    where, inner = open_place(part.path)
    raw = where.open_input_file(inner)
    head = Records(raw, 0)
    _, contigs, at = header(head)
    names = [c for c, _ in contigs]
    if part.chunk:
        found = Records(raw, part.start >> 16)
        return names, found, record_runs(found, part.start & 0xFFFF, part.end, 1 << 16) if part.start < part.end else iter(())
    if not part.start:
        return names, head, record_runs(head, at, part.end << 16)
    block = first_block(raw, part.start, part.end, part.size)
    if block is None:
        return names, head, iter(())
    found = Records(raw, block)
    at = first_record(found, len(names), part.end)
    return names, found, iter(()) if at is None else record_runs(found, at, part.end << 16)


class BamSource(DataSource):
    """``spark.read.format("bgzf_alignments").option("path", ...)``; paths may be joined by commas.

    split: bytes of a part.  counts: a row for each part (its records, where the first begins and where the last ends) in place
    of the records.  For writing see bam_writer.
    """

    @classmethod
    def name(cls) -> str:
        return "bgzf_alignments"

    def schema(self) -> str:
        return _COUNTS if self.options.get("counts") == "true" else _PLACED

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        from strandwise.sources.bam_writer import BamWriter

        return BamWriter(self.options, overwrite)


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.split, self.counts = options["path"].split(","), int(options.get("split", SPLIT)), options.get("counts") == "true"

    def partitions(self) -> list[InputPartition]:
        out = []
        for k, path in enumerate(self.paths):
            where, inner = open_place(path)
            size = where.get_file_info(inner).size
            if size is None:
                raise FileNotFoundError(path)
            out += [_Part(0, k, path, at, min(at + self.split, size), size) for at in range(0, max(size, 1), self.split)]
        for i, p in enumerate(out):
            p.part = i
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names, found, runs = part_runs(partition)
        at, first = 0, None
        for data, starts, places in runs:
            n = len(places)
            if self.counts:
                first = int(places[0]) if first is None else first
            else:
                numbers = [pa.array(np.full(n, partition.part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(places)]
                yield pa.RecordBatch.from_arrays([*numbers, *columns(data, starts, names)], _NAMES)
            at += n
        if self.counts:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            row = [partition.part, partition.file, at, first, found.after if at else None]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "file", "n", "first", "after"])


def read_bam(spark: SparkSession, paths: str, split: int = SPLIT) -> DataFrame:
    """Reads of BAM files (paths joined by commas); rid is a record's number over all of them, in order of the list."""
    spark.dataSource.register(BamSource)
    source = lambda **more: spark.read.format("bgzf_alignments").options(path=paths, split=split, **more).load()
    n_parts = len(BamReader({"path": paths, "split": split}).partitions())
    if n_parts == 1:
        return source().select(F.col("at").alias("rid"), *_NAMES[3:])
    counts = source(counts="true").where("n > 0")
    line = W.orderBy("part")  # a row for each part
    due = F.lag("after").over(W.partitionBy("file").orderBy("part"))
    lost = F.when(due != F.col("first"), F.raise_error(F.concat_ws(" ", F.lit("records between parts of a BAM file don't meet at"), due, "first")).cast("long"))
    parts = counts.select("part", F.coalesce(lost, F.sum("n").over(line) - F.col("n")).alias("before"))
    if n_parts <= FEW_PARTS:
        parts = F.broadcast(parts)
    return source().join(parts, "part").select((F.col("before") + F.col("at")).alias("rid"), *_NAMES[3:])


def bam_header(spark: SparkSession, path: str) -> list[str]:
    """The header's lines, as the file has them."""
    where, inner = open_place(path)
    text, contigs, _ = header(Records(where.open_input_file(inner), 0))
    lines = [x for x in text.split("\n") if x]
    listed = {f[3:] for x in lines if x.startswith("@SQ") for f in x.split("\t") if f.startswith("SN:")}
    return [*lines, *(f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs if c not in listed)]


# --- regions, by an index -----------------------------------------------------------------------------------------------


def bins_of(start: int, end: int) -> list[int]:
    """The index tree's bins that [start, end) touches."""
    out, last = [0], max(end - 1, start)
    for level in range(1, 6):
        size, base = 29 - 3 * level, ((1 << 3 * level) - 1) // 7
        out += range(base + (start >> size), base + (last >> size) + 1)
    return out


def index_chunks(data: bytes, ref: int, start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of virtual offsets that hold all records of a contig that touch [start, end), from a .bai index."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    at, wanted, n_refs = 8, set(bins_of(start, min(end, 1 << 29))), struct.unpack_from("<i", data, 4)[0]
    for k in range(n_refs):
        chunks = []
        n_bins, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", data, at)
            if k == ref and number in wanted:
                flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                chunks += zip(flat[::2], flat[1::2])
            at += 8 + 16 * n
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        if k == ref:
            low = struct.unpack_from("<Q", data, at + 8 * min(start >> 14, n - 1))[0] if n else 0
            out: list[tuple[int, int]] = []
            for a, b in sorted(c for c in chunks if c[1] > low):
                a = max(a, low)
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], max(out[-1][1], b))
                else:
                    out.append((a, b))
            return out
        at += 8 * n
    return []


class Range:
    """What pushed filters say of a contig and of a range: [start, end)."""

    def __init__(self) -> None:
        self.chrom, self.start, self.end = None, 0, 1 << 40

    def take(self, filters: Iterable, start: str, end: str) -> None:
        """start, end: the columns between which a row lies (both pos0 for reads, whose ends are not columns)."""
        for f in filters:
            name, value = (f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None), getattr(f, "value", None)
            if name == "chrom" and isinstance(f, EqualTo):
                self.chrom = value
            elif name in (start, end):
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.end = min(self.end, value + (not isinstance(f, LessThan)))
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.start = max(self.start, value)


class IndexedBamSource(BamSource):
    """BamSource that reads only what an index (path with .bai) says may touch the rows that are asked for.

    Filters on chrom and pos0 are pushed down; options region_chrom, region_start and region_end ask for reads that touch a region.
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_alignments"

    def reader(self, schema) -> DataSourceReader:
        return IndexedBamReader(self.options)


class IndexedBamReader(BamReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.range = Range()
        if "region_chrom" in options:
            self.range.chrom, self.range.start, self.range.end = options["region_chrom"], int(options["region_start"]), int(options["region_end"])

    def pushFilters(self, filters: list) -> Iterable:
        self.range.take(filters, "pos0", "pos0")
        return filters  # Spark applies them as well

    def partitions(self) -> list[InputPartition]:
        whole = super().partitions()
        if self.range.chrom is None:
            return whole
        out = []
        for k, path in enumerate(self.paths):
            where, inner = open_place(path)
            if not where.get_file_info(inner + ".bai").is_file:
                out += [p for p in whole if p.file == k]
                continue
            names = [c for c, _ in header(Records(where.open_input_file(inner), 0))[1]]
            if self.range.chrom not in names or self.range.start >= self.range.end:
                continue
            with where.open_input_file(inner + ".bai") as f:
                chunks = index_chunks(f.read(), names.index(self.range.chrom), self.range.start, self.range.end)
            out += [_Part(0, k, path, a, b, 0, True) for a, b in chunks]
        for i, p in enumerate(out):
            p.part = i
        return out or [_Part(0, 0, self.paths[0], 0, 0, 0, True)]


def read_indexed(spark: SparkSession, paths: str) -> DataFrame:
    """Reads of indexed BAM files, for queries of regions: filters on chrom and pos0 choose blocks by the index.

    rid is the record's virtual offset: it orders a file's records but doesn't count them, as that would take the whole file.
    """
    return _indexed(spark, paths)


def read_region(spark: SparkSession, paths: str, chrom: str, start: int, end: int) -> DataFrame:
    """Reads that touch [start, end) of a contig; see read_indexed."""
    rows = _indexed(spark, paths, region_chrom=chrom, region_start=start, region_end=end)
    return rows.where((F.col("chrom") == chrom) & (F.col("pos0") < end) & (F.col("pos0") + F.greatest(reference_span(), F.lit(1)) > start))


def _indexed(spark: SparkSession, paths: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedBamSource)
    return spark.read.format("indexed_alignments").options(path=paths, **options).load().select(F.col("place").alias("rid"), *_NAMES[3:])

