"""Writer of BAM: a folder with a file for each partition, or one file that the committer joins, with indexes where reads are in order."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from strandwise.sources.bam import BASES, NUMBERS, OPS, BamSource, open_place

#: Bytes of a block before compression.
BLOCK = 0xFF00
_CODES = {c: i for i, c in enumerate(BASES)}


def bgzf_block(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = made.compress(data) + made.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bin(start: int, end: int) -> int:
    """The smallest bin of the index's tree that holds [start, end)."""
    last = max(end - 1, start)
    for level in range(5, 0, -1):
        size = 29 - 3 * level
        if start >> size == last >> size:
            return ((1 << 3 * level) - 1) // 7 + (start >> size)
    return 0


def _tag(key: str, kind: str, number: int | None, text: str | None) -> bytes:
    head = key.encode()
    if kind == "i":
        form = next((k for k in "cCsSiI" if -(k.islower() << 8 * struct.calcsize(NUMBERS[k]) - 1) <= number < 1 << 8 * struct.calcsize(NUMBERS[k]) - k.islower()), None)
        if form is None:
            raise ValueError(f"tag {key} is beyond 32 bits: {number}")
        return head + form.encode() + struct.pack(NUMBERS[form], number)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(text))
    if kind == "B":
        sub, *values = text.split(",")
        form = NUMBERS.get(sub, "<f")
        read = float if sub == "f" else int
        return head + b"B" + sub.encode() + struct.pack("<i", len(values)) + b"".join(struct.pack(form, read(v)) for v in values)
    return head + kind.encode() + text.encode() + (b"" if kind == "A" else b"\0")


def _span(cigar: list) -> int:
    return sum(c["len"] for c in cigar if c["op"] in "MDN=X")


def record(row, ids: dict[str, int]) -> bytes:
    """The bytes of a row of SAM_SCHEMA; ids: a contig's place in the header.  A missing mapping quality is 255."""
    place = lambda c: -1 if c is None else ids[c]
    pos, mate = (-1 if p is None else p for p in (row["pos0"], row["mate_pos0"]))
    cigar, seq, qual, name = row["cigar"] or [], row["seq"] or "", row["qual"] or [], (row["qname"] or "*").encode() + b"\0"
    codes = [_CODES.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    quality = 255 if row["mapq"] is None else row["mapq"]
    body = struct.pack("<iiBBHHHiiii", place(row["chrom"]), pos, len(name), quality, _bin(pos, pos + max(_span(cigar), 1)) if pos >= 0 else 4680, len(cigar), row["flag"], len(seq), place(row["mate_chrom"]), mate, row["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in cigar)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (bytes(qual) if qual else b"\xff" * len(seq))
    body += b"".join(_tag(k, v["t"], v["i"], v["s"]) for k, v in (row["tags"] or {}).items())
    return struct.pack("<i", len(body)) + body


def header_lines(lines: list[str], contigs: list[tuple[str, int]], by_place: bool) -> list[str]:
    """The lines of a header for these contigs: what an input's header says of them and all else is kept."""
    said = {f[3:]: x for x in lines if x.startswith("@SQ") for f in x.split("\t") if f.startswith("SN:")}
    first = next((x for x in lines if x.startswith("@HD")), "@HD\tVN:1.6")
    if by_place:
        first = "\t".join([f for f in first.split("\t") if not f.startswith(("SO:", "GO:", "SS:"))] + ["SO:coordinate"])
    return [first, *(said.get(c, f"@SQ\tSN:{c}\tLN:{n}") for c, n in contigs), *(x for x in lines if not x.startswith(("@HD", "@SQ")))]


def header_blocks(lines: list[str], contigs: list[tuple[str, int]]) -> bytes:
    text = "".join(f"{x}\n" for x in lines).encode()
    held = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    held += b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)
    return b"".join(bgzf_block(held[i : i + BLOCK]) for i in range(0, len(held), BLOCK))


@dataclass
class Index:
    """What an index says of one part: places count its bytes before compression, until ``placed`` makes virtual offsets of them."""

    chunks: dict[tuple[int, int], list[list[int]]] = field(default_factory=dict)  # by contig and bin
    first: dict[tuple[int, int], int] = field(default_factory=dict)  # by contig and window of 2^14 bases
    low: tuple | None = None
    high: tuple | None = None
    ordered: bool = True

    def add(self, ref: int, pos: int, end: int, at: int, to: int) -> None:
        key = (ref < 0, ref, pos)  # reads without a contig come last
        self.ordered &= self.high is None or self.high <= key
        self.low, self.high = self.low or key, key
        if ref < 0 or pos < 0:
            return
        found = self.chunks.setdefault((ref, _bin(pos, end)), [])
        if found and at - found[-1][1] < BLOCK:
            found[-1][1] = to
        else:
            found.append([at, to])
        for window in range(pos >> 14, (max(end, pos + 1) - 1 >> 14) + 1):
            self.first.setdefault((ref, window), at)

    def placed(self, offsets: list[int]) -> Index:
        """offsets: of each block of BLOCK bytes, and the end."""
        place = lambda p: offsets[p // BLOCK] << 16 | p % BLOCK
        return Index({k: [[place(a), place(b)] for a, b in v] for k, v in self.chunks.items()}, {k: place(p) for k, p in self.first.items()}, self.low, self.high, self.ordered)


def joined_index(parts: list[tuple[Index, int]], n_contigs: int) -> bytes | None:
    """The .bai of parts that stand one after the other, each moved by so many bytes; None if reads are not in order."""
    keys = [k for p, _ in parts if p.low for k in (p.low, p.high)]
    if not all(p.ordered for p, _ in parts) or keys != sorted(keys):
        return None
    chunks: dict[int, dict[int, list]] = {}
    first: dict[int, dict[int, int]] = {}
    for part, base in parts:
        for (ref, number), found in part.chunks.items():
            chunks.setdefault(ref, {}).setdefault(number, []).extend((a + (base << 16), b + (base << 16)) for a, b in found)
        for (ref, window), at in part.first.items():
            first.setdefault(ref, {}).setdefault(window, at + (base << 16))
    out = b"BAI\1" + struct.pack("<i", n_contigs)
    for ref in range(n_contigs):
        bins, windows = chunks.get(ref, {}), first.get(ref, {})
        out += struct.pack("<i", len(bins))
        for number, found in sorted(bins.items()):
            out += struct.pack("<Ii", number, len(found)) + b"".join(struct.pack("<QQ", *c) for c in found)
        line, last = [], 0
        for window in range(max(windows, default=-1) + 1):
            last = windows.get(window, last)
            line.append(last)
        out += struct.pack(f"<i{len(line)}Q", len(line), *line)
    return out


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    size: int
    index: Index


class BamWriter(DataSourceWriter):
    """Options: path, contigs (names and lengths as JSON), header (lines as JSON), single (one file in place of a folder).

    Files carry the write's own name and their task attempt's, so writes that append don't touch one another; files of attempts
    that do not count are removed, and those of other writes only when they are overwritten.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.contigs, self.lines = options["path"].rstrip("/"), json.loads(options["contigs"]), json.loads(options.get("header", "[]"))
        self.single, self.overwrite, self.job = options.get("single") == "true", overwrite, uuid.uuid4().hex
        self.folder = f"{self.path}.parts-{self.job}" if self.single else self.path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        where, folder = open_place(self.folder)
        where.create_dir(folder, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"{folder}/part-{number:05d}-{self.job}-{uuid.uuid4().hex}.bam"
        ids = {c: i for i, (c, _) in enumerate(self.contigs)}
        head = b"" if self.single else header_blocks(self.lines, self.contigs)
        held, at, index, offsets = bytearray(), 0, Index(), [0]
        with where.open_output_stream(name, compression=None) as out:

            def put(data: bytes) -> None:
                block = bgzf_block(data)
                out.write(block)
                offsets.append(offsets[-1] + len(block))

            out.write(head)
            for row in iterator:
                made = record(row, ids)
                pos = -1 if row["pos0"] is None else row["pos0"]
                index.add(-1 if row["chrom"] is None else ids[row["chrom"]], pos, pos + max(_span(row["cigar"] or []), 1), at, at + len(made))
                held += made
                at += len(made)
                while len(held) >= BLOCK:
                    put(bytes(held[:BLOCK]))
                    del held[:BLOCK]
            if held:
                put(bytes(held))
            if not self.single:
                out.write(bgzf_block(b""))
        index = index.placed(offsets)
        if not self.single and (data := joined_index([(index, len(head))], len(self.contigs))):
            with where.open_output_stream(name + ".bai", compression=None) as out:
                out.write(data)
        return _Part(number, name, offsets[-1], index)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        if self.single:
            self._join(parts)
            return
        kept = {m.name for m in parts}
        self._remove(lambda f: f.removesuffix(".bai") not in kept and (self.overwrite or self.job in f))

    def _join(self, parts: list[_Part]) -> None:
        """One file of the header, the parts' bytes and the empty block; bytes are copied a piece at a time."""
        where, inner = open_place(self.path)
        head = header_blocks(self.lines, self.contigs)
        base, bases = len(head), []
        with where.open_output_stream(inner, compression=None) as out:
            out.write(head)
            for part in parts:
                with where.open_input_stream(part.name, compression=None) as raw:
                    while piece := raw.read(1 << 22):
                        out.write(piece)
                bases.append((part.index, base))
                base += part.size
            out.write(bgzf_block(b""))
        if data := joined_index(bases, len(self.contigs)):
            with where.open_output_stream(inner + ".bai", compression=None) as out:
                out.write(data)
        where.delete_dir(open_place(self.folder)[1])

    def abort(self, messages: list) -> None:
        if self.single:
            where, folder = open_place(self.folder)
            where.delete_dir_contents(folder, missing_dir_ok=True)
        else:
            self._remove(lambda f: self.job in f)

    def _remove(self, which) -> None:
        import pyarrow.fs as fs

        where, folder = open_place(self.folder)
        for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith("part-") and which(f"{folder}/{f.base_name}"):
                where.delete_file(f.path)


def write_bam(reads: DataFrame, path: str, contigs: DataFrame, header: list[str] | None = None, single: bool = False, by_place: bool = False, mode: str = "error") -> None:
    """Reads as BAM in order of rid or, by_place, of contig and position, in ranges of that order.

    contigs: ref_id, chrom, length (a header is small).  header: an input's lines (bam_header), kept but for contigs that are not
    listed.  single: one file at ``path`` and its index if reads are in order, joined by the committer; for subsets that other
    tools read.  Else a folder of files that are whole each, to which ``mode`` append adds and whose files overwrite replaces.
    """
    import pyarrow.fs as fs

    where, inner = open_place(path)
    if mode == "error" and where.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    listed = [(r["chrom"], r["length"]) for r in contigs.orderBy("ref_id").collect()]
    keys = ["rid"]
    if by_place and listed:
        place = F.create_map(*[F.lit(x) for i, (c, _) in enumerate(listed) for x in (c, i)])
        keys = [F.coalesce(place[F.col("chrom")], F.lit(len(listed))), F.col("pos0"), F.col("rid")]
    reads.sparkSession.dataSource.register(BamSource)
    options = {"contigs": json.dumps(listed), "header": json.dumps(header_lines(header or [], listed, by_place)), "single": str(single).lower()}
    reads = reads.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the source's own columns part, at and place have no meaning in a file
    rows = reads.selectExpr("cast(0 as int) as part", "cast(0 as long) as at", "rid as place", *[c for c in reads.columns if c != "rid"])
    rows.write.format("bgzf_alignments").mode("overwrite" if mode == "overwrite" else "append").options(**options).save(path)
