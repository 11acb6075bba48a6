"""CRAM 3.0 as a Python data source: a partition is a run of containers, whose headers alone are walked to find them.

Bases come from the reference that slices embed, or are written out in them; a slice that needs an outside reference stops the run.
A container's header counts the records before it, so rid is a record's number in any partition.  Blocks may be raw, gzip, bzip2, lzma
or rANS (four states, orders 0 and 1).
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandwise.sources import rans
from strandwise.sources.bam import SAM_SCHEMA, open_place, tag_values

#: Bytes of containers that a partition has, about.
SPLIT = 1 << 26
#: Records of an Arrow batch.
BATCH = 1 << 12
_KINDS = [
    pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()),
    pa.map_(pa.string(), pa.struct([("t", pa.string()), ("i", pa.int64()), ("s", pa.string())])),
]
_NAMES = ["rid", "qname", "flag", "chrom", "pos0", "mapq", "cigar", "mate_chrom", "mate_pos0", "tlen", "seq", "qual", "tags"]


class Source:
    """Bytes that are read one after the other, and numbers of variable length."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("a CRAM block is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def until(self, stop: int) -> bytes:
        end = self.data.index(stop, self.at)
        out = self.data[self.at : end]
        self.at = end + 1
        return out

    def itf8(self) -> int:
        """A 32-bit number: leading ones of the first byte tell how many bytes follow."""
        first = self.byte()
        more = min(4, next(i for i in range(9) if not first << i & 0x80))
        value = first & (0xFF >> more + 1) if more < 4 else first & 0x0F
        for i, b in enumerate(self.take(more)):
            value = value << 4 | b & 0x0F if i == 3 else value << 8 | b
        return value - (1 << 32) if value >> 31 else value

    def ltf8(self) -> int:
        first = self.byte()
        more = next(i for i in range(9) if not first << i & 0x80)
        value = first & (0xFF >> more + 1) if more < 7 else 0
        for b in self.take(more):
            value = value << 8 | b
        return value - (1 << 64) if value >> 63 else value

    def itf8s(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


class Bits:
    """The core block, bit by bit from each byte's highest."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> 7 - (self.at & 7) & 1
            self.at += 1
        return value


@dataclass
class Block:
    kind: int
    number: int
    data: bytes


#: Kinds of blocks.
FILE_HEADER, COMPRESSION_HEADER, SLICE_HEADER, EXTERNAL, CORE = 0, 1, 2, 4, 5


def block(src: Source) -> Block:
    method, kind = src.byte(), src.byte()
    number, packed, size = src.itf8(), src.itf8(), src.itf8()
    data = src.take(packed)
    src.take(4)  # a checksum
    if method == 1:
        data = zlib.decompress(data, 31)
    elif method == 2:
        data = bz2.decompress(data)
    elif method == 3:
        data = lzma.decompress(data)
    elif method == 4:
        data = rans.decode(data)
    elif method:
        raise ValueError(f"blocks of method {method} are not read")
    if len(data) != size:
        raise ValueError("a CRAM block has not the size that it says")
    return Block(kind, number, data)


@dataclass
class Container:
    """at: where its blocks begin."""

    at: int
    size: int
    ref: int
    n_records: int
    counter: int
    n_blocks: int
    landmarks: list[int]


def container(raw, at: int, size: int) -> Container | None:
    """The header at an offset of a file of ``size`` bytes; None at its end."""
    if at >= size:
        return None
    raw.seek(at)
    data = raw.read(min(1 << 16, size - at))
    src = Source(data)
    length = struct.unpack("<i", src.take(4))[0]
    ref, _, _, n_records, counter, _, n_blocks = src.itf8(), src.itf8(), src.itf8(), src.itf8(), src.ltf8(), src.ltf8(), src.itf8()
    landmarks = src.itf8s()
    src.take(4)
    return Container(at + src.at, length, ref, n_records, counter, n_blocks, landmarks)


def containers(raw, size: int) -> tuple[str, list[Container]]:
    """Text of the SAM header, and the data containers of a file."""
    raw.seek(0)
    magic = raw.read(26)
    if magic[:4] != b"CRAM":
        raise ValueError("not a CRAM file")
    if magic[4] != 3:
        raise ValueError(f"CRAM version {magic[4]} is not read")
    first = container(raw, 26, size)
    raw.seek(first.at)
    held = block(Source(raw.read(first.size))).data
    text = held[4 : 4 + struct.unpack_from("<i", held)[0]].rstrip(b"\0").decode("utf-8", "replace")
    out, at = [], first.at + first.size
    while (found := container(raw, at, size)) is not None:
        if found.n_records:
            out.append(found)
        at = found.at + found.size
    return text, out


def encoding(src: Source):
    """A codec and its parameters."""
    kind = src.itf8()
    own = Source(src.take(src.itf8()))
    if kind == 1:
        return ("external", own.itf8())
    if kind == 3:
        symbols, lengths = own.itf8s(), own.itf8s()
        codes, code, last = {}, 0, 0
        for length, symbol in sorted(zip(lengths, symbols)):  # canonical: by length, then by symbol
            code <<= length - last
            codes[length, code] = symbol
            code, last = code + 1, length
        return ("huffman", codes, sorted({n for n, _ in codes}))
    if kind == 4:
        return ("lengths", encoding(own), encoding(own))
    if kind == 5:
        stop = own.byte()
        return ("stop", stop, own.itf8())
    if kind == 6:
        offset = own.itf8()
        return ("beta", offset, own.itf8())
    if kind == 7:
        offset = own.itf8()
        return ("subexp", offset, own.itf8())
    if kind == 9:
        return ("gamma", own.itf8())
    if kind == 0:
        return ("none",)
    raise ValueError(f"encoding {kind} is not read")


@dataclass
class Rules:
    """A container's compression header."""

    names: bool = True
    delta: bool = True
    needs_reference: bool = True
    substitutions: dict[tuple[str, int], str] = field(default_factory=dict)
    tag_lines: list[list[bytes]] = field(default_factory=list)
    series: dict[str, tuple] = field(default_factory=dict)
    tags: dict[int, tuple] = field(default_factory=dict)


def rules(data: bytes) -> Rules:
    src, out = Source(data), Rules()
    own = Source(src.take(src.itf8()))
    for _ in range(own.itf8()):
        key = own.take(2)
        if key == b"RN":
            out.names = bool(own.byte())
        elif key == b"AP":
            out.delta = bool(own.byte())
        elif key == b"RR":
            out.needs_reference = bool(own.byte())
        elif key == b"SM":
            for base, codes in zip("ACGTN", own.take(5)):
                for i, other in enumerate(b for b in "ACGTN" if b != base):
                    out.substitutions[base, codes >> 6 - 2 * i & 3] = other
        elif key == b"TD":
            lines = own.take(own.itf8()).split(b"\0")
            out.tag_lines = [[line[i : i + 3] for i in range(0, len(line), 3)] for line in lines[:-1]]
        else:
            raise ValueError(f"unknown rule {key}")
    own = Source(src.take(src.itf8()))
    for _ in range(own.itf8()):
        key = own.take(2).decode()
        out.series[key] = encoding(own)
    own = Source(src.take(src.itf8()))
    for _ in range(own.itf8()):
        key = own.itf8()
        out.tags[key] = encoding(own)
    return out


class Values:
    """Values of a slice's data series."""

    def __init__(self, core: bytes, outer: dict[int, bytes]) -> None:
        self.bits, self.outer = Bits(core), {k: Source(v) for k, v in outer.items()}

    def number(self, code: tuple) -> int:
        kind = code[0]
        if kind == "external":
            return self.outer[code[1]].itf8()
        if kind == "huffman":
            value, n = 0, 0
            for length in code[2]:
                value = value << length - n | self.bits.take(length - n)
                n = length
                if (n, value) in code[1]:
                    return code[1][n, value]
            raise ValueError("a code is unknown")
        if kind == "beta":
            return self.bits.take(code[2]) - code[1]
        if kind == "gamma":
            n = 0
            while not self.bits.take(1):
                n += 1
            return (1 << n | self.bits.take(n)) - code[1]
        if kind == "subexp":
            n = 0
            while self.bits.take(1):
                n += 1
            return (self.bits.take(code[2]) if not n else 1 << code[2] + n - 1 | self.bits.take(code[2] + n - 1)) - code[1]
        raise ValueError(f"no numbers of {kind}")

    def byte(self, code: tuple) -> int:
        return self.outer[code[1]].byte() if code[0] == "external" else self.number(code) & 0xFF

    def bytes(self, code: tuple, n: int) -> bytes:
        """n single values."""
        return self.outer[code[1]].take(n) if code[0] == "external" else bytes(self.byte(code) for _ in range(n))

    def text(self, code: tuple) -> bytes:
        if code[0] == "stop":
            return self.outer[code[2]].until(code[1])
        if code[0] == "lengths":
            return self.bytes(code[2], self.number(code[1]))
        raise ValueError(f"no texts of {code[0]}")


class Slice:
    """Records of a slice as dicts; mates that it holds both are tied afterwards."""

    def __init__(self, made: Rules, src: Source, groups: list[str]) -> None:
        self.rules, self.groups = made, groups
        head = Source(block(src).data)
        self.ref, self.start, self.span, self.n = head.itf8(), head.itf8(), head.itf8(), head.itf8()
        self.counter, n_blocks, _, embedded = head.ltf8(), head.itf8(), head.itf8s(), head.itf8()
        found = [block(src) for _ in range(n_blocks)]
        outer = {b.number: b.data for b in found if b.kind == EXTERNAL}
        self.bases = outer.get(embedded).decode().upper() if embedded >= 0 else None
        self.values = Values(next((b.data for b in found if b.kind == CORE), b""), outer)
        self.last = self.start

    def number(self, key: str) -> int:
        return self.values.number(self.rules.series[key])

    def text(self, key: str) -> bytes:
        return self.values.text(self.rules.series[key])

    def reference(self, pos: int, n: int) -> str:
        """n bases from a 1-based position."""
        if self.bases is not None and self.start <= pos and pos + n <= self.start + len(self.bases):
            return self.bases[pos - self.start : pos - self.start + n]
        if self.rules.needs_reference and n:
            raise ValueError("this CRAM file needs an outside reference, which is not read")
        return "N" * n

    def records(self) -> list[dict]:
        out = [self.record(i) for i in range(self.n)]
        for i, r in enumerate(out):
            if r["next"] is not None and not r["tied"]:
                self.tie(out, i)
        return out

    def record(self, i: int) -> dict:
        number = self.number
        flag, own = number("BF"), number("CF")
        ref = number("RI") if self.ref == -2 else self.ref
        length, pos, group = number("RL"), number("AP"), number("RG")
        if self.rules.delta:
            pos += self.last
            self.last = pos
        name = self.text("RN").decode() if self.rules.names else None
        r = {"flag": flag, "ref": ref, "pos": pos, "mate": -1, "mate_pos": 0, "tlen": 0, "next": None, "tied": False, "number": self.counter + i}
        if own & 2:
            more = number("MF")
            if not self.rules.names:
                name = self.text("RN").decode()
            r |= {"mate": number("NS"), "mate_pos": number("NP"), "tlen": number("TS"), "flag": flag | (0x20 if more & 1 else 0) | (0x8 if more & 2 else 0)}
        elif own & 4:
            r["next"] = i + number("NF") + 1
        r["name"] = str(r["number"] + 1) if name is None else name
        tags = b""
        for tag in self.rules.tag_lines[number("TL")]:
            tags += tag + self.values.text(self.rules.tags[tag[0] << 16 | tag[1] << 8 | tag[2]])
        r["tags"] = {k: {"t": t, "i": n, "s": s} for k, t, n, s in tag_values(tags)}
        if group >= 0:
            r["tags"]["RG"] = {"t": "Z", "i": None, "s": self.groups[group]}
        given: dict[int, int] = {}  # qualities of single bases
        if flag & 4:
            seq, ops, quality = "" if own & 8 else self.values.bytes(self.rules.series["BA"], length).decode(), [], 0
        else:
            seq, ops, given = self.aligned(pos, length)
            quality = number("MQ")
            seq = "" if own & 8 else seq
        if own & 1:
            qual = list(self.values.bytes(self.rules.series["QS"], length))
        else:
            qual = [given.get(k, 255) for k in range(length)] if given else []
        r |= {"seq": seq, "ops": ops, "mapq": quality, "qual": [] if qual and all(q == 255 for q in qual) else qual}
        r["end"] = pos + sum(n for op, n in ops if op in "MDN=X") - 1
        return r

    def aligned(self, pos: int, length: int) -> tuple[str, list[tuple[str, int]], dict[int, int]]:
        """Bases and operations of a read from its differences, and qualities that they give."""
        series, values = self.rules.series, self.values
        parts, ops, given, at, ref = [], [], {}, 1, pos  # at: the read's next base, from 1

        def add(op: str, n: int) -> None:
            if not n:
                return
            if ops and ops[-1][0] == op:
                ops[-1] = (op, ops[-1][1] + n)
            else:
                ops.append((op, n))

        def match(n: int) -> None:
            nonlocal at, ref
            parts.append(self.reference(ref, n))
            add("M", n)
            at, ref = at + n, ref + n

        place = 0
        for _ in range(self.number("FN")):
            kind = chr(values.byte(series["FC"]))
            place += self.number("FP")
            if kind not in "Qq":
                match(place - at)
            if kind == "X":
                base = self.reference(ref, 1)
                parts.append(self.rules.substitutions[base if base in "ACGT" else "N", values.byte(series["BS"])])
                add("M", 1)
                at, ref = at + 1, ref + 1
            elif kind in "Bb":
                some = bytes([values.byte(series["BA"])]) if kind == "B" else self.text("BB")
                if kind == "B":
                    given[at - 1] = values.byte(series["QS"])
                parts.append(some.decode())
                add("M", len(some))
                at, ref = at + len(some), ref + len(some)
            elif kind in "ISi":
                some = bytes([values.byte(series["BA"])]) if kind == "i" else self.text({"I": "IN", "S": "SC"}[kind])
                parts.append(some.decode())
                add("S" if kind == "S" else "I", len(some))
                at += len(some)
            elif kind in "DNPH":
                n = self.number({"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[kind])
                add(kind, n)
                ref += n if kind in "DN" else 0
            elif kind == "Q":
                given[place - 1] = values.byte(series["QS"])
            elif kind == "q":
                given |= {place - 1 + k: q for k, q in enumerate(self.text("QQ"))}
            else:
                raise ValueError(f"unknown difference {kind}")
        match(length - at + 1)
        return "".join(parts), ops, given

    def tie(self, rows: list[dict], i: int) -> None:
        """Mates of a template point to one another in turn; its length goes from the first base to the last."""
        chain = [i]
        while rows[chain[-1]]["next"] is not None:
            chain.append(rows[chain[-1]]["next"])
        each = [rows[k] for k in chain]
        for r, mate in zip(each, [*each[1:], each[0]]):
            r |= {"tied": True, "mate": mate["ref"], "mate_pos": mate["pos"], "name": each[0]["name"]}
            r["flag"] |= (0x20 if mate["flag"] & 0x10 else 0) | (0x8 if mate["flag"] & 0x4 else 0)
        if all(not r["flag"] & 4 and r["ref"] == each[0]["ref"] for r in each):
            low, high = min(r["pos"] for r in each), max(r["end"] for r in each)
            first = next(r for r in each if r["pos"] == low)
            for r in each:
                r["tlen"] = (high - low + 1) * (1 if r is first else -1)


def container_rows(data: bytes, found: Container, contigs: list[str], groups: list[str]) -> Iterator[tuple]:
    """Rows of SAM_SCHEMA of a container's blocks."""
    made = rules(block(Source(data)).data)
    name = lambda k: contigs[k] if k >= 0 else None
    place = lambda p: p - 1 if p > 0 else None
    for mark in found.landmarks:
        for r in Slice(made, Source(data, mark), groups).records():
            yield (
                r["number"], r["name"], r["flag"], name(r["ref"]), place(r["pos"]), r["mapq"], [{"op": op, "len": n} for op, n in r["ops"]],
                name(r["mate"]), place(r["mate_pos"]), r["tlen"], r["seq"], r["qual"], list(r["tags"].items()),
            )


def named(text: str, kind: str, key: str) -> list[str]:
    """A field of all header lines of a kind."""
    return [f[3:] for line in text.split("\n") if line.startswith(kind + "\t") for f in line.split("\t") if f.startswith(key + ":")]


@dataclass
class _Part(InputPartition):
    path: str
    base: int
    contigs: list
    groups: list
    containers: list


class CramSource(DataSource):
    """``spark.read.format("cram_alignments").option("path", ...)``; paths may be joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "cram_alignments"

    def schema(self) -> str:
        return SAM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CramReader(self.options)


class CramReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.split = options["path"].split(","), int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        out, base = [], 0
        for path in self.paths:
            where, inner = open_place(path)
            with where.open_input_file(inner) as raw:
                text, found = containers(raw, raw.size())
            contigs, groups, size = named(text, "@SQ", "SN"), named(text, "@RG", "ID"), self.split
            for c in found:
                if size >= self.split:
                    out.append(_Part(path, base, contigs, groups, []))
                    size = 0
                out[-1].containers.append(c)
                size += c.size
            base += sum(c.n_records for c in found)
        return out or [_Part(self.paths[0], 0, [], [], [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        where, inner = open_place(partition.path)
        with where.open_input_file(inner) as raw:
            for found in partition.containers:
                raw.seek(found.at)
                rows = list(container_rows(raw.read(found.size), found, partition.contigs, partition.groups))
                for i in range(0, len(rows), BATCH):
                    columns = list(zip(*rows[i : i + BATCH]))
                    columns[0] = [n + partition.base for n in columns[0]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def read_cram(spark: SparkSession, paths: str) -> DataFrame:
    """Reads of CRAM files; rid is a record's number over all of them, in order of the list."""
    spark.dataSource.register(CramSource)
    return spark.read.format("cram_alignments").option("path", paths).load()
