"""BigWig reader: a Python data source whose partitions are runs of the file's data blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandwise.sources.bam import Range

#: Fixed values of the format: signatures of the file, of its contig tree and of its index.
FILE, CONTIGS, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
#: Data blocks of one partition; a block holds a few thousand values.
BLOCKS = 256


def open_file(path: str):
    import pyarrow.fs as fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(inner)


def _at(f, offset: int, form: str) -> tuple:
    f.seek(offset)
    return struct.unpack(form, f.read(struct.calcsize(form)))


def header(f) -> dict:
    magic, _, _, tree, _, index, _, _, _, _, buffer = _at(f, 0, "<IHHQQQHHQQI")
    if magic != FILE:
        raise ValueError("not a BigWig file")
    return {"tree": tree, "index": index, "packed": buffer > 0}


def contigs(f, tree: int) -> dict[int, tuple[str, int]]:
    """{number: (name, length)}"""
    magic, _, key, _, _, _ = _at(f, tree, "<IIIIQQ")
    if magic != CONTIGS:
        raise ValueError("the contig tree is damaged")
    out, stack = {}, [tree + 32]
    while stack:
        at = stack.pop()
        leaf, _, n = _at(f, at, "<BBH")
        for i in range(n):
            if leaf:
                name, number, size = _at(f, at + 4 + i * (key + 8), f"<{key}sII")
                out[number] = (name.rstrip(b"\0").decode(), size)
            else:
                stack.append(_at(f, at + 4 + i * (key + 8), f"<{key}sQ")[1])
    return out


def blocks(f, index: int, low: tuple[int, int] = (0, 0), high: tuple[int, int] = (1 << 32, 0)) -> list[tuple[int, int]]:
    """Offset and size of the data blocks that hold anything between two places, (contig number, base); only the tree's nodes on the way are read."""
    if _at(f, index, "<I")[0] != INDEX:
        raise ValueError("the index is damaged")
    out, stack = [], [index + 48]
    while stack:
        at = stack.pop()
        leaf, _, n = _at(f, at, "<BBH")
        size, form = (32, "<IIIIQQ") if leaf else (24, "<IIIIQ")
        f.seek(at + 4)
        data = f.read(n * size)
        for first, start, last, end, *place in (struct.unpack_from(form, data, i * size) for i in range(n)):
            if (first, start) < high and (last, end) > low:
                if leaf:
                    out.append(tuple(place))
                else:
                    stack.append(place[0])
    return sorted(out)


def values(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Contig number, and starts, ends and values of a data block."""
    number, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", data)
    if kind == 1:
        rows = np.frombuffer(data, np.dtype([("a", "<u4"), ("b", "<u4"), ("v", "<f4")]), n, 24)
        return number, rows["a"].astype(np.int64), rows["b"].astype(np.int64), rows["v"]
    if kind == 2:
        rows = np.frombuffer(data, np.dtype([("a", "<u4"), ("v", "<f4")]), n, 24)
        return number, rows["a"].astype(np.int64), rows["a"].astype(np.int64) + span, rows["v"]
    if kind == 3:
        starts = start + step * np.arange(n, dtype=np.int64)
        return number, starts, starts + span, np.frombuffer(data, "<f4", n, 24)
    raise ValueError(f"unknown kind of data block: {kind}")


@dataclass
class _Part(InputPartition):
    path: str
    packed: bool
    names: dict
    blocks: list


class BigWigSource(DataSource):
    """``spark.read.format("bigwig").option("path", ...)``; filters on chrom, start and end choose blocks by the file's index."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, start long, end long, value float"

    def reader(self, schema) -> DataSourceReader:
        return BigWigReader(self.options["path"])


class BigWigReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.range = path, Range()

    def pushFilters(self, filters: list) -> Iterable:
        self.range.take(filters, "start", "end")
        return filters  # Spark applies them as well

    def partitions(self) -> list[InputPartition]:
        with open_file(self.path) as f:
            h = header(f)
            names = {k: v[0] for k, v in contigs(f, h["tree"]).items()}
            found = []
            wanted = [k for k, v in names.items() if self.range.chrom in (None, v)]
            if self.range.chrom is None:
                found = blocks(f, h["index"])
            elif wanted and self.range.start <= self.range.end:
                found = blocks(f, h["index"], (wanted[0], max(self.range.start - 1, 0)), (wanted[0], self.range.end))
        return [_Part(self.path, h["packed"], names, found[i : i + BLOCKS]) for i in range(0, len(found), BLOCKS)] or [_Part(self.path, False, {}, [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            for offset, size in partition.blocks:
                f.seek(offset)
                data = f.read(size)
                number, starts, ends, found = values(zlib.decompress(data) if partition.packed else data)
                chrom = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(found), np.int32)), [partition.names[number]]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([chrom, pa.array(starts), pa.array(ends), pa.array(found.astype(np.float32))], ["chrom", "start", "end", "value"])


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value of a BigWig file; positions without a row are missing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWigSource)
    return spark.read.format("bigwig").option("path", path).load()


def bigwig_contigs(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of a BigWig file."""
    with open_file(path) as f:
        found = contigs(f, header(f)["tree"])
    return spark.createDataFrame([v for _, v in sorted(found.items())], "chrom string, length long")
