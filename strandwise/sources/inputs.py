"""Lists of alignment files: a folder (searched wholly), a text file of paths, or paths joined by commas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.sources.alignments import read_alignments


def alignment_files(spark: SparkSession, text: str, index: bool = True) -> list[str]:
    """Paths of BAM files; with ``index`` only those beside which an index file stands."""
    import pyarrow.fs as fs

    def info(path: str):
        where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return where, inner, where.get_file_info(inner)

    where, inner, found = info(text)
    if found.type == fs.FileType.Directory:
        listed = sorted(f.path for f in where.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.endswith(".bam"))
    elif found.type == fs.FileType.File and not text.endswith(".bam"):
        listed = [r["value"].strip() for r in spark.read.text(text).collect() if r["value"].strip() and not r["value"].startswith("#")]  # a list of files
    else:
        listed = [p.strip() for p in text.split(",") if p.strip()]
    present = [p for p in listed if info(p)[2].type == fs.FileType.File and (not index or info(p + ".bai")[2].type == fs.FileType.File)]
    if not present:
        raise FileNotFoundError(f"no alignment files: {text}")
    return present


def sample_name(path: str) -> str:
    """The file's name without folder and ending, with signs that plots dislike replaced; a leading digit gets a letter."""
    name = re.sub(r"\.bam$", "", path.rsplit("/", 1)[-1])
    name = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"V{name}" if name[:1].isdigit() else name


def read_samples(spark: SparkSession, text: str, index: bool = True) -> DataFrame:
    """Reads of all files with a column sample."""
    out = None
    for path in alignment_files(spark, text, index):
        part = read_alignments(spark, path).withColumn("sample", F.lit(sample_name(path)))
        out = part if out is None else out.unionByName(part)
    return out
