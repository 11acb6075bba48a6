"""Reads and models that meet in one window of the genome, where numpy counts for each of them: a pair of the two is never a row of a table.

In deep data a read lies over hundreds of transcripts, so their pairs grow with the product of both tables; rows that are alike are
counted together here, and what is kept of a pair is a bit.  Only overlap_pairs, which is asked for the pairs themselves, makes them rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators.intervals import JOIN_BIN, WIDER, _exploded, fit

#: Levels of windows, each WIDER times as wide as the one below.
LEVELS = 8
#: Reads and blocks that are laid against genes at once.
READS, BLOCKS = 1 << 15, 512

_KEYS = ["chrom", "_level", "_bin"]


def _width(size: int) -> Column:
    return F.element_at(F.array(*[F.lit(size * WIDER**k) for k in range(LEVELS)]), F.col("_level") + 1)


def at_home(rows: DataFrame, homes: DataFrame, alike: tuple[list, list], homes_alike: tuple[list, list], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int = JOIN_BIN) -> DataFrame:
    """What ``run`` makes of each window's rows and homes.

    homes: chrom, r_start, r_end and others; each is in one window, which holds it wholly: two bins of the first level whose bins are no
    shorter than it.  rows: chrom, start, end and others; each is in all windows that it touches.
    alike: the columns by which rows of a window are grouped, and the aggregates that stand for them (rows stay as they are without aggregates).
    """
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(F.col("r_end") - F.col("r_start") <= size * WIDER**k, k).otherwise(level)
    homes = homes.where("chrom is not null and r_start < r_end").withColumn("_level", level)
    seen = F.broadcast(homes.select(F.col("_level").alias("_seen")).distinct())  # LEVELS rows at most
    homes = homes.withColumn("_bin", F.floor(F.col("r_start") / _width(size)))
    rows = rows.where("chrom is not null and start < end").crossJoin(seen).withColumn("_level", F.col("_seen") + 0).drop("_seen")
    rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / _width(size)) - 1, F.floor((F.col("end") - 1) / _width(size)))))

    def grouped(df: DataFrame, columns: list, sums: list) -> DataFrame:
        df = df.repartition(*_KEYS)
        return df.groupBy(*_KEYS, *columns).agg(*sums) if sums else df

    a, b = grouped(rows, *alike), grouped(homes, *homes_alike)
    return a.groupBy(*_KEYS).cogroup(b.groupBy(*_KEYS)).applyInArrow(run, schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of numbers: how many each list has, and all of them."""
    lists = table[name].combine_chunks()
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _covers(s: np.ndarray, e: np.ndarray, first: np.ndarray, last: np.ndarray, gene: np.ndarray, genes: int) -> np.ndarray:
    """Bits of the genes with an exon that covers a block, for each block; blocks are in order of start, exons in order of gene."""
    bits = np.zeros((len(s), (genes + 7) // 8), np.uint8)
    for at in range(0, len(s), BLOCKS):
        a, b = s[at : at + BLOCKS, None], e[at : at + BLOCKS, None]
        near = np.flatnonzero((first <= a[-1]) & (last >= b.min()))
        if not len(near):
            continue
        inside = (first[near] <= a) & (b <= last[near]) & (a < last[near]) & (first[near] < b)
        owner, begins = np.unique(gene[near], return_index=True)
        row = np.zeros((len(a), genes), bool)
        row[:, owner] = np.logical_or.reduceat(inside, begins, axis=1)
        bits[at : at + BLOCKS] = np.packbits(row, axis=1)
    return bits


def sole_genes(genes: pa.Table, reads: pa.Table) -> pa.Table:
    """gene_id, reads: of reads (r_start, places: each block's start and end from there, n) that lie over one gene only, as gene_counts says.

    genes: gene_id, many (genes with these exons), starts and ends of exons.
    """
    n_exons, first = _lists(genes, "starts")
    last = _lists(genes, "ends")[1]
    gene, many = np.repeat(np.arange(len(n_exons)), n_exons), _numbers(genes, "many")
    found = np.zeros(len(n_exons), np.int64)
    reads = reads.sort_by("r_start") if len(n_exons) else reads.slice(0, 0)
    for at in range(0, reads.num_rows, READS):
        part = reads.slice(at, READS)
        n_places, places = _lists(part, "places")
        blocks = n_places // 2
        origin = np.repeat(_numbers(part, "r_start"), blocks)
        s, long = origin + places[0::2], (places[1::2] - places[0::2]).astype(np.int64)
        low, most = s.min(), long.max() + 1
        code, where = np.unique((s - low) * most + long, return_inverse=True)
        bits = _covers(code // most + low, code // most + low + code % most, first, last, gene, len(n_exons))
        bare = ~bits.any(axis=1)
        bits[bare] = 255  # a block without genes says nothing
        begins = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        common = np.bitwise_and.reduceat(bits[where], begins, axis=0)
        some = ~np.logical_and.reduceat(bare[where], begins)
        one = np.flatnonzero(some & (np.bitwise_count(common).sum(axis=1, dtype=np.int64) == 1))
        if len(one):
            np.add.at(found, np.unpackbits(common[one], axis=1).argmax(axis=1), _numbers(part, "n")[one])
    found[many > 1] = 0
    some = np.flatnonzero(found)
    return pa.table({"gene_id": genes["gene_id"].take(pa.array(some)), "reads": pa.array(found[some], pa.int64())})


#: Columns of transcripts; those of one shape are counted together.
ALIKE = ["r_start", "r_end", "starts", "ends"]


def _ids(models: pa.Table) -> pa.ChunkedArray:
    """Lists of names whose items may be null, as Spark's schema has them."""
    return models["tx_ids"].cast(pa.list_(pa.string()))


def _each(models: pa.Table):
    """Number, start, end and exons of each transcript."""
    n, starts = _lists(models, "starts")
    at, ends = np.concatenate([[0], np.cumsum(n)]), _lists(models, "ends")[1]
    for i, (ts, te) in enumerate(zip(_numbers(models, "r_start"), _numbers(models, "r_end"))):
        yield i, ts, te, list(zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]))


def fragments_of(reads: pa.Table, models: pa.Table) -> pa.Table:
    """tx_ids, kinds: how many reads of each of six kinds lie on transcripts.

    reads: start, end, upto (end by the sequence, null for pairs), mate, kind.  A read touches the transcript, and an exon holds its own or its
    mate's start; a single one has bases in an exon.
    """
    parts = []
    for paired in (False, True):
        mine = reads.filter(pc.is_null(reads["upto"]) if paired else pc.is_valid(reads["upto"])).sort_by("start")
        if mine.num_rows:
            p, end = _numbers(mine, "start"), _numbers(mine, "end")
            parts.append((paired, p, end, _numbers(mine, "mate" if paired else "upto"), _numbers(mine, "kind"), (end - p).max()))
    found = np.zeros((models.num_rows, 6), np.int64)
    for i, ts, te, exons in _each(models) if parts else ():
        for paired, starts, ends, others, kinds, longest in parts:
            a, b = np.searchsorted(starts, (ts - longest, te))
            p, other, hit = starts[a:b], others[a:b], np.zeros(b - a, bool)
            for s, e in exons:
                if paired:
                    low, high = np.searchsorted(p, (s, e))
                    hit[low:high] = True
                    hit |= (other >= s) & (other < e)
                else:
                    high = np.searchsorted(p, e)
                    hit[:high] |= other[:high] > s
            hit &= ends[a:b] > ts
            found[i] += np.bincount(kinds[a:b][hit], minlength=6)
    return pa.table({"tx_ids": _ids(models), "kinds": pa.array(list(found), pa.list_(pa.int64()))})


def sizes_of(reads: pa.Table, models: pa.Table) -> pa.Table:
    """tx_ids, fragments, mean, median, std of the sizes of fragments inside transcripts, as fragment_size says.

    reads: start (the first of both mates' starts), hi (the last), at (the read's own), n.
    """
    reads = reads.sort_by("start")
    los, his, ats, ns = (_numbers(reads, c) for c in ("start", "hi", "at", "n"))
    out = np.zeros((models.num_rows, 4))
    for i, ts, te, exons in _each(models):
        a, b = np.searchsorted(los, (ts, te))
        kept = np.flatnonzero((his[a:b] <= te) & (ats[a:b] < te)) + a
        if not len(kept):
            continue
        lo, hi, size = los[kept], his[kept], ns[kept].copy()
        for s, e in exons:  # bases s + 1 to e + 1 above lo and up to hi
            size += np.clip(hi - s, 0, e - s + 1) - np.clip(lo - s, 0, e - s + 1)
        middle = np.partition(size, ((len(size) - 1) // 2, len(size) // 2))
        out[i] = len(size), size.mean(), (middle[(len(size) - 1) // 2] + middle[len(size) // 2]) / 2, size.std()
    n, mean, median, std = out.T
    return pa.table({"tx_ids": _ids(models), "fragments": pa.array(n.astype(np.int64)), "mean": mean, "median": median, "std": std}).filter(pa.array(n > 0))


#: Rows in bins and pairs that one task of overlap_pairs has, about: so few that its file lists each key once, in a dictionary, and pairs by numbers.
TASK_ROWS, TASK_PAIRS = 1 << 17, 1 << 26
#: Right and left rows of a bin that are laid against each other at once, and pairs that are worth a batch of their own.
TILE, STRIP, FULL = 128, 1 << 10, 1 << 16


def overlap_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """a and b of all pairs with left.start < right.end and right.start < left.end on one contig.

    left: chrom, start, end and a; right: chrom, r_start, r_end and b.  Both sides are sent to the bins they touch, as in overlap_join, and are
    laid against each other in tiles, both in order of start.  The pairs can't be fewer, but so laid out they are runs of one a whose
    lists of b repeat, and a columnar file holds a pair in a fraction of a byte.  A task holds one bin's right rows and a batch of left ones.
    """
    size, rows, pairs = fit(left, right)
    parts = max(left.sparkSession.sparkContext.defaultParallelism, round(rows / TASK_ROWS), round(pairs / TASK_PAIRS))

    def side(df: DataFrame, start: str, end: str, is_left: bool) -> DataFrame:
        df = df.select("chrom", F.col(start).alias("start"), F.col(end).alias("end"), a if is_left else b).where("chrom is not null and start is not null and end is not null")
        at_start = F.col("_bin") == F.floor(F.col("start") / size)
        return _exploded(df, F.col("start"), F.col("end"), size).withColumns({"_left": F.lit(is_left), "_here": at_start})

    both = side(left, "start", "end", True).unionByName(side(right, "r_start", "r_end", False), allowMissingColumns=True)
    dealt = both.repartition(parts, "chrom", "_bin").sortWithinPartitions("chrom", "_bin", "_left", "start", "end")
    met = dealt.mapInArrow(partial(_pairs, a=a, b=b), both.select(a, F.array(b).alias(b)).schema)
    return met.select(a, F.explode(b).alias(b))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """Whether a new bin begins, whether these are left rows, and rows of one side of one bin, as far as a batch holds them."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        chrom = batch["chrom"].dictionary_encode()
        codes, bins, lefts = chrom.indices.to_numpy(), batch["_bin"].to_numpy(), batch["_left"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (bins[1:] != bins[:-1]) | (lefts[1:] != lefts[:-1])) + 1
        for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = chrom.dictionary[codes[at]].as_py(), bins[at]
            yield key != last, bool(lefts[at]), batch.slice(at, to - at)
            last = key


def _pairs(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """a and a list of b that overlap it, of rows in order of chrom, _bin, _left (right rows come first) and start.

    A pair is kept in the bin of its later start, which is the one where _here holds for either row.
    """
    columns = lambda rows: [rows[c].to_numpy(zero_copy_only=False) for c in ("start", "end", "_here")]
    held, tiles, found, n = [], None, [], 0
    for new, is_left, rows in _runs(batches):
        if new:
            held, tiles = [], None
        if not is_left:
            held.append(rows)
            continue
        if tiles is None:
            table = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
            tiles = [(t[b], *columns(t)) for r in table for t in (r.slice(at, TILE) for at in range(0, r.num_rows, TILE))]
        for strip in (rows.slice(at, STRIP) for at in range(0, rows.num_rows if tiles else 0, STRIP)):
            start, end, here = columns(strip)
            first, last = start[0], end.max()
            for names, r_start, r_end, r_here in tiles:
                if r_start[0] >= last or r_end.max() <= first:
                    continue
                met = (start[:, None] < r_end) & (r_start < end[:, None]) & (here[:, None] | r_here)
                of_right = np.broadcast_to(np.arange(len(r_start), dtype=np.int32), met.shape)[met]
                if len(of_right):
                    each = np.count_nonzero(met, axis=1)
                    some = np.flatnonzero(each)
                    ends = np.concatenate([[0], np.cumsum(each[some])])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(of_right)))
                    found.append(pa.RecordBatch.from_arrays([strip[a].take(pa.array(some)), lists], [a, b]))
                    n += len(of_right)
                if n >= FULL:
                    yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                    found, n = [], 0
    if found:
        yield from pa.Table.from_batches(found).combine_chunks().to_batches()
