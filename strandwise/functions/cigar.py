"""CIGAR kernels: Catalyst expressions over ``cigar array<struct<op:string,len:int>>``.

The exon kernel moves on M, D, N and S, the intron kernel on M and D only; the two differ on purpose, as the
reports do that are built on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "array<struct<start:bigint,end:bigint>>"


def parse_cigar(text: Column) -> Column:
    """``10M5D`` to an array of (op, len); null and ``*`` have no operations."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.left(p, F.length(p) - 1).cast("int").alias("len")))


def length_of(ops: str, cigar: str = "cigar") -> Column:
    """Sum of the lengths of the operations in ``ops``."""
    listed = ",".join(f"'{o}'" for o in ops)
    return F.expr(f"aggregate({cigar}, 0L, (a, c) -> a + if(c.op in ({listed}), c.len, 0))")


def reference_span(cigar: str = "cigar") -> Column:
    return length_of("MDN=X", cigar)


def aligned_length(cigar: str = "cigar") -> Column:
    """Query bases that are aligned: M, I, =, X."""
    return length_of("MI=X", cigar)


def _walk(emit: str, moves: str, start: str, cigar: str) -> Column:
    listed = ",".join(f"'{o}'" for o in moves)
    return F.expr(
        f"aggregate({cigar}, named_struct('p', cast({start} as bigint), 'out', cast(array() as {RANGE})),"
        f" (a, c) -> named_struct('p', a.p + if(c.op in ({listed}), c.len, 0),"
        f" 'out', if(c.op = '{emit}', array_append(a.out, named_struct('start', a.p, 'end', a.p + c.len)), a.out)), a -> a.out)"
    )


def exon_blocks(start: str = "pos0", cigar: str = "cigar") -> Column:
    """Reference ranges of M operations."""
    return _walk("M", "MDNS", start, cigar)


def intron_blocks(start: str = "pos0", cigar: str = "cigar") -> Column:
    """Reference ranges of N operations; a soft clip does not move them."""
    return F.expr(
        f"aggregate({cigar}, named_struct('p', cast({start} as bigint), 'out', cast(array() as {RANGE})),"
        f" (a, c) -> named_struct('p', a.p + if(c.op in ('M','D','N'), c.len, 0),"
        f" 'out', if(c.op = 'N', array_append(a.out, named_struct('start', a.p, 'end', a.p + c.len)), a.out)), a -> a.out)"
    )


def read_ranges(op: str, cigar: str = "cigar") -> Column:
    """Ranges of read positions that ``op`` (M, I, S, = or X) covers."""
    return _walk(op, "MIS=X", "0", cigar)


def expanded_length(cigar: str = "cigar") -> Column:
    """Read bases that the operations cover."""
    return length_of("MIS=X", cigar)


def deletion_starts(cigar: str = "cigar") -> Column:
    """(start, end) with start the read position of a deletion and end - start its size; M, S and I move."""
    return _walk("D", "MSI", "0", cigar)


def clip_lengths(cigar: str = "cigar") -> tuple[Column, Column]:
    """Soft-clipped bases at either end, behind hard clips."""
    bare = f"filter({cigar}, c -> c.op <> 'H')"
    lead = F.expr(f"if(size({bare}) > 0 and {bare}[0].op = 'S', {bare}[0].len, 0)")
    tail = F.expr(f"if(size({bare}) > 1 and {bare}[size({bare}) - 1].op = 'S', {bare}[size({bare}) - 1].len, 0)")
    return lead, tail


def shape(cigar: str = "cigar") -> Column:
    """The operations' letters, classed as one of five shapes of a match."""
    letters = F.expr(f"array_join(transform({cigar}, c -> c.op), '')")
    return (
        F.when(letters == "M", "Map consecutively (M)")
        .when(letters == "MNM", "Map with splicing (MNM)")
        .when(letters.isin("SM", "MS"), "Map with clipping (SM or MS)")
        .when(letters.isin("MNMS", "SMNM"), "Map with splicing and clipping (MNMS or SMNM)")
        .otherwise("Others")
    )
