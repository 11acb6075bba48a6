"""Sequence functions: orientation, k-mers, differences, MD tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """A and T, G and C change places; other letters stay."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def oriented(seq: Column, flag: Column) -> Column:
    """The sequence as it was read."""
    return F.when(has(flag, 16), reverse_complement(seq)).otherwise(seq)


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def kmers(seq: str, k: int = 6, step: int = 1, frame: int = 0) -> Column:
    """Array of the words of length k from ``frame`` on."""
    return F.expr(f"if(length({seq}) >= {k + frame}, transform(sequence({frame}, length({seq}) - {k}, {step}), i -> substring({seq}, i + 1, {k})), cast(array() as array<string>))")


def differences(a: str, b: str) -> Column:
    """(pos, from, to) where two strings of equal length differ; none where the lengths differ."""
    return F.expr(
        f"if(length({a}) = length({b}) and length({a}) > 0, filter(transform(sequence(0, length({a}) - 1), i -> named_struct('pos', i, 'old', substring({a}, i + 1, 1), 'new', substring({b}, i + 1, 1))), d -> d.old <> d.new),"
        " cast(array() as array<struct<pos:int,old:string,new:string>>))"
    )


def md_mismatches(md: str, seq: str) -> Column:
    """(pos, ref, read) of an MD tag without deletions: each number skips matches, each letter run is one mismatch token.

    Reading stops where a token lies beyond the read's end.
    """
    token = "([0-9]+)([A-Z]+)"
    return F.expr(
        f"aggregate(zip_with(regexp_extract_all({md}, '{token}', 1), regexp_extract_all({md}, '{token}', 2), (n, l) -> named_struct('n', int(n), 'l', l)),"
        " named_struct('p', 0, 'out', cast(array() as array<struct<pos:int,ref:string,read:string>>)),"
        f" (a, t) -> named_struct('p', a.p + t.n + length(t.l), 'out', if(a.p + t.n < length({seq}),"
        f" array_append(a.out, named_struct('pos', a.p + t.n, 'ref', t.l, 'read', substring({seq}, a.p + t.n + 1, 1))), a.out)),"
        " a -> a.out)"
    )


def strand_rule(text: str) -> dict[str, str]:
    """``++,--`` or ``1++,1--,2+-,2-+`` to {read strand (with its number): gene strand}; ``none`` is empty."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if not parts or text == "none":
        return {}
    if len(parts) not in (2, 4) or len({len(p) for p in parts}) != 1:
        raise ValueError(f"unknown strand rule: {text}")
    return {p[:-1]: p[-1] for p in parts}


def name_bit(name: str) -> Column:
    """The low bit of the 32-bit string hash (times 31, then mixed) that decides which of two overlapping mates keeps its qualities."""
    cut = "4294967296L"
    chars = f"split({name}, '')"
    summed = f"aggregate({chars}, 0L, (h, c) -> if(c = '', h, pmod(h * 31 + ascii(c), {cut})))"
    steps = [
        "pmod(k + pmod(-1 - shiftleft(k, 15), {c}), {c})", "k ^ shiftright(k, 10)", "pmod(k + shiftleft(k, 3), {c})",
        "k ^ shiftright(k, 6)", "pmod(k + pmod(-1 - pmod(shiftleft(k, 11), {c}), {c}), {c})", "k ^ shiftright(k, 16)",
    ]
    expr = summed
    for step in steps:
        expr = f"element_at(transform(array({expr}), k -> {step.format(c=cut)}), 1)"
    return F.expr(f"{expr} & 1")
