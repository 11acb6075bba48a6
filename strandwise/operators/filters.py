"""Read filters: each report has its own, named here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE = 1, 2, 4, 8, 16, 64, 128, 256, 512, 1024

#: Flag bits whose reads a report drops, and whether it drops reads below the mapping quality.
POLICIES = {
    "read_gc": (QC_FAIL | UNMAPPED, True),
    "read_nvc": (0, True),
    "read_quality": (0, True),
    "read_duplication": (QC_FAIL | UNMAPPED, True),
    "clipping_profile": (QC_FAIL | UNMAPPED, True),
    "insertion_profile": (QC_FAIL | UNMAPPED, True),
    "deletion_profile": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, True),
    "mismatch_profile": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, True),
    "infer_experiment": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, True),
    "read_distribution": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, False),
    "inner_distance": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, True),
    "fragment_size": (QC_FAIL | DUPLICATE | SECONDARY, True),
    "junctions": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, True),
    "rpkm_saturation": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, True),
    "signal": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, False),
    "signal_unique": (QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED, True),
    "fpkm": (QC_FAIL | DUPLICATE | SECONDARY, False),
    "fpkm_unique": (QC_FAIL | DUPLICATE | SECONDARY, True),
    "pileup": (QC_FAIL | SECONDARY | UNMAPPED, False),
}


def has(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def lacks(bits: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bits)) == 0


def good_quality(q_cut: int = 30) -> Column:
    """A missing mapping quality reads 255 and passes."""
    return F.coalesce(F.col("mapq"), F.lit(255)) >= q_cut


def keeps(report: str, q_cut: int = 30) -> Column:
    bits, by_quality = POLICIES[report]
    parts = ([lacks(bits)] if bits else []) + ([good_quality(q_cut)] if by_quality else [])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def strand() -> Column:
    return F.when(has(REVERSE), "-").otherwise("+")
