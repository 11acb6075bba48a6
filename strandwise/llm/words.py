"""Words ``[^\\x20\\x09-\\x0D]+`` of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from strandwise.llm.common import mix, text_buffer

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=5)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base & _MASK, 1 << max(10, int(size).bit_length()))


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64), 1)
    if lower:
        values[65:91] = values[97:123]
    return values


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each range; equal sequences have equal hashes wherever they stand."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), 7)


class Words:
    """Words of a column of texts: first and last byte, document and hash of each, and each document's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        self.data, self.offsets = text_buffer(texts)
        data = self.data
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        inside = ~blank
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.hashes = range_hashes(_byte_values(lower)[data], self.starts, self.ends, _BASE)
        self.first = np.searchsorted(self.starts, self.offsets)  # word index at which each document begins, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)


def sequence_hashes(words: Words, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the word sequence [start, end) for each range; ``salt`` picks one of several independent hashes."""
    return sequence_values(words.hashes, starts, ends, salt)


def sequence_values(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """sequence_hashes over an array of words' hashes."""
    return range_hashes(mix(hashes, 11 + salt), starts, ends, (0xD1342543DE82EF95 + 2 * salt * 0x5851F42D4C957F2D) | 1)
