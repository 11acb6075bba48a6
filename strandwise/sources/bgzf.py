"""BGZF streams: blocks, where they begin in the middle of a file, and BAM records in any byte range of a file."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Decompressed bytes that are walked together.
RUN = 1 << 20
#: Records that must follow one another from a place before it counts as a record's start.
CHAIN = 32


def block_size(head: bytes) -> int:
    """Bytes of the block whose first bytes these are; 0 if they are none's."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:  # the field BC holds the size
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def bgzf_blocks(raw: io.BufferedIOBase, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and decompressed bytes of each block of a BGZF stream that stands at offset at."""
    while head := raw.read(18):
        size = block_size(head)
        if not size:
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", head, 10)[0]
        body = raw.read(size - 18)
        if len(body) < size - 18:
            raise ValueError("a BGZF block is cut short")
        yield at, zlib.decompress(body[extra - 6 : -8], -15)
        at += size


def first_block(raw: io.RandomAccessFile, start: int, end: int, size: int) -> int | None:
    """Offset of the first block that begins in [start, end) of a file of ``size`` bytes: a header after which three others follow, or the end."""
    if not start:
        return 0
    raw.seek(start)
    window = raw.read(min((1 << 16) + 18, size - start))
    at = window.find(b"\x1f\x8b\x08\x04")
    while at >= 0 and start + at < end:
        place, fits = start + at, 0
        while fits < 4 and place < size:
            raw.seek(place)
            step = block_size(raw.read(18))
            if not step:
                break
            place, fits = place + step, fits + 1
        if fits == 4 or fits and place == size:
            return start + at
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


class Records:
    """Bytes of blocks in a row, with each block's offset, as they are asked for."""

    def __init__(self, raw: io.RandomAccessFile, at: int) -> None:
        raw.seek(at)
        self.blocks, self.data, self.marks, self.offsets = bgzf_blocks(raw, at), bytearray(), [], []
        self.after: int | None = None  # set when a walk has ended: where the first record beyond it begins

    def load(self, upto: int) -> bool:
        """Have ``upto`` bytes, or all; whether there are so many."""
        while len(self.data) < upto:
            found = next(self.blocks, None)
            if found is None:
                return False
            self.marks.append(len(self.data))
            self.offsets.append(found[0])
            self.data += found[1]
        return True

    def places(self, at: np.ndarray) -> np.ndarray:
        """Virtual offsets of places in data."""
        marks, offsets = np.array(self.marks, np.int64), np.array(self.offsets, np.int64)
        k = np.searchsorted(marks, at, "right") - 1
        return offsets[k] << 16 | (at - marks[k])

    def drop(self, n: int) -> None:
        """Forget the first n bytes."""
        del self.data[:n]
        keep = max(0, int(np.searchsorted(np.array(self.marks, np.int64), n, "right")) - 1)
        self.marks, self.offsets = [m - n for m in self.marks[keep:]], self.offsets[keep:]


def header(found: Records) -> tuple[str, list[tuple[str, int]], int]:
    """Text and contigs (name, length) of a BAM header, and where the first record begins in its bytes."""

    def number(at: int) -> int:
        if not found.load(at + 4):
            raise ValueError("a BAM header is cut short")
        return struct.unpack_from("<i", found.data, at)[0]

    if not found.load(4) or found.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    size = number(4)
    at, contigs = 12 + size, []
    for _ in range(number(8 + size)):
        n = number(at)
        length = number(at + 4 + n)
        contigs.append((found.data[at + 4 : at + 3 + n].decode(), length))
        at += 8 + n
    return found.data[8 : 8 + size].rstrip(b"\0").decode("utf-8", "replace"), contigs, at


def _fits(found: Records, at: int, n_contigs: int) -> int:
    """Bytes of the record at a place, 0 if none can begin there, -1 if the data end there."""
    if not found.load(at + 36):
        return -1 if len(found.data) == at else 0
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", found.data, at)
    least = 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq
    if not (n_name and 0 <= n_seq and least <= size and -1 <= ref < n_contigs and -1 <= mate < n_contigs and pos >= -1 and mate_pos >= -1):
        return 0
    if not found.load(at + 36 + n_name + 4 * n_ops):
        return 0
    name = found.data[at + 36 : at + 36 + n_name]
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return 0
    ops = struct.unpack_from(f"<{n_ops}I", found.data, at + 36 + n_name)
    return 4 + size if all(o & 15 <= 8 for o in ops) else 0


def first_record(found: Records, n_contigs: int, end: int) -> int | None:
    """Place in data of the first record that begins in a block before offset ``end``: CHAIN records follow from it, or all to the end."""
    at = 0
    while True:
        more = found.load(len(found.data) + RUN)
        view = np.frombuffer(bytes(found.data), np.uint8)
        top = len(view) - 36
        if top >= at:
            word = lambda k: sum(view[at + k + j : top + k + j + 1].astype(np.int64) << 8 * j for j in range(4)).astype(np.uint32).view(np.int32)
            ref, mate = word(4), word(24)
            maybe = np.flatnonzero((word(0) >= 32) & (ref >= -1) & (ref < n_contigs) & (mate >= -1) & (mate < n_contigs) & (word(8) >= -1) & (word(28) >= -1) & (word(20) >= 0) & (view[at + 12 : top + 13] > 0)) + at
            for place in maybe.tolist():
                if found.places(np.array([place]))[0] >> 16 >= end:
                    return None
                to, n = place, 0
                while n < CHAIN and (step := _fits(found, to, n_contigs)) > 0:
                    to, n = to + step, n + 1
                if n == CHAIN or n and step < 0:
                    return place
            at = top + 1
        if not more or found.offsets[-1] >= end:
            return None


def record_runs(found: Records, at: int, end: int, most: int = RUN) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Data, starts of whole records in it (and the end), and their virtual offsets, from place ``at`` on.

    The last run ends before the first record whose virtual offset is ``end`` or more; found.after then holds that.
    """
    while True:
        more = found.load(at + most)
        starts, size, data, to = [], len(found.data), bytes(found.data), at
        while to + 4 <= size:
            step = 4 + int.from_bytes(data[to : to + 4], "little", signed=True)
            if step < 36:
                raise ValueError("a BAM record is damaged")
            if to + step > size:
                break
            starts.append(to)
            to += step
        if not starts and more:
            most *= 2  # one record is longer
            continue
        places = found.places(np.array(starts, np.int64)) if starts else np.zeros(0, np.int64)
        kept = int(np.searchsorted(places, end, "left"))
        if kept:
            yield data, np.array([*starts[:kept], starts[kept] if kept < len(starts) else to], np.int64), places[:kept]
        if kept < len(starts):
            found.after = int(places[kept])
            return
        if not more:
            if to < size:
                raise ValueError("a BAM file is cut short")
            return
        found.drop(to)
        at = 0
