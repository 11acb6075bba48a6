"""The rANS codec of CRAM blocks (four interleaved states, orders 0 and 1), decoding only."""

from __future__ import annotations

import struct

#: Bits of a frequency total, and the state's lower bound.
BITS, LOW = 12, 1 << 23
MASK = (1 << BITS) - 1


class _Bytes:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def next(self) -> int:
        self.at += 1
        return self.data[self.at - 1]


def _symbols(src: _Bytes):
    """The symbols of a table in order; a symbol that follows the one before says how many more follow it."""
    sym, run = src.next(), 0
    while True:
        yield sym
        if run:
            run, sym = run - 1, sym + 1
            continue
        new = src.next()
        if new == sym + 1:
            run = src.next()
        if new == 0:
            return
        sym = new


def _frequencies(src: _Bytes) -> tuple[list[int], list[int], bytes]:
    """Frequency and start of each symbol, and the symbol of each of 2^BITS slots."""
    freq, start, slots, at = [0] * 256, [0] * 256, bytearray(), 0
    for sym in _symbols(src):
        f = src.next()
        if f >= 0x80:
            f = (f & 0x7F) << 8 | src.next()
        freq[sym], start[sym] = f, at
        slots += bytes([sym]) * f
        at += f
    return freq, start, bytes(slots.ljust(1 << BITS, b"\0"))


def decode(data: bytes) -> bytes:
    """The bytes of a compressed block."""
    order, _, size = struct.unpack_from("<BII", data)
    src = _Bytes(data, 9)
    if not size:
        return b""
    if order == 0:
        tables = dict.fromkeys(range(256), _frequencies(src))
    elif order == 1:
        tables = {sym: _frequencies(src) for sym in _symbols(src)}
    else:
        raise ValueError(f"unknown order {order} of a block")
    states = list(struct.unpack_from("<4I", data, src.at))
    src.at += 16
    out = bytearray(size)
    quarter = size // 4

    def step(k: int, sym_before: int) -> int:
        freq, start, slots = tables[sym_before]
        low = states[k] & MASK
        sym = slots[low]
        state = freq[sym] * (states[k] >> BITS) + low - start[sym]
        while state < LOW and src.at < len(data):
            state = state << 8 | src.next()
        states[k] = state
        return sym

    if order == 0:
        for i in range(size):
            out[i] = step(i % 4, 0)
        return bytes(out)
    last = [0] * 4
    for i in range(quarter):
        for k in range(4):
            last[k] = out[k * quarter + i] = step(k, last[k])
    for i in range(4 * quarter, size):
        last[3] = out[i] = step(3, last[3])
    return bytes(out)
