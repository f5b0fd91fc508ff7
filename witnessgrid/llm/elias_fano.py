"""Elias-Fano coding of a non-decreasing sequence, with select.

Each value is split into ``low`` plain bits and a unary upper part: bit ``(value >> low) + i`` is
set for the i-th value. That takes about ``2 + log2(universe / n)`` bits a value. The position
of every 64th set bit is kept as a 32-bit number, so ``select(i)`` scans a few bytes from there.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<4sBxxxQQII"  # magic, low bits, values, universe, bytes of low part, of upper part
_MAGIC = b"EFv1"
_STEP = 64
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def encode(values: np.ndarray, universe: int) -> bytes:
    """``values`` sorted, each from 0 to ``universe`` (below 2^32)."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if n and (values[0] < 0 or values[-1] > universe or (np.diff(values) < 0).any()):
        raise ValueError("values must be sorted and inside the universe")
    if universe >= 1 << 32:
        raise ValueError("a segment is limited to 2^32 entries")
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    bits = (values[:, None] >> np.arange(low - 1, -1, -1)) & 1
    lower = np.packbits(bits.astype(np.uint8).ravel()).tobytes()
    upper = np.zeros(n + (universe >> low) + 1, np.uint8)
    ones = (values >> low) + np.arange(n)
    upper[ones] = 1
    upper = np.packbits(upper).tobytes()
    samples = ones[::_STEP].astype("<u4").tobytes()
    return struct.pack(_HEAD, _MAGIC, low, n, universe, len(lower), len(upper)) + lower + upper + samples


class EliasFano:
    """Reads what :func:`encode` wrote, in place."""

    def __init__(self, blob: bytes):
        magic, self.low, self.n, self.universe, lows, uppers = struct.unpack_from(_HEAD, blob)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano block")
        at = struct.calcsize(_HEAD)
        self._lower = np.frombuffer(blob, np.uint8, lows, at)
        self._upper = np.frombuffer(blob, np.uint8, uppers, at + lows)
        count = -(-self.n // _STEP)
        self._samples = np.frombuffer(blob, "<u4", count, at + lows + uppers)
        self.size = at + lows + uppers + 4 * count

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit, left = int(self._samples[i // _STEP]), i % _STEP
        byte = bit >> 3
        word = int(self._upper[byte]) & (0xFF >> (bit & 7))
        while (have := int(_ONES[word])) <= left:
            left -= have
            byte += 1
            word = int(self._upper[byte])
        for shift in range(7, -1, -1):
            if word >> shift & 1:
                if left == 0:
                    break
                left -= 1
        upper = byte * 8 + 7 - shift - i
        value = 0
        for bit in range(i * self.low, (i + 1) * self.low):
            value = value << 1 | int(self._lower[bit >> 3]) >> (7 - (bit & 7)) & 1
        return upper << self.low | value

    def all(self) -> np.ndarray:
        """Every value, in one pass."""
        upper = np.flatnonzero(np.unpackbits(self._upper))[:self.n] - np.arange(self.n)
        bits = np.unpackbits(self._lower)[:self.n * self.low].reshape(self.n, self.low).astype(np.int64)
        return (upper << self.low) + bits @ (1 << np.arange(self.low - 1, -1, -1, dtype=np.int64))
