"""Elias-Fano lists: non-decreasing integers in about 2 + log2(universe / n) bits each, with constant-time select.

A value v of n below a universe u is cut at ``low = floor(log2(u / n))`` bits.  The lower
parts stand packed one after another; the upper parts are written in unary into a vector
of n ones and u >> low zeros, in which the k-th one lies at ``(v >> low) + k``.  Select
finds that one from a table with the place of every ``SAMPLE``-th one, four bytes an
entry, and counts the ones of the words behind it.

Layout, little-endian: n (u64), universe (u64), the packed lower parts, the unary vector
and the samples (u32), each begun at a multiple of eight bytes.
"""

from __future__ import annotations

import numpy as np

#: Ones of the unary vector between two sampled places.
SAMPLE = 256
HEAD = 16
#: Values packed or unpacked at once.
BLOCK = 1 << 16


def _whole(n_bytes: int) -> int:
    return -(-n_bytes // 8) * 8


def low_bits(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0


def encode(values: np.ndarray, universe: int | None = None) -> bytes:
    """The list of ``values``: integers from 0 on that do not decrease, none above ``universe``."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    universe = 0 if not n else int(values[-1]) if universe is None else int(universe)
    low = low_bits(n, universe)
    head = np.array([n, universe], "<u8").tobytes()
    lower = b"".join(_packed(values[a : a + BLOCK], low) for a in range(0, n, BLOCK))
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = _whole(-(-(n + (universe >> low) + 1) // 8))
    unary = np.zeros(size, np.uint8)
    np.bitwise_or.at(unary, places >> 3, (1 << (places & 7)).astype(np.uint8))
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return head + lower.ljust(_whole(len(lower)), b"\0") + unary.tobytes() + samples.ljust(_whole(len(samples)), b"\0")


def _packed(values: np.ndarray, low: int) -> bytes:
    """The ``low`` lower bits of each value; BLOCK values of them fill whole bytes."""
    if not low:
        return b""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, :low], bitorder="little").tobytes()


class EliasFano:
    """Reads one encoded list in place."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.universe = (int(x) for x in np.frombuffer(data, "<u8", 2))
        self.low = low_bits(self.n, self.universe)
        at = HEAD
        self.lower = np.frombuffer(data, np.uint8, _whole(-(-self.n * self.low // 8)), at)
        at += len(self.lower)
        self.unary = np.frombuffer(data, "<u8", _whole(-(-(self.n + (self.universe >> self.low) + 1) // 8)) // 8, at)
        at += 8 * len(self.unary)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at)

    def __len__(self) -> int:
        return self.n

    def select(self, k: int) -> int:
        """The k-th value, from 0."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place = int(self.samples[k // SAMPLE])
        left, word = k % SAMPLE, place >> 6
        here = int(self.unary[word]) >> (place & 63) << (place & 63)
        while (ones := here.bit_count()) <= left:
            left -= ones
            word += 1
            here = int(self.unary[word])
        for _ in range(left):
            here &= here - 1
        upper = (word << 6) + (here & -here).bit_length() - 1 - k
        if not self.low:
            return upper
        begin = k * self.low
        own = int.from_bytes(self.lower[begin >> 3 : (begin + self.low + 7) >> 3].tobytes(), "little") >> (begin & 7)
        return upper << self.low | own & ((1 << self.low) - 1)

    def slice(self, first: int, stop: int) -> np.ndarray:
        """Values first to stop - 1, found from the sample before them on."""
        first, stop = max(0, first), min(stop, self.n)
        out = np.empty(max(0, stop - first), np.uint64)
        for a in range(first - first % SAMPLE, stop, BLOCK):
            b = min(a + BLOCK, stop)
            begin = int(self.samples[a // SAMPLE]) >> 6
            end = int(self.samples[-(-b // SAMPLE)]) // 64 + 1 if -(-b // SAMPLE) < len(self.samples) else len(self.unary)
            bits = np.unpackbits(self.unary[begin:end].view(np.uint8), bitorder="little")
            ones = np.flatnonzero(bits)
            skip = int(np.searchsorted(ones, int(self.samples[a // SAMPLE]) - begin * 64))
            upper = ones[skip : skip + b - a] + begin * 64 - np.arange(a, b)
            whole = upper.astype(np.uint64) << np.uint64(self.low) | self._lower(a, b)
            out[max(a, first) - first : b - first] = whole[max(a, first) - a :]
        return out

    def _lower(self, a: int, b: int) -> np.ndarray:
        if not self.low:
            return np.zeros(b - a, np.uint64)
        begin, end = a * self.low, b * self.low
        bits = np.unpackbits(self.lower[begin >> 3 : (end + 7) >> 3], bitorder="little")[begin & 7 :][: end - begin]
        wide = np.zeros((b - a, 64), np.uint8)
        wide[:, : self.low] = bits.reshape(-1, self.low)
        return np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
