"""64-bit hashes of a text's words, shared by the operators that compare words."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of so many bytes or more are hashed by BLAKE2: polynomials modulo 2**64 have weak long words.
LONG_WORD = 32
STEP = 1 << 17
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(30).integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0xD1342543DE82EF95
MUL = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(BASE, STEP), _powers(pow(BASE, -1, 1 << 64), STEP)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of ``data``, cut at blanks and the controls of white space, in order."""
    array = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SPACES[array], [True]])
    begin = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:])
    out = np.empty(len(begin), np.uint64)
    long = np.flatnonzero(end - begin >= LONG_WORD)
    k = 0
    while k < len(begin):
        a = int(begin[k])
        j = max(k + 1, int(np.searchsorted(end, a + STEP - 1, side="right")))
        part = array[a : min(int(end[j - 1]), a + STEP - 1)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=total[1:])
        own = begin[k:j] - a
        out[k:j] = (total[np.minimum(end[k:j] - a, len(part))] - total[own]) * _BACK[own]
        k = j
    for k in long.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]], digest_size=8).digest(), "little")
    return mix(out + (end - begin).astype(np.uint64) * np.uint64(MUL))
