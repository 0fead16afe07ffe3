"""Keys for fuzzy lookup from the perfect binary Golay code of length 23.

Every 23-bit word is within distance 3 of exactly one of the 4096 codewords. A word's keys are
all codewords within distance 4 of it: one if the nearest is within 2, else that one and the
five at distance 4. Two words that differ in at most two bits have a word between them at
distance one from both; its codeword is within 4 of both, so they share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


_BIT = [_remainder(1 << i) for i in range(LENGTH)]


def _linear(first: int, bits: int) -> np.ndarray:
    """Remainders of all words in ``bits`` positions from ``first`` up."""
    out = np.zeros(1 << bits, np.int32)
    for i in range(bits):
        out[1 << i : 2 << i] = out[: 1 << i] ^ _BIT[first + i]
    return out


_LOW, _HIGH = _linear(0, 12), _linear(12, 11)


def _patterns() -> np.ndarray:
    """For each remainder the error patterns of weight 4 at most that leave it; -1 fills up."""
    rows: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            r = 0
            for p in places:
                r ^= _BIT[p]
            rows[r].append(sum(1 << p for p in places))
    return np.array([r + [-1] * (KEYS - len(r)) for r in rows], np.int32)


_PATTERNS = _patterns()


def keys(words: np.ndarray) -> np.ndarray:
    """A row of six codeword numbers (0 to 4095) for each word; -1 fills up."""
    words = np.asarray(words).astype(np.int32)
    errors = _PATTERNS[_LOW[words & 4095] ^ _HIGH[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)
