"""Hashes of the words of many texts at once, in numpy.

A word's hash is a polynomial in its bytes modulo 2**64, read off a running sum over a block of
bytes, and then mixed. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 500_000
BLOCK = 1 << 18  # bytes that are hashed at once, a power of two
NUMBER = np.uint64(0x5851F42D4C957F2D)  # stands for every word with a digit
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, up to a block's length."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(BLOCK, np.uint64)
        n = 1
        while n < BLOCK:
            p[n : 2 * n] = p[:n] * U(pow(base, n, 1 << 64))
            n *= 2
        out.append(p)
    return out[0], out[1]


def _long_word(data: np.ndarray) -> int:
    """The polynomial of one word, block by block."""
    up, total = _powers()[0], 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK].astype(np.uint64) + U(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, at, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of bytes that is ``inside``; data is lower-cased bytes.

    Words are taken in blocks of ``BLOCK`` bytes, so that only a byte or two a byte of a long
    text is held besides.
    """
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers()
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        low = starts[a]
        b = int(np.searchsorted(ends, low + BLOCK, "right"))
        if b <= a:
            out[a], a = _long_word(data[low : ends[a]]), a + 1
            continue
        n = ends[b - 1] - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n].astype(np.uint64) + U(1)) * up[:n], out=sums[1:])
        first = starts[a:b] - low
        out[a:b] = (sums[ends[a:b] - low] - sums[first]) * down[first]
        a = b
    return starts, ends, mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def sized(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` bytes; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
