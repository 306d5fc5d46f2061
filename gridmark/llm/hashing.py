"""Words, n-grams and their 64-bit hashes of many texts at once, as array operations over UTF-8 bytes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; bytes over 127 never are one of these,
so that runs of bytes are runs of characters. The hash of a word is a polynomial in random byte values
(modulo 2**64) with a bijective finish; that of an n-gram a polynomial in the hashes of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
FOLD = _fold


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finish of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _BASE)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64; grows on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()
_BYTES = seeded(256, 7)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and offsets of each row in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of all rows in order. row: of each word; first: index of the first word of each row, and the count at the end."""

    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    n = len(data)
    blank = SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    after_gap = np.ones(n, bool)
    before_gap = np.ones(n, bool)
    if n:
        after_gap[1:] = blank[:-1] | cut[1:n]
        before_gap[:-1] = blank[1:] | cut[1:n]
    solid = ~blank
    starts = np.flatnonzero(solid & after_gap)
    ends = np.flatnonzero(solid & before_gap) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = int(starts[at])
            upto = max(int(np.searchsorted(ends, base + SEGMENT, "right")), at + 1)
            piece = data[base : int(ends[upto - 1])]
            up, down = _POWERS.upto(len(piece) + 1)
            values = _BYTES[FOLD[piece] if fold else piece]
            values *= up[: len(piece)]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            s, e = starts[at:upto] - base, ends[at:upto] - base
            hashes[at:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = upto
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(hashes, row, first, starts, ends)


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, rows disregarded; position i stands for words i to i + n - 1."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:count] + np.uint64(n)
        for k in range(1, n):
            out = out * _STEP + hashes[k : k + count]
        return mix(out)
