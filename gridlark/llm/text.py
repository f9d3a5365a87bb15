"""Whole-batch text work in numpy: word boundaries and position-independent hashes of words and windows.

Texts are handled as the UTF-8 bytes of an Arrow column, so no Python string is made per word. A
hash of an item sequence x is sum(x[i] * R**i) over 64-bit integers; prefix sums give that of every
window in constant time, and a finaliser mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is worked on alone.
SLICE_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240611))
BYTE_KEYS = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)

#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Powers:
    """R**i and R**-i for i up to the longest slice seen."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


POWERS = tuple(_Powers(b) for b in BASES)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Hasher:
    """Hashes of any windows of one sequence of 64-bit items."""

    def __init__(self, items: np.ndarray, which: int = 0):
        up, self.down = POWERS[which].get(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * up[: len(items)], out=self.sums[1:])

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of items[starts:ends], element by element; the length takes part."""
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(h)

    def all_windows(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mixed((self.sums[k:] - self.sums[: len(self.sums) - k])[:n] * self.down[:n])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, at = column_bytes(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a run of documents: byte starts and ends, and the row of each word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray):
        inside = ~separators[data]
        n = len(data)
        first, last = inside.copy(), inside.copy()
        if n:
            cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words of row r are first_word[r]:first_word[r + 1]
        self.first_word = np.searchsorted(self.starts, at)
        self.per_row = np.diff(self.first_word)
        self.row = np.repeat(np.arange(len(at) - 1), self.per_row)

    def hashes(self, data: np.ndarray, which: int = 0) -> np.ndarray:
        return Hasher(BYTE_KEYS[which][data], which).windows(self.starts, self.ends)


def small_ints(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position of each value in the sorted array ``known``, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)
