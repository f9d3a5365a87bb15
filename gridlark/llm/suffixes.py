"""Suffix order of texts made of short pieces."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, left: np.ndarray, top: int) -> np.ndarray:
    """All suffixes of pieces over 1..top in order, by prefix doubling.

    Each piece ends with a 0; left[i] counts the symbols from i to that end, the 0 included. A suffix
    ends with its piece; equal ones, and so the ends, are in order of position.
    """
    n = len(text)
    bits = max(1, int(top).bit_length())
    symbols = max(1, 62 // bits)

    def ahead(key: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - by)] = key[by:]
        out[left <= by] = 0
        return out

    power, width, key, depth = text.astype(np.int64), 1, None, 0
    while True:  # the first ``symbols`` symbols of each suffix as one number
        if symbols & width:
            key, depth = (power, width) if key is None else ((power << (bits * depth)) | ahead(key, width), depth + width)
        if width * 2 > symbols:
            break
        power, width = (power << (bits * width)) | ahead(power, width), width * 2
    longest = int(left.max(initial=1)) - 1
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if depth >= longest or new.all():
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1) + ahead(rank, depth)
        depth *= 2
    if not new.all():
        order = np.sort((np.cumsum(new) - 1) * n + order) % n
    return order
