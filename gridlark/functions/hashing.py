"""Hashes of keys and the folds made from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_GOLDEN = 0x9E3779B97F4A7C15


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@F.pandas_udf(LongType())
def mix64(x: pd.Series) -> pd.Series:
    """The splitmix64 finaliser; the bits of an unsigned number as a long."""
    return pd.Series(_mix(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(LongType())
def mix64_next(x: pd.Series) -> pd.Series:
    """The same after one step of the generator."""
    with np.errstate(over="ignore"):
        return pd.Series(_mix(x.to_numpy(np.int64).view(np.uint64) + np.uint64(_GOLDEN)).view(np.int64))


@F.pandas_udf(LongType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes."""
    out = np.empty(len(text), np.uint64)
    for i, t in enumerate(text):
        h = 0xCBF29CE484222325
        for b in (t or "").encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return pd.Series(out.view(np.int64))


def unsigned_mod(h: Column, n: int) -> Column:
    """h mod n of a 64-bit hash read as unsigned."""
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, F.lit(2**64 % n)).otherwise(0), F.lit(n)).cast("int")


def text_fold(a: Column, b: Column, n: int = 5) -> Column:
    """crc32 of "a,b" mod n."""
    return (F.crc32(F.concat_ws(",", a, b).cast("binary")) % n).cast("int")


def template_key(source: Column, target: Column, dx: Column, dy: Column) -> Column:
    """Ports and displacement in one number."""
    b = lambda c: c.cast("long")
    return b(source).bitwiseOR(F.shiftleft(b(target), 9)).bitwiseOR(F.shiftleft(b(dx) + 119, 18)).bitwiseOR(F.shiftleft(b(dy) + 549, 26))


def template_fold(source: Column, target: Column, dx: Column, dy: Column, n: int = 5) -> Column:
    return unsigned_mod(mix64(template_key(source, target, dx, dy)), n)


def sampled(row: Column, seed: int, rate: float) -> Column:
    """True for a fixed share of rows: the top 53 bits of the row's hash are below the rate."""
    top = F.shiftrightunsigned(mix64(row + F.lit(seed)), 11)
    return top < F.lit(int(rate * 2**53))
