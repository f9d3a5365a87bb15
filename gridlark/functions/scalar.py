"""Column expressions on coordinates, crossings and scores. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def trim_ascii(c: Column) -> Column:
    """Without ASCII white space at both ends, a carriage return included."""
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def sign(c: Column) -> Column:
    return F.when(c > 0, 1).when(c < 0, -1).otherwise(0)


def direction_code(dx: Column, dy: Column) -> Column:
    return (sign(dx) + 1) * 3 + sign(dy) + 1


def total(terms: list[Column], start: int = 0) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(start))


def int_div(a: Column, b: int) -> Column:
    """Integer quotient of a number that is not negative."""
    return F.floor(a / F.lit(b)).cast("int")


def crossing(a: Column, b: Column, lines: list[tuple[int, int]]) -> tuple[Column, Column, Column]:
    """(delay, count, bit mask) of the lines between two coordinates; the lines are literals, so there is no join."""
    low, high = F.least(a, b), F.greatest(a, b)
    crossed = [(low <= site) & (F.lit(site) < high) for site, _ in lines]
    delay = total([F.when(c, d).otherwise(0) for c, (_, d) in zip(crossed, lines, strict=True)])
    count = total([c.cast("int") for c in crossed])
    mask = total([F.when(c, 1 << i).otherwise(0) for i, c in enumerate(crossed)])
    return delay, count, mask


def zone(c: Column, lines: list[tuple[int, int]]) -> Column:
    """How many lines lie strictly below a coordinate."""
    return total([(F.lit(site) < c).cast("int") for site, _ in lines])


def nearest(c: Column, lines: list[tuple[int, int]]) -> Column:
    away = [F.abs(c - site) for site, _ in lines]
    return F.least(*away) if len(away) > 1 else away[0]


def block_mask(sx: Column, sy: Column, tx: Column, ty: Column, blocks: list[tuple]) -> Column:
    """Bits of the blocks that meet the rectangle of two sites."""
    bits = []
    for i, (lower, upper, left, right, *_) in enumerate(blocks):
        meets = (F.least(sx, tx) <= right) & (F.greatest(sx, tx) >= left) & (F.least(sy, ty) <= upper) & (F.greatest(sy, ty) >= lower)
        bits.append(F.when(meets, 1 << i).otherwise(0))
    return total(bits)


def on_block(x: Column, y: Column, blocks: list[tuple]) -> Column:
    hits = [x.between(left, right) & y.between(lower, upper) for lower, upper, left, right, *_ in blocks]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def point_score(golden: Column, estimate: Column) -> Column:
    """1 - tanh(4 * relative error); a golden 0 scores 1 for an exact answer, else 0."""
    relative = F.abs(estimate - golden) / F.when(golden == 0, None).otherwise(golden)
    return F.when(golden == 0, (estimate == 0).cast("double")).otherwise(1 - F.tanh(4 * relative))
