"""Estimates from the first hops: the raw lower bound and its calibrated form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalar import int_div, sign
from ..plans.arch import Arch
from .potentials import Potentials

KEYS = ["sx", "sy", "sp", "tx", "ty", "tp"]


def hops(pairs: DataFrame, arch: Arch) -> DataFrame:
    """Landings of all first hops of distinct pairs: KEYS, ord, internal_id, x, y, initial (delay so far)."""
    q = pairs.join(F.broadcast(arch.first_hops), F.col("sp") == F.col("source_port")).drop("source_port")
    stay = q.where("net_id is null").select(*KEYS, "ord", "internal_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(0).alias("initial"))
    w = arch.walks.select(F.col("from_x").alias("sx"), F.col("from_y").alias("sy"), "net_id", "to_x", "to_y", (F.col("block_delay") + F.col("line_delay")).alias("gap"))
    move = q.where("net_id is not null").join(w, ["sx", "sy", "net_id"])
    move = move.select(*KEYS, "ord", "internal_id", F.col("to_x").alias("x"), F.col("to_y").alias("y"), (F.col("arc_delay") + F.col("gap")).alias("initial"))
    return stay.unionByName(move)


def raw_estimates(requests: DataFrame, arch: Arch, potentials: Potentials) -> DataFrame:
    """The 19 search features of each distinct pair (KEYS); null stands for unreachable.

    Each first hop's delay is exact and the rest is a lower bound, so raw never exceeds the true
    delay. The best hop is the first in hop order among equals; second counts equal values twice. A
    pair of one pin has 0 everywhere. The group of a pair holds its first hops only, some dozens.
    """
    pairs = requests.select(*KEYS).distinct()
    found = hops(pairs, arch).join(F.broadcast(potentials.frame().withColumnRenamed("target_port", "tp")), ["tp", "internal_id"])
    parts = potentials.components(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("pot"))
    found = found.withColumn("parts", F.array(*parts))
    found = found.withColumn("value", F.col("initial") + F.array_max("parts"))
    best = F.min(F.struct("value", "ord", "initial", "x", "y", "internal_id")).alias("top")
    low = [F.min(F.col("initial") + F.col("parts")[i]).alias(f"d{i}") for i in range(len(fixed.DIRECTIONS))]
    agg = found.groupBy(*KEYS).agg(best, F.get(F.array_sort(F.collect_list("value")), F.lit(1)).alias("second"), *low, F.count(F.lit(1)).alias("candidates"), F.min("initial").alias("min_initial"), F.max("initial").alias("max_initial"))
    arcs = F.broadcast(arch.arcs.groupBy(F.col("from_port").alias("sp"), F.col("to_port").alias("tp")).agg(F.min("delay").alias("arc")))
    out = pairs.join(agg, KEYS, "left").join(arcs, ["sp", "tp"], "left")
    same_site = (F.col("sx") == F.col("tx")) & (F.col("sy") == F.col("ty"))
    same = same_site & (F.col("sp") == F.col("tp"))
    out = out.withColumn("direct", F.when(same_site, F.col("arc")))

    def col(c: Column, at_same: int = 0, none: int | None = None) -> Column:
        c = F.coalesce(c, F.lit(none)) if none is not None else c
        return F.when(same, at_same).otherwise(c).cast("int")

    cols = [col(F.least("top.value", "direct")).alias("raw")] + [col(F.col(f"d{i}")).alias(f"d{i}") for i in range(len(fixed.DIRECTIONS))]
    cols += [col(F.col("top.value")).alias("best"), col(F.col("second")).alias("second"), col(F.col("direct")).alias("direct"), col(F.col("candidates"), 0, 0).alias("candidates")]
    cols += [col(F.col("min_initial")).alias("min_initial"), col(F.col("max_initial"), 0, 0).alias("max_initial")]
    cols += [col(F.col(f"top.{c}"), 0, 0).alias(n) for c, n in (("initial", "best_initial"), ("x", "best_x"), ("y", "best_y"), ("internal_id", "best_internal"))]
    return out.select(*KEYS, *cols)


def calibration_keys(ports: int = 496) -> list[tuple[str, Column, float]]:
    """(name, cell, shrinkage) of the twelve stages in order; columns sp, tp, dx, dy, raw."""
    adx, ady, raw = F.abs("dx"), F.abs("dy"), F.col("raw")
    way = (sign(F.col("dx")) + 1) * 3 + sign(F.col("dy")) + 1
    slow = F.least(int_div(raw, 64), F.lit(127))
    sx = F.lit(11) + sign(F.col("dx")) * F.least(int_div(adx, 10), F.lit(11))
    sy = F.lit(45) + sign(F.col("dy")) * F.least(int_div(ady, 12), F.lit(45))
    return [
        ("fine_spatial", F.least(int_div(adx, 5), F.lit(23)) * 91 + F.least(int_div(ady, 6), F.lit(90)), 1.0),
        ("raw_delay", F.least(int_div(raw, 32), F.lit(255)), 5.0),
        ("sign", way, 500.0),
        ("remainder", (adx % 10) * 12 + ady % 12, 2000.0),
        ("source_port", F.col("sp"), 2000.0),
        ("target_port", F.col("tp"), 2000.0),
        ("port_pair", F.col("sp") * ports + F.col("tp"), 5.0),
        ("target_delay", F.col("tp") * 128 + slow, 100.0),
        ("source_delay", F.col("sp") * 128 + slow, 100.0),
        ("target_sign", F.col("tp") * 9 + way, 20.0),
        ("source_sign", F.col("sp") * 9 + way, 20.0),
        ("signed_spatial", sx * 91 + sy, 5.0),
    ]


def linear_start(raw: Column) -> Column:
    return F.floor((raw.cast("long") * fixed.NUMERATOR + fixed.DENOMINATOR // 2) / fixed.DENOMINATOR) + fixed.INTERCEPT


def apply_factor(value: Column, q: Column) -> Column:
    """value * q in fixed point, rounded; a missing factor is 1."""
    one = 1 << fixed.Q_SHIFT
    return F.shiftright(value * F.coalesce(q, F.lit(one)).cast("long") + one // 2, fixed.Q_SHIFT)


def calibrated(estimates: DataFrame, tables: DataFrame) -> DataFrame:
    """estimates (KEYS, raw, direct, ...) with ``calibrated``; tables: (name, cell, q14) of all stages.

    Factors are looked up by twelve joins with parts of one small table (of ports ** 2 cells at most).
    """
    df = estimates.withColumns({"dx": F.col("tx") - F.col("sx"), "dy": F.col("ty") - F.col("sy"), "_v": linear_start(F.col("raw"))})
    for name, cell, _ in calibration_keys():
        part = tables.where(F.col("name") == name).select(F.col("cell").alias("_c"), F.col("q14").alias("_q"))
        df = df.withColumn("_cell", cell.cast("int")).join(part, F.col("_cell") == F.col("_c"), "left")
        df = df.withColumn("_v", apply_factor(F.col("_v"), F.col("_q"))).drop("_cell", "_c", "_q")
    answer = F.least(F.col("_v"), F.coalesce(F.col("direct").cast("long"), F.col("_v")))
    same = (F.col("sx") == F.col("tx")) & (F.col("sy") == F.col("ty")) & (F.col("sp") == F.col("tp"))
    return df.withColumn("calibrated", F.when(same, 0).when(F.col("raw").isNotNull(), answer).cast("long")).drop("_v", "dx", "dy")
