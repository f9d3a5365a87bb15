"""Fitting of residual effects: shrunken group means of log(golden / prediction), stage after stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalar import block_mask, crossing, direction_code, int_div, zone
from ..plans.arch import Arch
from ..plans.lineage import cut
from .estimate import calibration_keys


#: Cells of a stage that are broadcast, 24 bytes each; all twelve tables of the published form together have fewer.
MOST_CELLS = 1 << 19


def effects(df: DataFrame, cell: Column, shrink: float, golden: str = "golden", prediction: str = "prediction") -> DataFrame:
    """(cell, effect): sum of log(golden / prediction) over (rows + shrink). Rows that are not positive don't count."""
    use = df.where((F.col(golden) > 0) & (F.col(prediction) > 0))
    log = F.ln(F.col(golden) / F.col(prediction))
    return use.groupBy(cell.alias("cell")).agg((F.sum(log) / (F.count(F.lit(1)) + F.lit(shrink))).alias("effect"))


def staged_fit(df: DataFrame, stages: list[tuple[str, Column, float]], golden: str = "golden", prediction: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """(tables (name, cell, effect), df with the fitted ``prediction``).

    Each stage sees the prediction of the one before. Effects are aggregated before the shuffle and
    joined back by their cell: sent to all tasks where MOST_CELLS or fewer were counted, so the rows
    stay where they are; else by a shuffle. The lineage is cut every fourth stage.
    """
    tables = None
    for i, (name, cell, shrink) in enumerate(stages):
        df = df.withColumn("_cell", cell.cast("long"))
        fitted = effects(df, F.col("_cell"), shrink, golden, prediction)
        fitted = cut(fitted)
        beside = fitted.withColumnRenamed("cell", "_cell")
        df = df.join(F.broadcast(beside) if fitted.count() <= MOST_CELLS else beside, "_cell", "left").withColumn(prediction, F.col(prediction) * F.exp(F.coalesce("effect", F.lit(0.0)))).drop("_cell", "effect")
        own = fitted.select(F.lit(name).alias("name"), "cell", "effect")
        tables = own if tables is None else tables.unionByName(own)
        if i % 4 == 3:
            df = cut(df)
    return tables, df


def fit_calibration(df: DataFrame, ports: int = 496) -> tuple[DataFrame, DataFrame]:
    """The twelve stages over rows (sp, tp, dx, dy, raw, golden), from the linear start."""
    start = df.withColumn("prediction", F.col("raw") * (fixed.NUMERATOR / fixed.DENOMINATOR) + fixed.INTERCEPT)
    return staged_fit(start, calibration_keys(ports))


def quantised(tables: DataFrame) -> DataFrame:
    """(name, cell, q14): effects in fixed point; raises where a factor doesn't fit 16 bits."""
    q = F.rint(F.exp("effect") * (1 << fixed.Q_SHIFT)).cast("long")
    return tables.select("name", "cell", F.when((q < 0) | (q > 65535), F.raise_error(F.lit("factor out of range")).cast("long")).otherwise(q).cast("int").alias("q14"))


def grid_stages(arch: Arch) -> list[tuple[str, Column, float]]:
    """(name, cell, shrinkage) of the twenty stages that know the grid; columns sx, sy, tx, ty, s_family, t_family, sp, tp."""
    c = F.col
    sx, sy, tx, ty = c("sx"), c("sy"), c("tx"), c("ty")
    dx, dy = tx - sx, ty - sy
    tile = lambda x, y, n: int_div(x, n) * 1000 + int_div(y, n)
    n_y = len(arch.horizontal) + 1
    zs = zone(sx, arch.vertical) * n_y + zone(sy, arch.horizontal)
    zt = zone(tx, arch.vertical) * n_y + zone(ty, arch.horizontal)
    zones = (len(arch.vertical) + 1) * n_y
    way = direction_code(dx, dy)
    mid = tile(int_div(sx + tx, 2), int_div(sy + ty, 2), 4)
    gaps = F.least(crossing(sx, tx, arch.vertical)[0], F.lit(1023)) * 64 + F.least(crossing(sy, ty, arch.horizontal)[0], F.lit(63))
    return [
        ("source_x", sx, 500.0), ("source_y", sy, 500.0), ("target_x", tx, 500.0), ("target_y", ty, 500.0),
        ("source_site_4x4", tile(sx, sy, 4), 80.0), ("target_site_4x4", tile(tx, ty, 4), 80.0),
        ("source_site_2x2", tile(sx, sy, 2), 120.0), ("target_site_2x2", tile(tx, ty, 2), 120.0),
        ("signed_displacement", (dx + 119) * 550 + F.floor(dy / 2) + 275, 40.0), ("midpoint_4x4", mid, 100.0),
        ("gap_crossing", gaps, 30.0), ("block_bbox", block_mask(sx, sy, tx, ty, arch.block_list), 100.0),
        ("source_target_zone", zs * zones + zt, 60.0), ("source_port_zone", c("sp") * zones + zs, 100.0), ("target_port_zone", c("tp") * zones + zt, 100.0),
        ("family_direction", (c("s_family") * 512 + c("t_family")) * 9 + way, 80.0),
        ("source_family_target_zone", c("s_family") * zones + zt, 120.0), ("target_family_source_zone", c("t_family") * zones + zs, 120.0),
        ("zone_pair_direction", (zs * zones + zt) * 9 + way, 80.0), ("midpoint_direction", mid * 9 + way, 100.0),
    ]


def _encoded(out: DataFrame, sums: DataFrame, key: list[str], value: str, mean: float, smoothing: float, name: str) -> DataFrame:
    own, one = F.when(F.col("_t"), F.col(value)).otherwise(0.0), F.when(F.col("_t"), 1).otherwise(0)
    joined = out.join(sums, key, "left").fillna({"_sum": 0.0, "_n": 0})
    return joined.withColumn(name, (F.col("_sum") - own + smoothing * mean) / (F.col("_n") - one + smoothing)).drop("_sum", "_n")


def _key_sums(marked: DataFrame, key: list[str], value: str) -> DataFrame:
    return marked.where("_t").groupBy(*key).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))


def leave_one_out(df: DataFrame, key: list[str], value: str, train: Column, smoothing: float, name: str = "encoded") -> DataFrame:
    """``df`` with the smoothed mean of ``value`` by key over the training rows; a training row leaves itself out.

    Sums are aggregated by key and joined back, which, unlike a window, does not gather a key's rows.
    """
    marked = df.withColumn("_t", train.cast("boolean"))
    mean = marked.where("_t").agg(F.avg(value)).first()[0] or 0.0
    return _encoded(marked, _key_sums(marked, key, value), key, value, mean, smoothing, name).drop("_t")


#: Encodings of the residual: name, key columns and smoothing.
ENCODINGS = [
    ("source_port", ["sp"], 20.0), ("target_port", ["tp"], 20.0), ("family_pair", ["s_family", "t_family"], 12.0),
    ("source_port_target_family", ["sp", "t_family"], 24.0), ("source_family_target_port", ["s_family", "tp"], 24.0),
    ("source_port_direction", ["sp", "direction"], 18.0), ("target_port_direction", ["tp", "direction"], 18.0),
    ("family_pair_direction", ["s_family", "t_family", "direction"], 24.0), ("source_port_raw", ["sp", "raw_bucket"], 32.0), ("target_port_raw", ["tp", "raw_bucket"], 32.0),
]


def encodings(df: DataFrame, value: str, train: Column) -> DataFrame:
    """All ENCODINGS of ``value`` (columns sp, tp, s_family, t_family, direction, raw); all sums are of the same input."""
    marked = cut(df.withColumns({"raw_bucket": F.least(int_div(F.col("raw"), 64), F.lit(127)), "_t": train.cast("boolean")}))
    mean = marked.where("_t").agg(F.avg(value)).first()[0] or 0.0
    out = marked
    for name, key, smoothing in ENCODINGS:
        out = _encoded(out, _key_sums(marked, key, value), key, value, mean, smoothing, f"enc_{name}")
    return out.drop("raw_bucket", "_t")
