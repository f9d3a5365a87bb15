"""Accuracy reports, error quantiles, folds and model blends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import point_score
from ..plans.lineage import cut


def zipped(golden: DataFrame, estimate: DataFrame, keys: tuple[str, ...] = ("from", "to"), value: str = "delay") -> DataFrame:
    """Rows of two results side by side by row_id; raises where a row is missing or its keys differ."""
    g = golden.select("row_id", *[F.col(k).alias(f"g_{k}") for k in keys], F.col(value).alias("golden"))
    e = estimate.select("row_id", *[F.col(k).alias(f"e_{k}") for k in keys], F.col(value).alias("estimate"))
    both = g.join(e, "row_id", "full")
    same = F.col("golden").isNotNull() & F.col("estimate").isNotNull()
    for k in keys:
        same = same & F.col(f"g_{k}").eqNullSafe(F.col(f"e_{k}"))
    wrong = F.raise_error(F.concat(F.lit("results differ in row "), F.col("row_id").cast("string"))).cast("int")
    return both.select("row_id", *[F.col(f"g_{k}").alias(k) for k in keys], F.when(same, F.col("golden")).otherwise(wrong).alias("golden"), "estimate")


def relative_error(golden: Column, estimate: Column, zero: str = "one") -> Column:
    """Of the three in use: a golden 0 counts 1 unless exact (one), is left out (skip), or divides by 1 (floor)."""
    plain = F.abs(estimate - golden)
    if zero == "one":
        return F.when(golden == 0, (estimate != 0).cast("double")).otherwise(plain / F.when(golden != 0, golden))
    if zero == "skip":
        return F.when(golden != 0, plain / F.when(golden != 0, golden))
    return plain / F.greatest(golden, F.lit(1))


def report(df: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """rows, score (0 to 100), the three MAPEs in percent, mean absolute error, and exact, under and over counts."""
    g, e = F.col("golden"), F.col("estimate")
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), (100 * F.avg(point_score(g, e))).alias("score"),
        *[(100 * F.avg(relative_error(g, e, z))).alias(f"mape_{z}") for z in ("one", "skip", "floor")], F.avg(F.abs(e - g)).alias("mae"),
        F.sum((e == g).cast("long")).alias("exact"), F.sum((e < g).cast("long")).alias("under"), F.sum((e > g).cast("long")).alias("over"),
    )


def error_quantiles(df: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated quantiles of the relative error in percent: null for no rows.

    Errors are range-partitioned and counted by partition; only the partitions that hold a wanted
    rank, at most two for each quantile, are ranked, so no task sorts all of them.
    """
    e = df.select((100 * relative_error(F.col("golden"), F.col("estimate"), "skip")).alias("e")).where("e is not null")
    e = cut(e.repartitionByRange("e").withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["n"]) for r in e.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    total = sum(n for _, n in counts)
    spots = [(total - 1) * q for q in at]
    wanted = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))}) if total else []
    local, before = [], 0
    for part, n in counts:
        local += [(part, r - before + 1, r) for r in wanted if before <= r < before + n]
        before += n
    value = {}
    if local:
        pick = F.broadcast(df.sparkSession.createDataFrame(local, "part int, rn int, rank long"))
        ranked = e.where(F.col("part").isin(sorted({x[0] for x in local}))).withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy("e")))
        value = {r["rank"]: r["e"] for r in ranked.join(pick, ["part", "rn"]).collect()}  # eight rows at most
    out = [value[math.floor(s)] + (value[math.ceil(s)] - value[math.floor(s)]) * (s - math.floor(s)) if total else None for s in spots]
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"p{str(x)[2:]:0<2} double" for x in at))


def blends(df: DataFrame, models: list[str]) -> DataFrame:
    """``df`` with mean, geometric mean and median of several predictions, rounded half to even."""
    cols = [F.col(m).cast("double") for m in models]
    n = len(cols)
    mean = sum(cols[1:], cols[0]) / n
    logs = [F.ln(F.greatest(c, F.lit(1.0))) for c in cols]
    middle = F.array_sort(F.array(*cols))
    median = (F.get(middle, F.lit((n - 1) // 2)) + F.get(middle, F.lit(n // 2))) / 2
    return df.withColumns({"blend_mean": F.rint(mean), "blend_geo": F.rint(F.exp(sum(logs[1:], logs[0]) / n)), "blend_median": F.rint(median)})


def checkpoints(df: DataFrame, sums: list[str], base: str = "base") -> DataFrame:
    """Reports of predictions from the first trees only: ``sums`` are residual columns at several tree counts."""
    out = None
    for s in sums:
        p = df.withColumn("estimate", F.greatest(F.lit(0.0), F.rint(F.col(base) * F.exp(F.col(s)))))
        one = report(p).withColumn("checkpoint", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def prefix_split(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(validation, training): the first n rows by row_id and the rest."""
    return df.where(F.col("row_id") < n), df.where(F.col("row_id") >= n)
