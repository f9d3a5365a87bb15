"""Directional potentials: lower bounds of the delay from an internal port to a target port."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.arch import Arch


def variants(arch: Arch) -> DataFrame:
    """(net_id, dx, dy, cost): the least delay of each displacement that a net really makes."""
    w = arch.walks
    moved = w.select("net_id", (F.col("to_x") - F.col("from_x")).alias("dx"), (F.col("to_y") - F.col("from_y")).alias("dy"), (F.col("block_delay") + F.col("line_delay")).alias("cost"))
    return moved.groupBy("net_id", "dx", "dy").agg(F.min("cost").alias("cost"))


def relaxed(arch: Arch, of_nets: DataFrame) -> DataFrame:
    """(a, b, dx, dy, cost): macros with any displacement of their net, wherever they start."""
    m = arch.macros.join(F.broadcast(of_nets), "net_id")
    return m.select(F.col("from_internal").alias("a"), F.col("to_internal").alias("b"), "dx", "dy", (F.col("arc_delay") + F.col("cost")).alias("cost"))


def directions() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("direction"), F.lit(x).alias("ux"), F.lit(y).alias("uy")) for i, (x, y) in enumerate(fixed.DIRECTIONS)]))


def scalars(edges: DataFrame) -> DataFrame:
    """(direction, scalar): the least delay for a step forward, in 1 / SCALE; 0 where nothing goes that way."""
    spread = edges.withColumn("u", directions()).select("u.*", "dx", "dy", "cost").withColumn("forward", F.col("ux") * F.col("dx") + F.col("uy") * F.col("dy"))
    found = spread.where("forward > 0").groupBy("direction").agg(F.min(F.floor(fixed.SCALE * F.col("cost") / F.col("forward"))).cast("long").alias("scalar"))
    every = edges.sparkSession.range(len(fixed.DIRECTIONS)).select(F.col("id").cast("int").alias("direction"))
    return every.join(found, "direction", "left").select("direction", F.coalesce("scalar", F.lit(0)).cast("long").alias("scalar"))


def reduced(edges: DataFrame, scalar: DataFrame) -> DataFrame:
    """(direction, a, b, weight): what an edge costs beyond its progress; raises where that is negative."""
    e = edges.withColumn("u", directions()).select("u.*", "a", "b", "dx", "dy", "cost").join(F.broadcast(scalar), "direction")
    weight = fixed.SCALE * F.col("cost") - F.col("scalar") * (F.col("ux") * F.col("dx") + F.col("uy") * F.col("dy"))
    low = e.select("direction", "a", "b", weight.alias("weight")).groupBy("direction", "a", "b").agg(F.min("weight").alias("weight"))
    return low.withColumn("weight", F.when(F.col("weight") < 0, F.raise_error(F.lit("negative reduced edge")).cast("long")).otherwise(F.col("weight")))


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(direction, a, b, d): all-pairs least sums of (direction, a, b, weight), by squaring under min and plus.

    Every node reaches itself for 0. Each round joins the distances with themselves and keeps minima,
    until nothing changes; the tables have at most directions x nodes ** 2 rows.
    """
    nodes = edges.select("direction", F.col("a").alias("n")).unionByName(edges.select("direction", F.col("b").alias("n"))).distinct()
    d = edges.select("direction", "a", "b", F.col("weight").alias("d")).unionByName(nodes.select("direction", F.col("n").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("d")))
    d = d.groupBy("direction", "a", "b").agg(F.min("d").alias("d"))
    last = None
    for _ in range(rounds):
        left, right = d.select("direction", "a", F.col("b").alias("m"), F.col("d").alias("d1")), d.select("direction", F.col("a").alias("m"), "b", F.col("d").alias("d2"))
        d = left.join(right, ["direction", "m"]).groupBy("direction", "a", "b").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))
        d = d.persist()
        now = d.agg(F.count(F.lit(1)), F.sum("d")).first()
        if now == last:
            break
        last = now
    return d


def closure_matrix(n: int, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """The same for one direction on the driver, for graphs of a chip's internal ports; unreachable is the largest integer."""
    far = np.iinfo(np.int64).max // 4
    d = np.full((n, n), far)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return np.where(d >= far, np.iinfo(np.int64).max, d)


class Potentials:
    """scalar of each direction and table [direction, target port, internal] (-1: unreachable), small arrays on the driver."""

    def __init__(self, arch: Arch):
        edges = relaxed(arch, variants(arch)).groupBy("a", "b", "dx", "dy").agg(F.min("cost").alias("cost")).persist()
        scalar = scalars(edges)
        self.scalar = np.array([r["scalar"] for r in scalar.orderBy("direction").collect()], np.int64)
        n, ports = len(arch.internal), len(arch.port_list)
        low = reduced(edges, scalar).toPandas()
        terminal = np.full((ports, n), np.iinfo(np.int64).max)
        for r in arch.terminals.collect():
            terminal[r["target_port"], r["internal_id"]] = r["cost"] * fixed.SCALE
        self.table = np.full((len(fixed.DIRECTIONS), ports, n), -1, np.int64)
        top = np.iinfo(np.int64).max
        for i in range(len(fixed.DIRECTIONS)):
            part = low[low["direction"] == i]
            d = closure_matrix(n, list(zip(part["a"], part["b"], part["weight"], strict=True)))
            for p in range(ports):
                to = np.flatnonzero(terminal[p] < top)
                if not len(to):
                    continue
                via = np.where(d[:, to] == top, top, d[:, to] + np.where(d[:, to] == top, 0, terminal[p, to][None, :]))
                best = via.min(1)
                self.table[i, p] = np.where(best == top, -1, best)
        edges.unpersist()
        self.spark = arch.spark

    def frame(self) -> DataFrame:
        """(target_port, internal_id, pot array<long> by direction; null: unreachable)."""
        d, p, n = self.table.shape
        rows = [(i, j, [None if v < 0 else int(v) for v in self.table[:, i, j]]) for i in range(p) for j in range(n)]
        return self.spark.createDataFrame(rows, "target_port int, internal_id int, pot array<long>")

    def components(self, dx: Column, dy: Column, pot: Column) -> list[Column]:
        """The lower bound of each direction; an unreachable target counts 0."""
        out = []
        for i, (ux, uy) in enumerate(fixed.DIRECTIONS):
            s = int(self.scalar[i])
            n = F.lit(s * ux) * dx + F.lit(s * uy) * dy + F.get(pot, i)
            out.append(F.coalesce(F.when(n > 0, F.floor((n + fixed.SCALE - 1) / fixed.SCALE)), F.lit(0)).cast("long"))
        return out
