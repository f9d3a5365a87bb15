"""The routing grid as tables: sites, ports, arcs, nets, walks and what is derived from them.

All but sites and walks are small, fixed by the chip and not by the requests, and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalar import on_block


@dataclass
class Arch:
    """ports (name, direction), arcs (from, to, delay) by port id, nets (from, to, dx, dy) by port id, lines (site, delay), blocks."""

    spark: SparkSession
    width: int
    height: int
    port_list: list[tuple[str, str]]
    arc_list: list[tuple[int, int, int]]
    net_list: list[tuple[int, int, int, int]]
    vertical: list[tuple[int, int]] = field(default_factory=list)
    horizontal: list[tuple[int, int]] = field(default_factory=list)
    block_list: list[tuple] = field(default_factory=list)

    @cached_property
    def internal(self) -> dict[int, int]:
        """Dense ids of the ports that nets lead to, by first appearance."""
        out: dict[int, int] = {}
        for _, to, _, _ in self.net_list:
            out.setdefault(to, len(out))
        return out

    @cached_property
    def ports(self) -> DataFrame:
        rows = [(i, n, d, self.internal.get(i)) for i, (n, d) in enumerate(self.port_list)]
        return self.spark.createDataFrame(rows, "port_id int, name string, direction string, internal_id int")

    @cached_property
    def arcs(self) -> DataFrame:
        rows = [(i, *a) for i, a in enumerate(self.arc_list)]
        return self.spark.createDataFrame(rows, "arc_ord int, from_port int, to_port int, delay int")

    @cached_property
    def nets(self) -> DataFrame:
        rows = [(i, *n) for i, n in enumerate(self.net_list)]
        return self.spark.createDataFrame(rows, "net_id int, from_port int, to_port int, dx int, dy int")

    @cached_property
    def lines(self) -> DataFrame:
        rows = [("x", i, s, d) for i, (s, d) in enumerate(self.vertical)] + [("y", i, s, d) for i, (s, d) in enumerate(self.horizontal)]
        return self.spark.createDataFrame(rows, "axis string, ord int, site int, delay int")

    @cached_property
    def blocks(self) -> DataFrame:
        rows = [(i, *b) for i, b in enumerate(self.block_list)]
        return self.spark.createDataFrame(rows, "block_id int, lower int, upper int, left int, right int, v_cross boolean, v_delay int, h_cross boolean, h_delay int")

    def _grid(self) -> DataFrame:
        cells = self.spark.range(self.width * self.height)
        return cells.select((F.col("id") % self.width).cast("int").alias("x"), F.floor(F.col("id") / self.width).cast("int").alias("y"))

    @cached_property
    def sites(self) -> DataFrame:
        """(site_id, x, y) of the rectangle without the blocks, numbered row by row."""
        kept = self._grid().where(~on_block(F.col("x"), F.col("y"), self.block_list))
        by_row = kept.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
        before = by_row.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        rank = F.row_number().over(W.partitionBy("y").orderBy("x")) - 1
        return kept.withColumn("r", rank).join(F.broadcast(before), "y").select((F.col("before") + F.col("r")).cast("int").alias("site_id"), "x", "y")

    @cached_property
    def prefix(self) -> DataFrame:
        """(axis, pos, delay): the delay of all lines below a coordinate."""
        ends = {"x": self.width, "y": self.height}
        pos = self.spark.createDataFrame([(a, p) for a, n in ends.items() for p in range(n)], "axis string, pos int")
        step = pos.join(F.broadcast(self.lines), ["axis"], "left").where("site is null or site < pos").groupBy("axis", "pos").agg(F.sum("delay").alias("delay"))
        return pos.join(step, ["axis", "pos"], "left").select("axis", "pos", F.coalesce("delay", F.lit(0)).cast("int").alias("delay"))

    def _ranked(self, along_x: bool) -> DataFrame:
        """Cells with their rank along an axis, counting only cells outside blocks that the axis jumps over, and the delay jumped so far."""
        jump = [b for b in self.block_list if (b[6] if along_x else b[4])]
        inside = on_block(F.col("x"), F.col("y"), jump)
        main, other = ("x", "y") if along_x else ("y", "x")
        passed = F.lit(0)
        for lower, upper, left, right, _, v_delay, _, h_delay in jump:
            if along_x:
                passed = passed + F.when((F.col("y").between(lower, upper)) & (F.col("x") >= left), h_delay).otherwise(0)
            else:
                passed = passed + F.when((F.col("x").between(left, right)) & (F.col("y") >= lower), v_delay).otherwise(0)
        order = W.partitionBy(other).orderBy(main)
        cells = self._grid().withColumn("inside", inside).withColumn("passed", passed)
        cells = cells.withColumn("rank", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
        return cells.where(~F.col("inside")).select("x", "y", "rank", "passed")

    @cached_property
    def walks(self) -> DataFrame:
        """(from_x, from_y, net_id, to_x, to_y, block_delay, line_delay): where each net leads from each site.

        A net moves along one axis by so many ranks. Ranks leave out blocks that it jumps, so one
        equi-join on the rank gives the landing. Landings on any block are absent.
        """
        out = None
        free = ~on_block(F.col("x"), F.col("y"), self.block_list)
        for along_x in (True, False):
            main, other, d, axis = ("x", "y", "dx", "x") if along_x else ("y", "x", "dy", "y")
            cells = self._ranked(along_x).where(free)
            nets = self.nets.where("dx <> 0" if along_x else "dx = 0").select("net_id", F.col(d).alias("d"))
            a = cells.select(F.col("x").alias("from_x"), F.col("y").alias("from_y"), "rank", F.col("passed").alias("p0")).crossJoin(F.broadcast(nets)).withColumn("rank", F.col("rank") + F.col("d"))
            b = cells.select(F.col("x").alias("to_x"), F.col("y").alias("to_y"), "rank", F.col("passed").alias("p1"))
            pre = self.prefix.where(F.col("axis") == axis)
            joined = a.join(b, (a["rank"] == b["rank"]) & (a[f"from_{other}"] == b[f"to_{other}"])).drop("rank")
            for end, name in (("from", "l0"), ("to", "l1")):
                joined = joined.join(F.broadcast(pre.select(F.col("pos").alias(f"{end}_{main}"), F.col("delay").alias(name))), f"{end}_{main}")
            part = joined.select("from_x", "from_y", "net_id", "to_x", "to_y", F.abs(F.col("p1") - F.col("p0")).alias("block_delay"), F.abs(F.col("l1") - F.col("l0")).alias("line_delay"))
            out = part if out is None else out.unionByName(part)
        return out

    def reverse_walks(self) -> DataFrame:
        """The same keyed by the landing; ranks map sites one to one, so each landing and net has one start."""
        return self.walks.select("to_x", "to_y", "net_id", "from_x", "from_y", "block_delay", "line_delay")

    @cached_property
    def macros(self) -> DataFrame:
        """(from_internal, to_internal, net_id, arc_delay): an arc and the net after it, from an internal port."""
        own = self.ports.where("internal_id is not null").select(F.col("port_id").alias("p"), "internal_id")
        a = self.arcs.join(own, F.col("from_port") == F.col("p")).select(F.col("internal_id").alias("from_internal"), F.col("to_port").alias("via"), F.col("delay").alias("arc_delay"), "arc_ord")
        n = self.nets.select("net_id", F.col("from_port").alias("via"), F.col("to_port").alias("p"))
        return a.join(n, "via").join(own, "p").select("from_internal", F.col("internal_id").alias("to_internal"), "net_id", "arc_delay")

    @cached_property
    def first_hops(self) -> DataFrame:
        """(source_port, ord, net_id, internal_id, arc_delay) of what may come first: staying, a net, an arc and a net."""
        nets_of: dict[int, list[int]] = {}
        for i, (a, _, _, _) in enumerate(self.net_list):
            nets_of.setdefault(a, []).append(i)
        arcs_of: dict[int, list[tuple[int, int]]] = {}
        for a, b, d in self.arc_list:
            arcs_of.setdefault(a, []).append((b, d))
        rows = []
        for p in range(len(self.port_list)):
            hops = [(None, self.internal[p], 0)] if p in self.internal else []
            hops += [(n, self.internal[self.net_list[n][1]], 0) for n in nets_of.get(p, [])]
            hops += [(n, self.internal[self.net_list[n][1]], d) for b, d in arcs_of.get(p, []) for n in nets_of.get(b, [])]
            rows += [(p, i, *h) for i, h in enumerate(hops)]
        return self.spark.createDataFrame(rows, "source_port int, ord int, net_id int, internal_id int, arc_delay int")

    @cached_property
    def terminals(self) -> DataFrame:
        """(internal_id, target_port, cost): at the target port already, or one arc away."""
        best: dict[tuple[int, int], int] = {(i, p): 0 for p, i in self.internal.items()}
        for a, b, d in self.arc_list:
            if a in self.internal:
                k = (self.internal[a], b)
                best[k] = min(best.get(k, d), d)
        return self.spark.createDataFrame([(*k, c) for k, c in best.items()], "internal_id int, target_port int, cost int")


def synthetic(spark: SparkSession, width: int = 12, height: int = 12, ports: int = 6, blocks: list[tuple] | None = None, steps: tuple[int, ...] = (1, 3)) -> Arch:
    """A small grid by rule: half the ports are entries, half exits; a net from every exit in turn of directions and steps."""
    half = ports // 2
    names = [(f"ZSEA[{i}]", "Output") for i in range(half)] + [(f"ISEA[{i}]", "Input") for i in range(ports - half)]
    moves = [(s * x, s * y) for s in steps for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    nets = [(i % half, half + i % (ports - half), dx, dy) for i, (dx, dy) in enumerate(moves)]
    arcs = [(half + i, j, 5 + (i * 7 + j * 3) % 16) for i in range(ports - half) for j in range(half)]
    arcs += [(half + i, half + (i + 1) % (ports - half), 9 + i) for i in range(ports - half)]
    lines_x, lines_y = [(3, 7), (8, 2)], [(5, 4)]
    return Arch(spark, width, height, names, arcs, nets, [v for v in lines_x if v[0] < width - 1], [h for h in lines_y if h[0] < height - 1], blocks or [])


def chip(spark: SparkSession, ports: list[tuple[str, str]], arcs: list[tuple[int, int, int]], nets: list[tuple[int, int, int, int]]) -> Arch:
    """The full grid; ports, arcs and nets come from the user's files (sources.architecture)."""
    return Arch(spark, fixed.WIDTH, fixed.HEIGHT, ports, arcs, nets, fixed.VERTICAL_LINES, fixed.HORIZONTAL_LINES, fixed.BLOCKS)
