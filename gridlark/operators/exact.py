"""Exact delays: a relational search over frontier tables, and a kernel for large batches of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.scalar import crossing
from ..plans.arch import Arch
from ..plans.lineage import Table
from .estimate import KEYS, hops
from .kernel import Grid
from .potentials import Potentials

#: Up to so many targets of one source, each target's own lower bound says whether a state may go on; beyond, the farthest answer.
FEW_TARGETS = 16


def frontier_search(requests: DataFrame, arch: Arch, potentials: Potentials | None = None, relative: bool = False, margin: int | None = None, most_rounds: int = 200) -> DataFrame:
    """(KEYS, delay) of distinct pairs, delay null where the target can't be reached.

    Label-correcting: each round joins the frontier with macros and walks, keeps the least delay of
    each state, and goes on with states that got better and, by their lower bound, may still beat the
    best answer of a pair. Pairs of one source share one search; so labels are at most sources times
    the grid's states, however many pairs there are. relative: lines count once, straight from source
    to target. margin: only landings within so many cells of the pins' rectangle, which is each
    pair's own, and so is its search.
    """
    own = KEYS[:3] if margin is None else KEYS
    state = [*own, "x", "y", "internal_id"]
    gap = F.col("block_delay") if relative else F.col("block_delay") + F.col("line_delay")
    walks = arch.walks.select("from_x", "from_y", "net_id", "to_x", "to_y", gap.alias("gap"))
    # small, or fixed by the chip: written once, so that no round plans or makes them again
    fixed = [Table(df) for df in (walks, arch.macros, arch.terminals.withColumnRenamed("target_port", "tp"))]
    walks, macros, terminals = (t.df for t in fixed)

    def within(df: DataFrame) -> DataFrame:
        if margin is None:
            return df
        return df.where(F.col("x").between(F.least("sx", "tx") - margin, F.greatest("sx", "tx") + margin) & F.col("y").between(F.least("sy", "ty") - margin, F.greatest("sy", "ty") + margin))

    same_site = (F.col("sx") == F.col("tx")) & (F.col("sy") == F.col("ty"))
    arcs = arch.arcs.groupBy(F.col("from_port").alias("sp"), F.col("to_port").alias("tp")).agg(F.min("delay").alias("arc"))
    start = requests.select(*KEYS).distinct().join(F.broadcast(arcs), ["sp", "tp"], "left")
    best = Table(start.select(*KEYS, F.when(same_site & (F.col("sp") == F.col("tp")), 0).when(same_site, F.col("arc")).cast("long").alias("best")))
    first = best.df.select(*own).distinct().join(F.broadcast(arch.first_hops), F.col("sp") == F.col("source_port"))
    stay = first.where("net_id is null").select(*own, F.col("sx").alias("x"), F.col("sy").alias("y"), "internal_id", F.lit(0).cast("long").alias("g"))
    move = first.where("net_id is not null").join(walks, (F.col("sx") == F.col("from_x")) & (F.col("sy") == F.col("from_y")) & (first["net_id"] == walks["net_id"]))
    move = within(move.select(*own, F.col("to_x").alias("x"), F.col("to_y").alias("y"), "internal_id", (F.col("arc_delay") + F.col("gap")).cast("long").alias("g")))
    labels = Table(stay.unionByName(move).groupBy(*state).agg(F.min("g").alias("g")).withColumn("better", F.lit(True)))
    pot = None
    if potentials and not relative:
        fixed.append(Table(potentials.frame().withColumnRenamed("target_port", "tp")))
        pot = F.broadcast(fixed[-1].df)
    for _ in range(most_rounds):
        frontier = labels.df.where("better").drop("better")
        if margin is None:
            there = frontier.withColumns({"tx": F.col("x"), "ty": F.col("y")}).join(best.df.select(*KEYS), KEYS[:5])
        else:
            there = frontier.where("x = tx and y = ty")
        done = there.join(F.broadcast(terminals), ["tp", "internal_id"])
        done = done.groupBy(*KEYS).agg(F.min(F.col("g") + F.col("cost")).alias("new"))
        best.replace(best.df.join(done, KEYS, "left").select(*KEYS, F.least("best", "new").alias("best")))
        top = best.df.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.when(F.count("best") == F.count(F.lit(1)), F.max("best")).alias("top"))
        live = frontier.join(top, own).where("top is null or g < top")
        if pot is not None:
            few = live.where(F.col("n") <= FEW_TARGETS).select(*state, "g").join(best.df, own).join(pot, ["tp", "internal_id"])
            h = F.greatest(*potentials.components(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("pot")))
            few = few.where(F.col("best").isNull() | (F.col("g") + h < F.col("best"))).select(*state, "g").distinct()
            live = live.where(F.col("n") > FEW_TARGETS).select(*state, "g").unionByName(few)
        step = live.join(F.broadcast(macros), F.col("internal_id") == F.col("from_internal"))
        step = step.join(walks, (F.col("x") == F.col("from_x")) & (F.col("y") == F.col("from_y")) & (macros["net_id"] == walks["net_id"]))
        step = step.select(*own, F.col("to_x").alias("x"), F.col("to_y").alias("y"), F.col("to_internal").alias("internal_id"), (F.col("g") + F.col("arc_delay") + F.col("gap")).alias("g"))
        both = labels.df.select(*state, "g", F.col("g").alias("old")).unionByName(within(step).withColumn("old", F.lit(None).cast("long")))
        both = both.groupBy(*state).agg(F.min("g").alias("g"), F.max("old").alias("old"))
        labels.replace(both.select(*state, "g", (F.col("old").isNull() | (F.col("g") < F.col("old"))).alias("better")))
        if labels.df.where("better").isEmpty():
            break
    else:
        raise RuntimeError(f"search did not end in {most_rounds} rounds")
    for t in (*fixed, labels):
        t.remove()
    out = best.df
    if relative:
        lines = crossing(F.col("sx"), F.col("tx"), arch.vertical)[0] + crossing(F.col("sy"), F.col("ty"), arch.horizontal)[0]
        same = same_site & (F.col("sp") == F.col("tp"))
        out = out.withColumn("best", F.when(same, F.col("best")).otherwise(F.col("best") + lines))
    return out.select(*KEYS, F.col("best").cast("int").alias("delay"))


def kernel_search(requests: DataFrame, arch: Arch, solver: str = "astar", potentials: Potentials | None = None, relative: bool = False, margin: int | str | None = None, paths: bool = False) -> DataFrame:
    """(KEYS, delay, path) of distinct pairs by one search each, spread over all tasks.

    solver: astar, dijkstra (both ends) or verify, which runs both and fails on a difference. The
    grid's arrays are sized by the chip and go to each executor once.
    """
    if solver == "astar" and (relative or margin is not None):
        raise ValueError("margin and relative need the dijkstra solver")
    ship(requests.sparkSession)
    potentials = potentials or (Potentials(arch) if solver != "dijkstra" else None)
    grid = requests.sparkSession.sparkContext.broadcast(Grid(arch, *((potentials.scalar, potentials.table) if potentials else (None, None))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grid.value
        for batch in batches:
            delays, routes = [], []
            for sx, sy, sp, tx, ty, tp in zip(*(batch.column(c).to_pylist() for c in KEYS), strict=True):
                s, t = int(g.site[sy, sx]), int(g.site[ty, tx])
                if solver == "dijkstra" and not paths:
                    d, pins = g.both_ways(s, sp, t, tp, relative, margin), []
                else:
                    d, pins = g.shortest(s, sp, t, tp, relative, margin, solver != "dijkstra")
                if solver == "verify" and d != (other := g.both_ways(s, sp, t, tp, relative, margin)):
                    raise RuntimeError(f"solvers differ: {d} and {other} for {(sx, sy, sp, tx, ty, tp)}")
                delays.append(d)
                routes.append(" | ".join(f"SRB_{g.x[a]}_{g.y[a]}/{g.ports[p]}" for a, p in pins) if paths else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(delays, pa.int32()), pa.array(routes, pa.string())], [*KEYS, "delay", "path"])

    pairs = requests.select(*[F.col(c).cast("int").alias(c) for c in KEYS]).distinct()
    return pairs.mapInArrow(run, ", ".join(f"{c} int" for c in KEYS) + ", delay int, path string")
