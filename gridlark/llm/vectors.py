"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, forest, groups
from .store import freed, removed, saved, saved_at, table

#: Share of pairs at exactly the wanted cosine that must be found.
RECALL = 0.99
#: Width of the cells of the outer projections, in standard deviations of a projection.
CELL = 2.25
#: Projections whose collisions are counted, and half the width of the window around the query.
COUNTED, HALF = 16, 0.75
#: Rows of a cell's block, and of a random cell.
BLOCK, CELL_ROWS = 1024, 1000
SEED = 11


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _shared_cell(sd: float) -> float:
    """The chance of two values whose difference is normal to be in one cell of a randomly shifted grid."""
    steps = [(i + 0.5) / 2000 * CELL for i in range(2000)]
    return sum((1 - d / CELL) * 2 * math.exp(-((d / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi)) for d in steps) * CELL / 2000


def plan(n: int, cosine: float) -> tuple[int, int, int]:
    """(projections of a cell, tables of cells, collisions that a pair must reach).

    Two unit vectors at this cosine differ in a projection by N(0, 2 - 2 cos). From that: the chance
    to share a cell, as many tables as the recall asks for, and the binomial count that nearly all
    such pairs reach. The number of projections of a cell follows the number of rows; for few rows
    there is one cell of no projection. Wide cells keep the tables few: 17 for a million rows, 70 for
    a thousand million.
    """
    sd = math.sqrt(max(1e-9, 2 - 2 * cosine))
    same, far = _shared_cell(sd), _shared_cell(math.sqrt(2))
    k = max(0, math.ceil(math.log(max(1, n) / CELL_ROWS) / -math.log(far)))
    p = 2 * _normal_cdf(HALF / sd) - 1
    least, tail = 0, 0.0
    while tail + math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least) < (1 - RECALL) / 2:
        tail += math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least)
        least += 1
    return k, math.ceil(math.log((1 - RECALL) / 2) / math.log(1 - same**k)) if k else 1, least


@cache
def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, seed, dim])).standard_normal((dim, n))


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r) for r in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed doubles scaled to a largest component of 1; null where they can't link."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
            ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
            out.append((x / np.abs(x).max() + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _cells(k: int, tables: int):
    """The cell of each vector in each table, packed as 32 bits; tables tell cells apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by_dim.setdefault(len(r) // 8, []).append(i)
            cells: list = [None] * len(raw)
            for dim, at in by_dim.items():
                shift = np.random.Generator(np.random.PCG64([SEED, 2])).uniform(0, CELL, k * tables)
                grid = np.floor((_units([raw[i] for i in at]) @ _directions(dim, k * tables, 1) + shift) / CELL).astype(np.int64).reshape(len(at), tables, k)
                h = np.full((len(at), tables), np.uint64(dim), np.uint64)
                for part in (np.arange(tables), *(grid[:, :, j] for j in range(k))):
                    h = (h ^ part.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                    h ^= h >> np.uint64(29)
                for i, c in zip(at, (h >> np.uint64(32)).astype(np.int32), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "packed", "cells"])

    return run


def _collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many projections each row of ``right`` is in the window around each row of ``left``.

    Each projection of ``right`` is sorted once; a query's window is the range of ranks that two
    binary searches give, and who is inside is told by ranks alone.
    """
    count = np.zeros((len(left), len(right)), np.int8)
    rank = np.empty(len(right), np.uint32)
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j], kind="stable")
        rank[order] = np.arange(len(right))
        line = right[order, j]
        first = np.searchsorted(line, left[:, j] - HALF, "left").astype(np.uint32)
        wide = np.searchsorted(line, left[:, j] + HALF, "right").astype(np.uint32) - first
        count += rank[None, :] - first[:, None] < wide[:, None]  # below the window wraps round to large numbers
    return count


def _tile(tile: pa.Table, cosine: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(nodes, weight of linked others, smallest linked node) of the pairs that this tile is the first to hold."""
    node, weight, block = (tile[c].to_numpy() for c in ("node", "w", "block"))
    t = tile["t"][0].as_py()
    cells = np.stack([np.frombuffer(c, np.int32) for c in tile["packed"].to_pylist()])
    x = _units(tile["v"].to_pylist())
    p = (x @ _directions(x.shape[1], COUNTED, 3)).astype(np.float32)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    alone = block.min() == block.max()
    found_a, found_b = [], []
    for lo in range(0, len(left), 256):
        a = left[lo : lo + 256]
        i, j = np.nonzero(_collisions(p[a], p[right]) >= least)
        i, j = a[i], right[j]
        if alone:
            i, j = i[node[i] < node[j]], j[node[i] < node[j]]
        for s in range(0, len(i), 1 << 17):
            ii, jj = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            near = np.einsum("ij,ij->i", x[ii], x[jj]) >= cosine
            ii, jj = ii[near], jj[near]
            new = ~(cells[ii, :t] == cells[jj, :t]).any(1) if t else np.ones(len(ii), bool)
            found_a.append(ii[new])
            found_b.append(jj[new])
    if not found_a:
        return None
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    links = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
    by_node = np.argsort(node, kind="stable")
    at = np.empty(len(node), np.int64)
    at[by_node] = np.arange(len(node))
    low = node[by_node][forest(len(node), at[a], at[b])[at]]
    some = links > 0
    return node[some], links[some].astype(np.int64), low[some]


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Rows of one and the same direction (bit for bit, scaled to a largest component of 1) are a class
    that goes on as one row with a weight; classes are told apart by a number of their own. They are
    dealt into cells of a few projections in several tables, as counting all pairs is quadratic, and
    cells of over BLOCK rows into pairs of blocks. In a tile COUNTED further projections are sorted,
    windows around each query are searched in them and the collisions of each pair counted; pairs
    that reach the calibrated count are compared exactly. Both the tables and the count are set so
    that of pairs at exactly ``cosine`` RECALL are found; nearer ones are likelier. A pair counts in
    the first table whose cell it shares. Each tile gives one row a vector: its links and the
    smallest vector it reaches there, never its pairs.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, as
    do vectors of different lengths. Equal ids are rows of their own, ties need no rule; a null id has
    no part in component ids, and gets its component's or null. An empty table gives none. Other
    columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("e"))
    packed = ids.mapInArrow(_packed, "vec_id long, v binary").withColumn("h", F.unhex(F.sha2("v", 256)))
    packed = saved(packed)
    classes = packed.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("node"), "h", "v", "w"))
    n = classes.count()
    k, tables, least = plan(n, cosine)
    celled, at_celled = saved_at(classes.select("node", "v", "w").mapInArrow(_cells(k, tables), "node long, v binary, w long, packed binary, cells array<int>"))
    cell = lambda t, c: F.shiftleft(F.col(t).cast("long"), 32).bitwiseOR(F.col(c).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    sizes = celled.select(F.posexplode("cells").alias("t", "c")).groupBy(cell("t", "c").alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spots = celled.select("node", "v", "w", "packed", F.posexplode("cells").alias("t", "c")).withColumn("cell", cell("t", "c"))
    spots = spots.join(saved(sizes), "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    spots = spots.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    spots = spots.select(tile.alias("tile"), "t", "block", "node", "w", "v", "packed")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, n * tables // 16384))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches, "tile"):
            if len(tile) > 1 and (got := _tile(tile, cosine, least)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["node", "links", "low"])

    found = saved(spots.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(run, "node long, links long, low long"))
    removed(spark, at_celled)
    freed(spark)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    mine = packed.select("vec_id", "h")
    info = classes.select("node", "h", "w").join(links, "node", "left").join(comp, "node", "left")
    info = info.select("h", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    first = mine.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("least")).join(info, "h")
    first = first.groupBy("comp").agg(F.min("least").alias("component_id"))
    info = saved(info.join(first, "comp").select("h", "n_links", "component_id"))
    out = mine.join(info, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def brute_force(ids: list, vectors: list, cosine: float = 0.95) -> pd.DataFrame:
    """The same from all pairs, for small tables."""
    n = len(ids)
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vectors]
    up, links = list(range(n)), [0] * n

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    x = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good, strict=True)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(x[i]) == len(x[j]) and float(x[i] @ x[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j), key=lambda q: ids[q])] = min(top(i), top(j), key=lambda q: ids[q])
    comp = [ids[top(i)] for i in range(n)]
    return pd.DataFrame({"vec_id": ids, "n_links": links, "component_id": comp, "kept": [a == b for a, b in zip(ids, comp, strict=True)]})
