"""Connected components by Spark joins, and sorted streams of groups for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import removed, saved_at


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node that is reachable) of every node of ``edges`` (a, b long, any direction).

    Alternating large-star and small-star steps (Kiveris et al., 2014): O(log n) rounds, each a few
    shuffles of edges, written between rounds. No node's links are gathered in one place: minima are
    aggregated before they are shuffled, and joins on a node of very many links are left to the
    splitting of skewed joins.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = saved_at(edges)
    sign = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    last = sign(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges, new_path = saved_at(small.where("a <> b").distinct())
        removed(spark, path)
        path, now = new_path, sign(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(tops)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of a stream that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        cuts = [0, *(np.flatnonzero(pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(k)]
        if held and held[-1].column(key)[-1] != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < len(k):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that is linked with each of n positions, through links a[i] - b[i]."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], m)
        np.minimum.at(low, low[b], m)
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
        if (low == before).all():
            break
    return low
