"""Result files. Rows come out in request order; -1 stands for unreachable only here."""

from __future__ import annotations

import contextlib
import sys
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def _csv(df: DataFrame, path: str, single: bool) -> None:
    """single: one part file, for results that one task can write; else sorted part files in order."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, single: bool = False) -> None:
    """From, To, delay by row_id."""
    rows = df.orderBy("row_id").select(F.col("from").alias("From"), F.col("to").alias("To"), F.coalesce(F.col("delay").cast("long"), F.lit(-1)).alias("delay"))
    _csv(rows, path, single)


def write_paths(df: DataFrame, path: str, single: bool = False) -> None:
    rows = df.orderBy("row_id").select(F.col("from").alias("From"), F.col("to").alias("To"), F.coalesce("delay", F.lit(-1)).alias("Min Delay"), F.col("path").alias("Path"))
    _csv(rows, path, single)


def write_search_features(df: DataFrame, path: str, single: bool = False) -> None:
    _csv(df.orderBy("row_id").select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in fixed.SEARCH_COLUMNS]), path, single)


def write_model_features(df: DataFrame, path: str, count: int = 105, single: bool = False) -> None:
    _csv(df.orderBy("row_id").select(*[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(count)]), path, single)


def write_calibration(tables: DataFrame, path: str) -> None:
    """Fixed-point tables (name, cell, q14); checked to fit 16 bits by calibrate.quantised."""
    tables.write.mode("overwrite").parquet(path)


def write_model(model, spark, path: str) -> None:  # noqa: ANN001
    """The four tables of a tree model under one folder."""
    for name, df in model.tables(spark).items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def write_sample(df: DataFrame, path: str, n: int) -> None:
    """The first n rows by row_id."""
    df.where(F.col("row_id") < n).orderBy("row_id").write.mode("overwrite").parquet(path)


def single_line(df: DataFrame, paths: bool = False) -> str:
    """The delay of one request, -1 if unreachable, and its path on a second line."""
    r = df.first()
    out = str(-1 if r["delay"] is None else r["delay"])
    return f"{out}\n{r['path']}" if paths and r["path"] else out


def run_report(df: DataFrame, name: str = "run"):  # noqa: ANN201
    """(df, observation): rows, unreachable rows and the largest delay, counted while the rows pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.col("delay").isNull().cast("long")).alias("unreachable"), F.max("delay").alias("longest")), seen


@contextlib.contextmanager
def progress(spark: SparkSession, every: float) -> Iterator[None]:
    """Every so many seconds a line on standard error: tasks done of the running stages. 0: none."""
    stop = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def say() -> None:
        while not stop.wait(every):
            found = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
            if found:
                print(f"progress: {sum(i.numCompletedTasks for i in found)} of {sum(i.numTasks for i in found)} tasks", file=sys.stderr, flush=True)

    thread = threading.Thread(target=say, daemon=True)
    if every > 0:
        thread.start()
    try:
        yield
    finally:
        stop.set()
        if every > 0:
            thread.join()
