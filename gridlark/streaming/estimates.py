"""Requests as a stream of files, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.requests import split_pair


def request_stream(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """(from, to) of all lines of the text files of a folder as they arrive; headers and short rows are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    a, b = split_pair(F.col("value"))
    return lines.select(a.alias("from"), b.alias("to")).where("from <> '' and to <> '' and not (from = 'From' and to = 'To')")


def answer_stream(stream: DataFrame, solve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: tuple[str, ...] = ("from", "to")) -> StreamingQuery:
    """Each batch solves its distinct pairs once and joins them back; a batch is written whole under its number.

    Run again after a failure, a batch overwrites its own folder, so each is there once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        solved = solve(batch.select(*keys).distinct())
        batch.join(solved, list(keys), "left").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
