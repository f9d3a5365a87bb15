"""Answers computed once for equal pairs, and answers known from a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_for_each(requests: DataFrame, keys: list[str], solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``requests`` with the columns that ``solve`` gives for distinct keys; repeated blocks cost a join, not a search."""
    return requests.join(solve(requests.select(*keys).distinct()), keys, "left")


def known_answers(table: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """(from, to, delay) fit for lookups; raises on repeated pairs, unknown ports and delays outside 16 bits."""
    one = table.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"), F.min("delay").alias("delay"))
    bad = F.when(F.col("n") > 1, "repeated pair ").when((F.col("delay") < 0) | (F.col("delay") > 65535), "delay out of range ")
    if ports is not None:
        for side in ("from", "to"):
            names = F.broadcast(ports.select(F.regexp_replace("name", "^", "").alias(f"_{side}")))
            one = one.withColumn("_n", F.regexp_extract(side, r"^[^/]*/([\s\S]+)$", 1)).join(names, F.col("_n") == F.col(f"_{side}"), "left").drop("_n")
            bad = bad.when(F.col(f"_{side}").isNull(), "unknown port ") if side == "from" else F.coalesce(bad, F.when(F.col(f"_{side}").isNull(), "unknown port "))
    delay = F.when(bad.isNull(), F.col("delay")).otherwise(F.raise_error(F.concat(bad, "from", F.lit(","), "to")).cast("int"))
    return one.select("from", "to", delay.alias("delay"))


def with_known(requests: DataFrame, answers: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """delay from the table where it has the pair, by its text, else from ``solve``."""
    joined = requests.join(answers.select("from", "to", F.col("delay").alias("_known")), ["from", "to"], "left")
    rest = solve(joined.where("_known is null").drop("_known"))
    found = joined.where("_known is not null").withColumnRenamed("_known", "delay")
    return found.unionByName(rest.select(*found.columns))


def repeated(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that come more than once, and how often."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
