"""Architecture files: JSON tables, and port names and arcs from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.arch import Arch, chip


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """port_id, name, direction of a file {"Port": [{"Name", "Direction"}]}, in file order."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.posexplode("Port").alias("port_id", "p")).select("port_id", F.col("p.Name").alias("name"), F.col("p.Direction").alias("direction"))


def read_nets(spark: SparkSession, path: str) -> DataFrame:
    """net_id, from_name, to_name, dx, dy of a file {"Nets": [{"from", "to", "delta x", "delta y"}]}."""
    raw = spark.read.option("multiLine", True).json(path)
    n = raw.select(F.posexplode("Nets").alias("net_id", "n"))
    return n.select("net_id", F.col("n.from").alias("from_name"), F.col("n.to").alias("to_name"), F.col("n")["delta x"].cast("int").alias("dx"), F.col("n")["delta y"].cast("int").alias("dy"))


def read_gaps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks) of a file {"Gap": {"Line": [...], "Block": [...]}}; lines of each axis by site."""
    raw = spark.read.option("multiLine", True).json(path)
    line = raw.select(F.explode("Gap.Line").alias("l")).select(F.when(F.col("l.direction") == "vertical", "x").otherwise("y").alias("axis"), F.col("l.site").cast("int").alias("site"), F.col("l.delay").cast("int").alias("delay"))
    lines = line.withColumn("ord", F.row_number().over(W.partitionBy("axis").orderBy("site")) - 1)
    b = F.col("b")
    block = raw.select(F.explode("Gap.Block").alias("b")).select(
        b["id"].cast("int").alias("block_id"), *[b[c].cast("int").alias(c) for c in ("lower", "upper", "left", "right")], b["vertical crossable"].alias("v_cross"),
        b["vertical cross delay"].cast("int").alias("v_delay"), b["horizontal crossable"].alias("h_cross"), b["horizontal cross delay"].cast("int").alias("h_delay"),
    )
    return lines.select("axis", "ord", "site", "delay"), block


def names_from_text(spark: SparkSession, path: str, start: str = "kPortNames", expected: int | None = None) -> DataFrame:
    """port_id, name: the quoted strings of a text file after ``start``, up to the first closing brace line."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", start + r"[^{]*\{\{?([^}]*)\}", 1).alias("v"))
    found = body.select(F.posexplode(F.regexp_extract_all("v", F.lit('"([^"]+)"'), F.lit(1))).alias("port_id", "name"))
    if expected is not None and (n := found.select("name").distinct().count()) != expected:
        raise ValueError(f"{path}: {n} port names, not {expected}")
    return found


def arcs_from_text(spark: SparkSession, path: str, start: str = "kArcs") -> DataFrame:
    """arc_ord, from_port, to_port, delay: the {a, b, c} rows of a text file after ``start``."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", start + r"[^=]*=\s*\{\{?((?:\s*\{[^}]*\},?)*)", 1).alias("v"))
    rows = body.select(F.posexplode(F.regexp_extract_all("v", F.lit(r"\{([^}]*)\}"), F.lit(1))).alias("arc_ord", "r"))
    cell = F.split("r", r"\s*,\s*")
    return rows.select("arc_ord", *[F.trim(F.get(cell, i)).cast("int").alias(n) for i, n in enumerate(("from_port", "to_port", "delay"))])


def load_chip(spark: SparkSession, ports_json: str, nets_json: str, arcs: DataFrame) -> Arch:
    """The full grid from its files. The tables are of the chip's size (hundreds of ports, thousands of arcs)."""
    ports = [(r["name"], r["direction"]) for r in read_ports(spark, ports_json).orderBy("port_id").collect()]
    at = {n: i for i, (n, _) in enumerate(ports)}
    nets = [(at[r["from_name"]], at[r["to_name"]], r["dx"], r["dy"]) for r in read_nets(spark, nets_json).orderBy("net_id").collect()]
    arc_rows = [(r["from_port"], r["to_port"], r["delay"]) for r in arcs.orderBy("arc_ord").collect()]
    return chip(spark, ports, arc_rows, nets)
