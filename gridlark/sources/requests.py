"""Request files and pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalar import on_block, trim_ascii
from ..plans.arch import Arch

REQUESTS = "row_id long, from string, to string"


def split_pair(line: Column) -> tuple[Column, Column]:
    """The first two comma-separated cells of a line, without quoting; null where there are not two."""
    cells = F.split(line, ",", 3)
    return trim_ascii(F.get(cells, 0)), trim_ascii(F.get(cells, 1))


def read_requests(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """row_id, from, to, error of a request file with the header From,To; further columns are ignored.

    Empty lines are skipped and don't count. error is set for rows of fewer than two cells or with an
    empty one. The row number is the line's order in the file: its place in its partition, which
    monotonically_increasing_id tells, after the lines of the partitions before, which are counted.
    """
    lines = spark.read.text(path, lineSep="\n").where("value <> '' and value <> '\r'").select("value", F.monotonically_increasing_id().alias("_id"))
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = spark.createDataFrame([(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)], "_part int, _before long")
    numbered = lines.withColumn("_part", part).join(F.broadcast(before), "_part").select("value", (F.col("_before") + place).alias("row_id"))
    a, b = split_pair(F.col("value"))
    rows = numbered.select("row_id", a.alias("from"), b.alias("to"))
    head = rows.where("row_id = 0").first()
    if head is None or (head["from"], head["to"]) != ("From", "To"):
        raise ValueError(f"{path}: the first line must be From,To")
    rows = rows.where("row_id > 0").withColumn("row_id", F.col("row_id") - 1)
    if limit:
        rows = rows.where(F.col("row_id") < limit)
    bad = F.coalesce(F.col("from"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("to"), F.lit("")).eqNullSafe("")
    return rows.withColumn("error", F.when(bad, F.lit("a row needs two cells")))


def single_request(spark: SparkSession, source: str, target: str) -> DataFrame:
    return spark.createDataFrame([(0, source, target, None)], REQUESTS + ", error string")


def format_pin(x: Column, y: Column, name: Column) -> Column:
    return F.format_string("SRB_%d_%d/%s", x, y, name)


def parse_pins(df: DataFrame, arch: Arch, columns: dict[str, str]) -> DataFrame:
    """For each text column c: c_x, c_y, c_port (id) and c_error, null where the pin is right.

    ``columns`` maps text columns to prefixes. Checks come in this order: the prefix, both
    separators and a port name, whole numbers, the array's edge, a block's cell, the port's name.
    """
    names = F.broadcast(arch.ports.select("name", "port_id"))
    for text, to in columns.items():
        c = F.coalesce(F.col(text), F.lit(""))
        part = [F.regexp_extract(c, r"^SRB_([^_]*)_([^/]*)/([\s\S]+)$", k) for k in (1, 2, 3)]
        x, y = part[0].try_cast("int"), part[1].try_cast("int")
        df = df.withColumns({f"{to}_x": x, f"{to}_y": y, "_name": part[2]})
        df = df.join(names.withColumnsRenamed({"name": "_name", "port_id": f"{to}_port"}), "_name", "left")
        x, y = F.col(f"{to}_x"), F.col(f"{to}_y")
        error = (
            F.when(~c.startswith("SRB_"), "bad prefix")
            .when(F.col("_name") == "", "malformed pin")
            .when(x.isNull() | y.isNull(), "bad coordinate")
            .when((x < 0) | (x >= arch.width) | (y < 0) | (y >= arch.height), "outside the array")
            .when(on_block(x, y, arch.block_list), "on a block")
            .when(F.col(f"{to}_port").isNull(), "unknown port")
        )
        df = df.withColumn(f"{to}_error", error).drop("_name")
    return df


def bind(requests: DataFrame, arch: Arch, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(bound, rejected): bound has row_id, from, to, sx, sy, sp, tx, ty, tp; strict raises at the first error.

    In strict mode the check is part of the plan, so nothing is read twice, and rejected is empty.
    """
    parsed = parse_pins(requests, arch, {"from": "s", "to": "t"})
    error = F.coalesce(F.col("error") if "error" in requests.columns else F.lit(None).cast("string"), F.concat(F.lit("From: "), "s_error"), F.concat(F.lit("To: "), "t_error"))
    parsed = parsed.withColumn("error", error)
    cols = ["row_id", "from", "to", F.col("s_x").alias("sx"), F.col("s_y").alias("sy"), F.col("s_port").alias("sp"), F.col("t_x").alias("tx"), F.col("t_y").alias("ty"), F.col("t_port").alias("tp")]
    rejected = parsed.where("error is not null").select("row_id", "from", "to", "error")
    if strict:
        said = F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(": "), F.col("error"))
        checked = parsed.withColumn("row_id", F.when(F.col("error").isNotNull(), F.raise_error(said).cast("long")).otherwise(F.col("row_id")))
        return checked.select(*cols), rejected.limit(0)
    return parsed.where("error is null").select(*cols), rejected


def read_search_features(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """``requests`` (row_id, ...) with the search features of a file that write_search_features() made, row by row.

    -1 stands for unreachable and is read as null; raises where the numbers of rows differ.
    """
    schema = ", ".join(f"`{c}` int" for c in fixed.SEARCH_COLUMNS)
    found = spark.read.csv(path, header=True, schema=schema).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in found.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows = requests.count()
    if sum(n for _, n in counts) != rows:
        raise ValueError(f"{path}: {sum(n for _, n in counts)} rows of features for {rows} requests")
    before = spark.createDataFrame([(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)], "_part int, _before long")
    numbered = found.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("row_id", F.col("_before") + place)
    return requests.join(numbered.select("row_id", *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in fixed.SEARCH_COLUMNS]), "row_id")


def read_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """row, golden and p0, p1, ... of several holdout tables (row, golden, prediction); raises where rows or goldens differ."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.parquet(path).select("row", F.col("golden").alias(f"_g{i}"), F.col("prediction").alias(f"p{i}"))
        out = one if out is None else out.join(one, "row", "full")
    same = F.col("_g0").isNotNull()
    for i in range(1, len(paths)):
        same = same & F.col(f"_g{i}").eqNullSafe(F.col("_g0"))
    wrong = F.raise_error(F.concat(F.lit("predictions differ in row "), F.col("row").cast("string"))).cast("int")
    return out.select("row", F.when(same, F.col("_g0")).otherwise(wrong).alias("golden"), *[f"p{i}" for i in range(len(paths))])
