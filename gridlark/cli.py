"""Command line: delays of a request file or of one pair."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import estimate, exact, features, gbm
from .operators.potentials import Potentials
from .operators.reuse import known_answers, once_for_each, with_known
from .plans.arch import Arch
from .sources import architecture, requests


def options(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gridlark")
    p.add_argument("-in", "--input", "-i", dest="input")
    p.add_argument("-out", "--output", "-o", dest="output")
    p.add_argument("--from", dest="source")
    p.add_argument("--to", dest="target")
    p.add_argument("--solver", choices=["fast", "astar", "dijkstra", "verify"], default="fast")
    p.add_argument("--path-output", "--path-out")
    p.add_argument("--feature-output")
    p.add_argument("--model-feature-output")
    p.add_argument("--generalization-model", dest="model")
    p.add_argument("--calibration", help="Parquet table (name, cell, q14)")
    p.add_argument("--ports", required=True)
    p.add_argument("--nets", required=True)
    p.add_argument("--arcs", required=True, help="CSV or Parquet table (from_port, to_port, delay), or text with {a, b, c} rows")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--margin")
    p.add_argument("--relative-gap-est", "--est", dest="relative", action="store_true")
    p.add_argument("--known", help="Parquet table (from, to, delay) of answers that go before any estimate")
    p.add_argument("--no-public-cache", action="store_true", help="don't look answers up in --known")
    p.add_argument("--workers", type=int, help="partitions that requests are dealt over")
    p.add_argument("--progress", type=int, default=0, help="seconds between lines on rows done; 0: none")
    p.add_argument("--permissive", action="store_true", help="set rows with errors aside instead of failing")
    o = p.parse_args(args)
    if bool(o.source) != bool(o.target):
        p.error("--from and --to go together")
    if bool(o.input) == bool(o.source):
        p.error("give an input file or one pair")
    if o.input and not o.output:
        p.error("an input file needs an output")
    if (o.margin is not None or o.relative) and o.solver != "dijkstra":
        p.error("--margin and --relative-gap-est need --solver dijkstra")
    if o.margin not in (None, "auto") and not o.margin.isdigit():
        p.error("--margin takes a number or auto")
    if o.feature_output and (o.solver != "fast" or o.model):
        p.error("--feature-output needs the fast solver without a model")
    if o.model_feature_output and not o.model:
        p.error("--model-feature-output needs --generalization-model")
    if o.path_output and o.solver == "fast":
        p.error("--path-output needs an exact solver")
    return o


def load_arch(spark: SparkSession, o: argparse.Namespace) -> Arch:
    if o.arcs.endswith(".csv"):
        arcs = spark.read.csv(o.arcs, header=True, schema="from_port int, to_port int, delay int").withColumn("arc_ord", F.monotonically_increasing_id())
    elif o.arcs.endswith(".parquet"):
        arcs = spark.read.parquet(o.arcs)
    else:
        arcs = architecture.arcs_from_text(spark, o.arcs)
    return architecture.load_chip(spark, o.ports, o.nets, arcs)


def solve(bound: DataFrame, arch: Arch, o: argparse.Namespace) -> DataFrame:
    """Bound requests with delay and what the outputs need."""
    spark = bound.sparkSession
    if o.solver != "fast":
        margin = None if o.margin is None else ("auto" if o.margin == "auto" else int(o.margin))
        return once_for_each(bound, estimate.KEYS, lambda pairs: exact.kernel_search(pairs, arch, o.solver, relative=o.relative, margin=margin, paths=bool(o.path_output or o.source)))
    potentials = Potentials(arch)

    def fast(pairs: DataFrame) -> DataFrame:
        est = estimate.raw_estimates(pairs, arch, potentials)
        if o.model:
            feats = features.features(est, arch)
            return gbm.predict(feats, gbm.read_model(spark, model_file(spark, o.model))).select(*estimate.KEYS, "features", F.col("prediction").alias("delay"))
        if o.calibration:
            return estimate.calibrated(est, spark.read.parquet(o.calibration)).withColumn("delay", F.col("calibrated"))
        return est.withColumn("delay", F.col("raw"))

    return once_for_each(bound, estimate.KEYS, fast)


def answered(bound: DataFrame, arch: Arch, o: argparse.Namespace) -> DataFrame:
    """Known answers first, then one solution for each other pair: by the model if there is one, else calibrated, else raw."""
    if not o.known or o.no_public_cache or o.solver != "fast" or o.feature_output or o.model_feature_output:
        return solve(bound, arch, o)
    known = known_answers(bound.sparkSession.read.parquet(o.known), arch.ports)
    return with_known(bound, known, lambda rest: solve(rest, arch, o))


def model_file(spark: SparkSession, name: str) -> str:
    """The file itself, or the first of that name in models/ and the working folder."""
    found = gbm.find_model(spark, name, ["", "models", "."] if not name.startswith("/") and "://" not in name else [""])
    if found is None:
        raise FileNotFoundError(name)
    return found


def main(args: list[str] | None = None) -> int:
    o = options(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.appName("gridlark").getOrCreate()
    arch = load_arch(spark, o)
    asked = requests.read_requests(spark, o.input, o.limit) if o.input else requests.single_request(spark, o.source, o.target)
    bound, rejected = requests.bind(asked, arch, strict=not o.permissive)
    if o.workers:
        bound = bound.repartition(o.workers)
    solved = answered(bound, arch, o)
    if o.source:
        print(sinks.single_line(solved if "path" in solved.columns else solved.withColumn("path", F.lit(None).cast("string")), paths=True))
        return 0
    solved, seen = sinks.run_report(solved)
    solved = solved.persist()
    with sinks.progress(spark, o.progress):
        sinks.write_results(solved, o.output)
    if o.path_output:
        sinks.write_paths(solved, o.path_output)
    if o.feature_output:
        sinks.write_search_features(solved, o.feature_output)
    if o.model_feature_output:
        sinks.write_model_features(solved, o.model_feature_output)
    if o.permissive:
        rejected.write.mode("overwrite").option("header", True).csv(f"{o.output.rstrip('/')}_rejected")
    print(seen.get, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
