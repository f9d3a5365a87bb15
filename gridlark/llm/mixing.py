"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import saved, table

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From (source, source_size), one row a source: target, the share of all words by weight.

    Sources by code point, null last, weigh ``weights`` in turn. No target is above ``most`` times
    its source's size; what is cut off goes to the others by weight. Sorted by size over weight, the
    first i sources are full and the rest share what is left at one rate, the first that fills none.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("full", F.lit(float(most)) * F.col("source_size"))
    everything = W.partitionBy()
    by_need = W.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    after = by_need.rowsBetween(W.currentRow, W.unboundedFollowing)
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("rate", rate)
    fits = F.when(F.col("rate") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), F.col("rate").alias("rate")))
    ranked = ranked.withColumn("rate", F.min(fits).over(everything)["rate"])
    return ranked.select("source", "source_size", F.least(F.col("rate") * F.col("weight"), F.col("full")).alias("target"))


def mix(docs: DataFrame, size: str = "size", key: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, bucket_rows: int = 1000) -> DataFrame:
    """All columns of ``docs`` (``source`` and a word count among them) plus source_size, target, taken.

    Documents of a source are shuffled by md5 of the key. Pass e of a document finishes at the
    virtual time (e * source_size + words up to and with it) / target; passes are taken in that
    order over all sources until the next would exceed the total budget, all words. At most ``most``
    passes exist, so no document exceeds ``most`` times its size.

    Sums are two-level: by (source, bucket of the shuffle key), then within a bucket of about
    ``bucket_rows`` rows (65,536 buckets at most, which Spark sums in a sort that can spill), so a
    source of any share is spread. Null keys shuffle as the empty key,
    null sources are a source, empty documents take 0, and equal rows are ordered arbitrarily among
    themselves, which changes no row. Columns of the input named as a new column are replaced, and
    ``_key``, ``_bucket``, ``_sum`` and ``_upto`` are dropped. An empty table gives none.
    """
    docs = docs.drop("source_size", "target", "taken")
    n = docs.count()
    buckets = max(1, min(1 << 16, -(-n // bucket_rows)))
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    base = docs.withColumn("_key", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")))
    base = base.withColumn("_bucket", F.floor(at * buckets).cast("int"))
    cells = saved(base.groupBy("source", "_bucket").agg(F.sum(F.col(size)).alias("_cell")))
    goal = targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, most)
    order = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(order), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    cells = cells.alias("a").join(goal.alias("b"), same).select("a.source", "_bucket", "_before", "source_size", "target")
    cells = saved(cells)
    inner = W.partitionBy("source", "_bucket").orderBy("_key", key, size).rowsBetween(W.unboundedPreceding, 0)
    summed = base.withColumn("_sum", F.sum(size).over(inner)).alias("a").join(cells.alias("b"), same & (F.col("a._bucket") == F.col("b._bucket")))
    summed = summed.select("a.*", (F.col("b._before") + F.col("a._sum")).alias("_upto"), "b.source_size", "b.target")
    time = lambda e: (F.lit(e) * F.col("source_size") + F.col("_upto")).cast("double") / F.col("target")
    passes = F.array(*[F.struct(time(e).alias("t"), F.lit(e).alias("e")) for e in range(most)])
    live = (F.col(size) > 0) & (F.col("target") > 0)
    slots = summed.where(live).select("_key", F.col(size).alias("_w"), F.explode(passes).alias("p"))
    # cells in order of time, at most 12 * buckets of them: few passes are later than 2, but the stop may be there
    fold = F.when(F.col("p.t") <= 2, F.col("p.t")).otherwise(F.lit(3.0) - F.lit(2.0) / F.col("p.t"))
    slots = saved(slots.select("_key", "_w", "p.t", "p.e", F.floor(fold * (buckets * 4)).cast("long").alias("_f")))
    budget = cells.select("source", "source_size").distinct().agg(F.sum("source_size")).first()[0] or 0
    upto = W.orderBy("_f").rowsBetween(W.unboundedPreceding, 0)
    full = slots.groupBy("_f").agg(F.sum("_w").alias("_w")).withColumn("_all", F.sum("_w").over(upto))
    last = full.where(F.col("_all") > budget).orderBy("_f").first()
    if last is None:
        stop = None
    else:
        within = W.partitionBy("_f").orderBy("t", "_key", "e").rowsBetween(W.unboundedPreceding, 0)
        edge = slots.where(F.col("_f") == last["_f"]).withColumn("_all", F.sum("_w").over(within) + (last["_all"] - last["_w"]))
        stop = edge.where(F.col("_all") > budget).orderBy("t", "_key", "e").first()
    taken = F.lit(0)
    for e in range(most):
        early = F.lit(True) if stop is None else F.struct(time(e), F.col("_key"), F.lit(e)) < F.struct(F.lit(stop["t"]), F.lit(stop["_key"]), F.lit(stop["e"]))
        taken = taken + F.when(live & early, 1).otherwise(0)
    return summed.withColumn("taken", (taken * F.col(size)).cast("long")).drop("_key", "_bucket", "_sum", "_upto")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as its words were taken, with the columns of ``docs``."""
    whole = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    taken = mix(whole).select("row", copies.alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(saved(docs)).select("doc_id", "size", "source_size", "target", "taken")


#: One query in DuckDB's SQL. The shuffle is by md5 of the id; targets are filled up to their limit in turn.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS f,
  CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(f) OVER (ORDER BY f / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY f / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, least(w * (SELECT arg_min(rate, f / w) FROM r WHERE rate * w <= f), f) AS target FROM r),
c AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT c.k, c.size, e, (e * source_size + u)::DOUBLE / target AS v FROM c, (VALUES (0), (1), (2)) x(e) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY v, k, e ROWS UNBOUNDED PRECEDING) AS a FROM p),
n AS (SELECT k, count(*) AS m FROM o WHERE a <= (SELECT sum(size) FROM d) GROUP BY k)
SELECT doc_id, c.size, source_size, target, (coalesce(m, 0) * c.size)::BIGINT AS taken FROM c LEFT JOIN n USING (k)
"""
