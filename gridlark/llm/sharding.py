"""Shards by balanced label propagation: linked documents move to their neighbours' shard under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import saved, table

#: A group of equal texts of over 1 / LARGE of all rows is one weighted node, so at most LARGE such groups exist.
LARGE = 4096


def _quotas(demand: list, load: dict[int, float], room: float, shards: int) -> dict[tuple[int, int], float]:
    """Share of each (from, to) demand that may move: swaps first, then into free room in proportion.

    ``demand`` has shards ** 2 rows at most. Less than a row is none.
    """
    want = {(r["src_label"], r["dst_label"]): float(r["w"]) for r in demand}
    grant = {(a, b): min(w, want.get((b, a), 0.0)) for (a, b), w in want.items()}
    for _ in range(shards):
        moved = {s: load.get(s, 0.0) + sum(g * ((b == s) - (a == s)) for (a, b), g in grant.items()) for s in range(shards)}
        for s in range(shards):
            left = {k: want[k] - grant[k] for k in want if k[1] == s and want[k] > grant[k]}
            free, total = room - moved[s], sum(left.values())
            if free > 0 and total > 0:
                for k, w in left.items():
                    grant[k] += w * min(1.0, free / total)
    return {k: grant[k] / w if grant[k] >= 1 else 0.0 for k, w in want.items() if w > 0}


def propagate(nodes: DataFrame, shards: int, capacity: float, held: list[int], most_rounds: int = 20) -> DataFrame:
    """Labels of linked nodes when balanced label propagation has settled.

    nodes: node, parent long, label int (its first shard), w long (rows it stands for), h long (a hash of
    its content, so that runs agree). Links are
    stars: leaves are linked with their parent, a centre is its own. In even rounds leaves ask for
    their centre's label, in odd rounds centres ask for a label that more of their leaves have than
    have their own, so each move makes more links whole and none is undone. Moves from i to j are
    admitted up to a quota: swaps, and the room that ``capacity`` leaves in j; which of them is a
    hash of the node and the round. When two rounds admit nothing, leaves for which no room was left
    follow their centre all the same; the caller deals out what is too much. ``held`` rows of each
    shard are not of ``nodes`` and stay. Returns node, label, w.
    """
    idle = 0
    for turn in range(most_rounds):
        if turn % 2 == 0:
            wish = nodes.where("node = parent").select("parent", F.col("label").alias("to"))
            asked = nodes.join(wish, "parent")
        else:
            votes = nodes.where("node <> parent").groupBy("parent", "label").agg(F.count(F.lit(1)).alias("v"))
            best = votes.groupBy("parent").agg(F.max(F.struct("v", (-F.col("label")).alias("l"))).alias("best"))
            own = votes.select(F.col("parent").alias("node"), "label", F.col("v").alias("own"))
            wish = best.select(F.col("parent").alias("node"), (-F.col("best.l")).cast("int").alias("to"), F.col("best.v").alias("v"))
            asked = nodes.join(wish, "node", "left").join(own, ["node", "label"], "left")
            asks = (F.col("node") == F.col("parent")) & (F.col("v") > F.coalesce("own", F.lit(0)))
            asked = asked.withColumn("to", F.when(asks, F.col("to")).otherwise(F.col("label")))
        asked = saved(asked.select("node", "parent", "label", "w", "h", "to"))
        counted = asked.groupBy(F.col("label").alias("src_label"), F.col("to").alias("dst_label")).agg(F.sum("w").alias("w")).collect()
        load = {s: float(h) for s, h in enumerate(held)}
        for r in counted:
            load[r["src_label"]] += r["w"]
        demand = [r for r in counted if r["src_label"] != r["dst_label"]]
        parts = {k: p for k, p in _quotas(demand, load, capacity, shards).items() if p > 0}
        share = F.lit(0.0)
        for (a, b), part in parts.items():
            share = F.when((F.col("label") == a) & (F.col("to") == b), F.lit(part)).otherwise(share)
        luck = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        nodes = asked.select("node", "parent", F.when(luck < share, F.col("to")).otherwise(F.col("label")).alias("label"), "w", "h")
        idle = 0 if parts else idle + 1
        if idle == 2 or turn % 2 == 0 and not demand:
            break
    centres = nodes.where("node = parent").select("parent", "label")
    return nodes.drop("label").join(centres, "parent").select("node", "label", "w")


def _packed(sizes: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """(shard, rows) of the pieces of each group of ``sizes`` rows, largest first; one piece wherever a shard has room for all.

    The emptiest shard is taken. What fits no shard fills the emptiest ones in turn.
    """
    room, out = list(room), [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left = sizes[i]
        while left > 0:
            to = max(range(len(room)), key=lambda s: room[s])
            part = min(left, room[to])
            out[i].append((to, part))
            room[to] -= part
            left -= part
    return out


def shard(docs: DataFrame, shards: int = 8, bucket_rows: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    Law ``rows``: shard sizes differ by one row at most, whatever the links are. Documents of equal
    text are linked; every other row of a link group is linked with its first, and label propagation
    runs over them until it settles. A group of over 1 / 4096 of all rows and ``bucket_rows``, or of
    over an eighth of a shard, is one weighted node instead; these are packed first, the largest
    first, and only what no shard has room for is cut. Rows without links fill the shards up, and a
    shard's surplus goes to those short of rows. Slots of a shard run from 0 without gaps; they are
    sums over (shard, bucket) plus a rank in a bucket, never a sort of all; the rows of a weighted
    node are dealt over buckets of its own. There are 65,536 buckets at most, whose rows Spark ranks in
    a sort that can spill.

    A null text has size 1 and crc32 0 and is linked with nothing; empty texts are equal texts. Rows
    that repeat, ids included, are rows of their own, known by a number. Ties go by a hash. Null ids
    are kept. Memory is linear in the longest text. An empty table gives none. Other columns,
    whatever their names, are not read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    rows = saved(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_group"), F.monotonically_increasing_id().alias("_row")))
    n = rows.count()
    groups = saved(rows.where("_group is not null").groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    cell_rows = max(bucket_rows, -(-n // (1 << 16)))
    large = groups.where(F.col("_n") > max(1, min(max(bucket_rows, -(-n // LARGE)), n // (8 * shards))))  # LARGE or 8 * shards rows at most
    large = sorted(((bytes(r["_group"]), r["_n"]) for r in large.collect()), key=lambda r: (-r[1], r[0]))
    plan = _packed([c for _, c in large], quota)
    held = [sum(c for p in plan for to, c in p if to == s) for s in range(shards)]
    large = [(g, c, i, [sum(k for _, k in p[:j]) for j in range(1, len(p))], [to for to, _ in p]) for i, ((g, c), p) in enumerate(zip(large, plan, strict=True))]
    large = rows.sparkSession.createDataFrame(large, "_group binary, _n long, _i long, _cuts array<long>, _to array<int>")
    rows = rows.join(F.broadcast(large), "_group", "left")
    node = F.col("_row")
    small = rows.where("_group is not null and _n is null")
    first = small.groupBy("_group").agg(F.min_by(node, F.struct("doc_id")).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    first = first.where("_rows > 1").drop("_rows")
    nodes = small.join(first, "_group").select(node.alias("node"), F.col("_first").alias("parent"), F.lit(1).cast("long").alias("w"), F.xxhash64("_group", "doc_id").alias("h"))
    # first labels in proportion to the room that the weighted nodes leave
    luck = F.pmod(F.xxhash64("h", F.lit("start")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    room = [q - h for q, h in zip(quota, held, strict=True)]
    start = sum(((luck >= sum(room[:s]) / max(1, sum(room))).cast("int") for s in range(1, shards)), F.lit(0))
    labels = propagate(saved(nodes.withColumn("label", start)), shards, n / shards, held)
    placed = rows.withColumn("node", F.when(F.col("_n").isNull(), node)).join(labels.select("node", "label"), "node", "left")
    piece = F.size(F.filter("_cuts", lambda c: c <= F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.col("_n"))))
    # places: the weighted nodes of a label, each in buckets of its own; the linked rows in hash order of their group;
    # pieces of cut nodes last, so that a surplus is of groups that are cut anyway; then all rows without links
    buckets = max(1, min(1 << 16, -(-n // bucket_rows)))
    unit = F.coalesce(F.xxhash64("_group"), F.xxhash64("doc_id"))
    salt = F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.ceil(F.col("_n") / F.lit(cell_rows)))
    own = F.when(F.size("_cuts") > 0, 2 << 40).otherwise(0) + F.col("_i") * (1 << 24) + salt
    bucket = F.when(F.col("_n").isNotNull(), own).otherwise(F.pmod(unit, F.lit(buckets)) + F.lit(1 << 40))
    label = F.when(F.col("_n").isNotNull(), F.get("_to", piece)).otherwise(F.coalesce("label", F.lit(shards)))
    placed = placed.select("doc_id", "size", "text_crc32", label.cast("int").alias("_label"), bucket.cast("long").alias("_bucket"), unit.alias("_unit"))
    placed = saved(placed)
    cells = placed.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_cell"))
    cells = saved(cells.withColumn("_before", F.coalesce(F.sum("_cell").over(W.partitionBy("_label").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    have = {r["_label"]: r["n"] for r in cells.groupBy("_label").agg(F.sum("_cell").alias("n")).collect()}
    rank = F.row_number().over(W.partitionBy("_label", "_bucket").orderBy("_unit", "doc_id", "size")) - 1
    placed = placed.withColumn("_rank", rank).join(cells.drop("_cell"), ["_label", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_rank"))
    # rows beyond their shard's quota, label by label, then rows without links, go to the free slots in order
    spare, seen = F.lit(None).cast("long"), 0
    for s in range(shards):
        over = max(0, have.get(s, 0) - quota[s])
        spare = F.when((F.col("_label") == s) & (F.col("_at") >= quota[s]), F.col("_at") - quota[s] + seen).otherwise(spare)
        seen += over
    spare = F.when(F.col("_label") == shards, F.col("_at") + seen).otherwise(spare)
    placed = placed.withColumn("_spare", spare)
    to, slot, seen = F.col("_label"), F.col("_at"), 0
    for s in range(shards):
        used = min(have.get(s, 0), quota[s])
        here = (F.col("_spare") >= seen) & (F.col("_spare") < seen + quota[s] - used)
        to, slot = F.when(here, s).otherwise(to), F.when(here, F.col("_spare") - seen + used).otherwise(slot)
        seen += quota[s] - used
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
