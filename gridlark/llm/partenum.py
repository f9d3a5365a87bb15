"""N-gram Jaccard self-join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components, forest, groups
from .store import freed, partitions, removed, rows_and_bytes, saved, saved_at, table
from .text import LOWER, SPACE, Hasher, Words, mixed, slices

SHINGLE = 5
#: A signature that more sets than this share is hot: its pairs are found by other signatures, rare shingles or tiles.
HOT = 32
#: Signatures of a task that are held before they are handed on, and bytes of signatures in a block.
FLUSH, BLOCK_BYTES = 1 << 19, 24 << 20
#: Sets of a block when a family of hot groups is compared in full.
BLOCK = 1024
_LOW = np.uint64(127)


@cache
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band, and the largest distance and number of partitions for the sets of bands i - 1 and i.

    Sizes of two linked sets are within a factor of 5 / 4, so they are in one band or in neighbours.
    With a + b items at Jaccard 4/5 or more, at most (a + b) / 9 are in one set alone. One partition
    more than that would leave an equal one; the spare ones make up for partitions that are skipped.
    """
    first = [1]
    while first[-1] < 10**10:
        first.append(max(first[-1] + 1, -(-first[-1] * 5 // 4)))
    low = np.array(first, np.int64)
    most = 2 * (np.append(low[1:], low[-1] * 2) - 1) // 9
    spare = np.where(most > 0, most * 12 // 100 + 3, 0)
    return low, most, most + 1 + spare


def shingle_sets(column: pa.Array, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row of each item, item) of runs of texts: the distinct shingles, as 52-bit hashes."""
    for lo, hi, data, at in slices(column):
        for a in range(lo, hi, rows):
            b = min(hi, a + rows)
            part, off = data[at[a - lo] : at[b - lo]], at[a - lo : b - lo + 1] - at[a - lo]
            part = LOWER[part]
            words = Words(part, off, SPACE)
            h = Hasher(words.hashes(part))
            first, n = words.first_word[:-1], words.per_row
            many = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
            row = np.repeat(np.arange(b - a), many)
            s = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            key = h.windows(s, s + np.minimum(n, SHINGLE)[row])
            both = np.unique((row.astype(np.uint64) << np.uint64(52)) | (key >> np.uint64(12)))
            yield a, b, (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 52) - 1)


def _sums(key: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit x by key, modulo 2 ** 64: exact in two halves."""
    low = np.bincount(key, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    return low + (np.bincount(key, (x >> np.uint64(32)).astype(np.float64), n).astype(np.uint64) << np.uint64(32))


def fingerprints(row: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node of each set, a 57-bit hash of all its items with its band in the low 7 bits; 64 bits more; and its size.

    Both together tell sets apart. Signatures carry the node alone, as it only leads to candidates.
    """
    size = np.bincount(row, minlength=n)
    band = np.searchsorted(bands()[0], size, "right") - 1
    h = mixed(_sums(row, mixed(item + np.uint64(0x632BE59BD9B4E019)), n) + size.astype(np.uint64))
    more = mixed(_sums(row, mixed(item ^ np.uint64(0x2545F4914F6CDD1D)), n) + size.astype(np.uint64))
    return (h & ~_LOW) | np.maximum(band, 0).astype(np.uint64), more, size


def _signatures(row: np.ndarray, item: np.ndarray, band: np.ndarray, use: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of the partitions of each set in its band's bucket or the next, and each set's empty partitions.

    A signature is a hash of all items of one partition, with the bucket in the low 7 bits. Empty
    partitions have none, unless a set has more of them than there are spare ones.
    """
    _, most, parts = bands()
    bucket = band + ahead
    n_parts = np.where(use, parts[bucket], 0)
    start = np.cumsum(n_parts) - n_parts
    mine = use[row]
    r, x = row[mine], item[mine]
    part = ((x >> np.uint64(20)) * n_parts[r].astype(np.uint64)) >> np.uint64(32)
    key = start[r] + part.astype(np.int64)
    total = int(n_parts.sum())
    held = np.bincount(key, minlength=total) > 0
    owner = np.repeat(np.arange(len(band)), n_parts)
    within = (np.arange(total) - start[owner]).astype(np.uint64)
    salt = within * np.uint64(0x9E3779B97F4A7C15) + bucket[owner].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    sig = mixed(_sums(key, mixed(x * np.uint64(0xA0761D6478BD642F) + np.uint64(1)), total) + salt)
    sig = (sig & ~_LOW) | bucket[owner].astype(np.uint64)
    empty = n_parts - np.bincount(owner[held], minlength=len(band))
    give = held | (n_parts - empty < most[bucket] + 1)[owner]
    return owner[give], sig[give], empty


ROWS = "kind int, block int, a long, b long, c long, d long, n int, m int, blob binary"


def _batch(kind: int, rows: int, /, **cols: np.ndarray | list) -> pa.RecordBatch:
    types = {"block": pa.int32(), "a": pa.int64(), "b": pa.int64(), "c": pa.int64(), "d": pa.int64(), "n": pa.int32(), "m": pa.int32(), "blob": pa.binary()}
    made = [pa.array(np.full(rows, kind), pa.int32())]
    for name, t in types.items():
        made.append(pa.array(cols[name], t) if name in cols else pa.nulls(rows, t))
    return pa.RecordBatch.from_arrays(made, ["kind", *types])


#: Kinds of rows: of a document (a id or null, b node, c the rest of its set's hash, d hash of its text, n size),
#: of a node (a node, b the rest of its hash, n and m its empty partitions),
#: packed signatures, a pair (a, b, n bucket, m shared), a hot node (a, n bucket, m how many), a hot group (a signature, blob nodes).
DOC, NODE, PACKED, PAIR, HOT_NODE, HOT_GROUP = range(6)


def _emit(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
            block = (sig >> np.uint64(8)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            both = np.stack([sig[order], node[order]], 1)
            cuts = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            for s in range(0, len(some), 64):
                part = some[s : s + 64]
                yield _batch(PACKED, len(part), block=part, blob=[both[cuts[i] : cuts[i + 1]].tobytes() for i in part])

        for batch in batches:
            for lo, hi, row, item in shingle_sets(batch.column(1)):
                n = hi - lo
                node, more, size = fingerprints(row, item, n)
                ids = batch.column(0).slice(lo, n)
                real = size > 0
                yield _batch(DOC, n, block=node % np.uint64(blocks), a=ids, b=pa.array(node.view(np.int64), pa.int64(), mask=~real), c=more.view(np.int64), d=batch.column(2).slice(lo, n), n=size)
                use = real.copy()
                for i in np.flatnonzero(real).tolist():  # one of equal sets goes on
                    name = int(node[i]), int(more[i])
                    use[i] = name not in seen
                    seen.add(name)
                band = (node & _LOW).astype(np.int64)
                empty = []
                for ahead in (0, 1):
                    owner, sig, e = _signatures(row, item, band, use, ahead)
                    held.append((sig, node[owner]))
                    count += len(sig)
                    empty.append(e[use])
                yield _batch(NODE, int(use.sum()), block=node[use] % np.uint64(blocks), a=node[use].view(np.int64), b=more[use].view(np.int64), n=empty[0], m=empty[1])
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return run


def _runs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, node) distinct and sorted, and where runs of one signature begin, with the end."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, np.int64)
    return sig, node, cut


def _pairs_within(cut: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions i < j of each run."""
    a, b = [], []
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        base = cut[:-1][size == n][:, None]
        a.append((base + i).ravel())
        b.append((base + j).ravel())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b, bucket) and how often each is there."""
    order = np.lexsort((bucket, b, a))
    a, b, bucket = a[order], b[order], bucket[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], bucket[at], np.diff(np.append(at, len(a)))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the packed signatures of each block: pairs that share some, and the hot groups."""

    def packed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds != PACKED).any():
                others.append(batch.filter(pa.array(kinds != PACKED)))
            if (kinds == PACKED).any():
                yield batch.filter(pa.array(kinds == PACKED))

    others: list[pa.RecordBatch] = []
    for tile in groups(packed(), "block"):
        yield from others
        others.clear()
        both = np.frombuffer(b"".join(tile["blob"].to_pylist()), np.uint64).reshape(-1, 2)
        # only signatures that are there twice matter
        sig, node, cut = both[:, 0], both[:, 1], None
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        twin = np.zeros(len(sig), bool)
        twin[1:] = sig[1:] == sig[:-1]
        twin[:-1] |= twin[1:]
        sig, node, cut = _runs(sig[twin], node[twin])
        size = np.diff(cut)
        normal = (size > 1) & (size <= HOT)
        i, j = _pairs_within(np.append(cut[:-1][normal], 0), size[normal])
        bucket = (sig[i] & _LOW).astype(np.int64)
        top = np.maximum((node[i] & _LOW).astype(np.int64), (node[j] & _LOW).astype(np.int64))
        mine = bucket == top  # the pair's own bucket, that of its larger band
        a, b, c, m = _counted(node[i[mine]], node[j[mine]], bucket[mine])
        for s in range(0, len(a), 20000):
            e = slice(s, s + 20000)
            yield _batch(PAIR, len(a[e]), a=np.minimum(a[e], b[e]).view(np.int64), b=np.maximum(a[e], b[e]).view(np.int64), n=c[e], m=m[e])
        hot = np.flatnonzero(size > HOT)
        if len(hot):
            inside = np.repeat(size > HOT, size)
            a, _, c, m = _counted(node[inside], node[inside], (sig[inside] & _LOW).astype(np.int64))
            for s in range(0, len(a), 20000):
                e = slice(s, s + 20000)
                yield _batch(HOT_NODE, len(a[e]), a=a[e].view(np.int64), n=c[e], m=m[e])
            for s in range(0, len(hot), 256):
                part = hot[s : s + 256]
                yield _batch(HOT_GROUP, len(part), a=sig[cut[part]].view(np.int64), blob=[node[cut[h] : cut[h + 1]].tobytes() for h in part])
    yield from others


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sig, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            node = np.frombuffer(blob, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), sig), pa.int64()), pa.array(node)], ["sig", "hash"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, row, item in shingle_sets(batch.column(1)):
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(item.view(np.int64)))], ["node", "items"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b), those whose sets are at Jaccard 4/5 or more."""
    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").distinct().join(right, "b").join(left, "a")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= 80 * (F.size("x") + F.size("y") - same)).select("a", "b")


def _torn(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (sig, node) of the hot groups that hold several components."""
    now = members.join(comp, "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp"))
    torn = now.groupBy("sig").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    return members.join(saved(torn.select("sig")), "sig")


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile (one or two blocks of sets): each node with the smallest node that it reaches by links inside."""
    for tile in groups(batches, "tile"):
        node, block, comp = (tile[c].to_numpy() for c in ("node", "block", "comp"))
        if len(np.unique(comp)) < 2:
            continue
        items = tile["items"].combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        size = np.diff(items.offsets.to_numpy())
        owner = np.repeat(np.arange(len(node)), size)
        _, code, df = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner, code = owner[df[code] > 1], code[df[code] > 1]
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        shared = np.zeros((len(left), len(right)), np.float32)
        at = np.full(len(node), -1)
        at[left] = np.arange(len(left))
        at_right = np.full(len(node), -1)
        at_right[right] = np.arange(len(right))
        for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            a, b = np.searchsorted(code, [lo, lo + 2048])
            x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            o, c = owner[a:b], code[a:b] - lo
            x[at[o[at[o] >= 0]], c[at[o] >= 0]] = 1
            y[at_right[o[at_right[o] >= 0]], c[at_right[o] >= 0]] = 1
            shared += x @ y.T
        union = size[left][:, None] + size[right][None, :] - shared
        i, j = np.nonzero(100 * shared >= 80 * union)
        i, j = left[i], right[j]
        by_node = np.argsort(node, kind="stable")
        rank = np.empty(len(node), np.int64)
        rank[by_node] = np.arange(len(node))
        low = node[by_node][forest(len(node), rank[i], rank[j])[rank]]
        some = low != node
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(low[some])], ["a", "b"])


def _compared(members: DataFrame, comp: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) that connect what is linked among members (sig, node) of one family of hot groups.

    A family is what common hot groups connect. It is compared in tiles of two blocks of BLOCK sets,
    as products of matrices, and a tile gives a forest of its links, not its pairs.
    """
    least = members.groupBy("sig").agg(F.min("node").alias("b"))
    family = components(members.join(least, "sig").select(F.col("node").alias("a"), "b"))
    rows = family.select("node", F.col("comp").alias("family"))
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "family").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("tile")
    rows = rows.select(tile, "block", "node").join(comp, "node", "left").select("tile", "block", "node", F.coalesce("comp", "node").alias("comp")).join(sets, "node")
    dealt = rows.select("tile", "block", "node", "comp", "items").repartition(parts, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_tile_links, "a long, b long")


def _classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and comp (null: no shingles) of every row; see link_classes().

    1. Each set is partitioned by hash into enough parts that a linked pair shares one (see bands()).
       Signatures travel packed by hash block; a block is sorted once and gives the pairs that share
       a signature, with how many they share.
    2. A signature of over HOT nodes gives no pairs. A pair shares at least spare + 1 signatures, so one
       with a node that has no more hot and empty partitions than spare ones is found by another, and
       pairs that share too few of theirs are dropped before they are compared.
    3. Candidates are compared exactly, by their whole sets. A set is known by 121 bits and numbered;
       where two share the 57 bits that signatures carry, both are compared. It is fetched from one of
       its rows, by id (null too) and text hash, so repeated and null ids take part as any other.
    4. Nodes with more hot partitions than spare ones (large groups of near copies, short texts around
       a frequent passage) matter where a hot group holds several components. Two of them either share
       a shingle that at most HOT of them have, and meet there; or most of both is hot, and these are
       compared in tiles, as products of 0/1 matrices that give a forest of links each. So no link
       between components is lost.
    """
    spark = docs.sparkSession
    _, size = rows_and_bytes(docs)
    blocks, parts = partitions(spark, 3 * size // 2, BLOCK_BYTES)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    rows = texts.mapInArrow(_emit(blocks), ROWS)
    rows, at_rows = saved_at(rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_match, ROWS))
    freed(spark)
    of = lambda kind, *cols: rows.where(F.col("kind") == kind).select(*[F.col(c).alias(n) for c, n in cols])
    doc = of(DOC, ("a", "doc_id"), ("b", "hash"), ("c", "more"), ("d", "th"), ("n", "n_shingles"))
    nodes = of(NODE, ("a", "hash"), ("b", "more"), ("n", "e0"), ("m", "e1")).groupBy("hash", "more").agg(F.max("e0").alias("e0"), F.max("e1").alias("e1"))
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("node"), "hash", "more", "e0", "e1"))
    spare = [int(b - a - 1) for a, b in zip(bands()[1].tolist(), bands()[2].tolist(), strict=True)]
    spare_of = lambda bucket: F.element_at(F.array(*map(F.lit, spare)), bucket + 1)
    all_hot = saved(of(HOT_NODE, ("a", "hash"), ("n", "bucket"), ("m", "m")).groupBy("hash", "bucket").agg(F.sum("m").alias("hot")))
    band = F.col("hash").bitwiseAND(F.lit(127)).cast("int")
    hot = all_hot.join(nodes, "hash").withColumn("empty", F.when(F.col("bucket") == band, F.col("e0")).otherwise(F.col("e1")))
    hot = saved(hot.where(F.col("hot") + F.col("empty") > spare_of(F.col("bucket"))).select("node", "hash", "bucket"))
    any_hot = all_hot.groupBy("hash").agg(F.sum("hot").alias("hots"))
    pairs = of(PAIR, ("a", "a"), ("b", "b"), ("n", "bucket"), ("m", "m")).groupBy("a", "b", "bucket").agg(F.sum("m").alias("m"))
    info = saved(nodes.join(any_hot, "hash", "left").select("hash", "node", "e0", "e1", F.coalesce("hots", F.lit(0)).alias("hots")))
    for side in ("a", "b"):
        pairs = pairs.join(info.select(F.col("hash").alias(side), *[F.col(c).alias(side + c) for c in ("node", "e0", "e1", "hots")]), side)
        pairs = pairs.join(hot.select(F.col("node").alias(f"{side}node"), "bucket", F.lit(True).alias(f"{side}hot")), [f"{side}node", "bucket"], "left")
    empty = lambda s: F.when(F.col("bucket") == F.col(s).bitwiseAND(F.lit(127)), F.col(f"{s}e0")).otherwise(F.col(f"{s}e1"))
    # both sides with many hot partitions: any shared one counts; else those that neither skipped must be there
    need = spare_of(F.col("bucket")) + 1 - F.least(empty("a"), empty("b")) - F.least("ahots", "bhots")
    few_hot = F.col("ahot").isNull() | F.col("bhot").isNull()
    pairs = pairs.where(~few_hot | (F.col("m") >= F.greatest(need, F.lit(1))))
    pairs, at_pairs = saved_at(pairs.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct())
    freed(spark)
    doc = doc.join(nodes.select("hash", "more", "node"), ["hash", "more"], "left").select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    doc = saved(doc)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct()
    one = doc.where("node is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.min_by("doc_id", "th").alias("doc_id"), F.min("th").alias("th"))
    one = saved(one)
    place = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no"), "th"]
    fetched = texts.select(*place, "text").join(one.select(*place, "node").hint("merge"), ["id", "no", "th"]).groupBy("id", "no", "th").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets, at_sets = saved_at(fetched.select("node", "text").mapInArrow(_sets, "node long, items array<long>"))
    freed(spark)
    edges = saved(_linked(pairs, sets))
    removed(spark, at_pairs)
    freed(spark)
    members = of(HOT_GROUP, ("a", "sig"), ("blob", "blob")).mapInArrow(_unpacked, "sig long, hash long").withColumn("bucket", F.col("sig").bitwiseAND(F.lit(127)).cast("int"))
    members = saved(members.join(hot, ["hash", "bucket"]).select("sig", "node"))
    removed(spark, at_rows)
    comp = saved(components(edges))
    members = saved(_torn(members, comp))
    if not members.isEmpty():
        # members of groups that still hold several components: what two of them share beside hot shingles
        left = members.select("node").distinct().join(sets, "node")
        # of each shingle HOT + 1 nodes at most are looked at: enough to know which ones are hot
        rank = F.row_number().over(W.partitionBy("item").orderBy("node"))
        some = left.select("node", F.explode("items").alias("item")).withColumn("rank", rank).where(F.col("rank") <= HOT + 1)
        few = saved(some.groupBy("item").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") <= HOT))
        rare = few.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
        mostly = left.select("node", F.size("items").alias("size")).join(rare, "node", "left")
        mostly = saved(mostly.select("node", (4 * F.coalesce("rare", F.lit(0)) <= F.col("size")).alias("mostly")))
        few = few.where(F.size("nodes") > 1).select("item", F.explode("nodes").alias("node")).join(comp, "node", "left").join(mostly, "node")
        few = saved(few.select("item", "node", "mostly", F.coalesce("comp", "node").alias("comp")))
        # two that are mostly hot meet below
        both = (F.col("l.item") == F.col("r.item")) & (F.col("l.comp") < F.col("r.comp")) & ~(F.col("l.mostly") & F.col("r.mostly"))
        asked = few.alias("l").join(few.alias("r"), both).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
        # two that share no other shingle link only if those are few in both
        hot_ones = members.join(mostly.where("mostly").select("node"), "node", "left_semi")
        more = _linked(asked, sets).unionByName(_compared(hot_ones, comp, sets, parts))
        edges = saved(edges.unionByName(more))
        comp = saved(components(edges))
    removed(spark, at_sets)
    freed(spark)
    return doc.join(comp, "node", "left").select("doc_id", "th", "n_shingles", F.coalesce("comp", "node").alias("comp"))


def link_classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (key, text).

    Two documents link when their sets of five-word shingles have Jaccard 4/5 or more; a component is
    what links reach, and its id the smallest doc_id in it. Documents of one set are one node. Two
    that link share a signature of a partition, or several hot ones; see _classes().

    Null texts and texts without words have no shingles and are a component of their own. Rows with a
    null id link as any other; their component's id is its smallest id, null where it has none. Rows
    that repeat, and rows of one id with different texts, are reported and linked each. Ties need no
    rule. Very long texts are one row's work: memory is linear in them. An empty table gives none.
    Other columns, whatever their names, are not read.
    """
    found = _classes(docs, key)
    least = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = found.join(saved(least), "comp", "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component of links one row, all columns: the one with the smallest doc_id (null last, then by a hash of its text).

    Of repeated rows one stays. Rows without words are linked with nothing and stay, all of them.
    """
    found = _classes(docs).where("comp is not null")
    heads = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("h")).select("h.doc_id", "h.th").distinct()
    heads = saved(heads)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.withColumn("_th", F.xxhash64("text"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id")) & (F.col("d._th") == F.col("h.th"))
    kept = marked.where(worded).alias("d").join(heads.alias("h"), same, "left_semi").dropDuplicates(["doc_id", "_th"])
    return kept.drop("_th").unionByName(docs.where(~worded))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))


def brute_force(ids: list, texts: list) -> pd.DataFrame:
    """The same from all pairs of sets, for small tables."""
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    up = list(range(len(ids)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)), key=lambda q: ids[q])
                up[b] = a
    return pd.DataFrame({"doc_id": ids, "n_shingles": [len(s) for s in sets], "component_id": [ids[top(i)] for i in range(len(ids))]})
