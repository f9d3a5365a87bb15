"""Long repeats between documents of bytes: which parts of which documents meet in one index.

Every window of ``window`` units has an anchor, its smallest k-mer by hash, so equal windows have equal
anchors at equal places. Windows of a document that follow each other and share an anchor are a
path. Only paths at anchors of several documents can hold a shared window, so only these go on, by
their anchor, to an index that compares them. Paths at an anchor with very many of them go on as
single windows, by each window's hash, so no anchor's paths meet in one place. What is hashed here
chooses what is compared; it removes nothing, but for equal paths that one task holds at once,
which are pre-aggregated to the one of the smallest document (128 bits of hashes).

Entries travel packed: by block of their anchor, and back by block of their document. There they
meet the documents in one sorted stream, lists first, so no row is made for each entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import groups
from .store import freed, rows_and_bytes, saved
from .text import BYTE_KEYS, SPACE, Hasher, Words, slices

#: Paths that a task holds before it hands them on.
FLUSH = 1 << 19
#: Bytes of text that one block stands for.
BLOCK_BYTES = 2 << 20
#: Paths at one anchor from which on its windows go on by their hashes, not by the anchor.
HOT = 4096
#: Texts with over 1 / COPY_SHARE of all rows are set aside but for their first document.
COPY_SHARE = 4096

_ZSTD = pa.Codec("zstd", compression_level=1)

ROWS = "kind int, block int, blob binary"
#: Kinds of rows: entries by block of their anchor; lists by block of their document; documents.
PACKED, REMOVE, PIECES, DOCUMENT = range(4)
#: A path: its anchor within the block, and where it is. At a hot anchor the anchor's offset is APART.
ENTRY = np.dtype([("doc", "<i8"), ("key", "<u4"), ("start", "<u4"), ("length", "<u2"), ("offset", "<u2")])
APART = 0xFFFF
#: A removed span, and a hash of its units: ids may repeat, and it counts only in the rows that have it.
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("length", "<u2"), ("hash", "<u4")])


class Units:
    """Units (words or bytes) of a run of documents."""

    def __init__(self, data: np.ndarray, at: np.ndarray, words: bool):
        self.data, self.at = data, at
        if words:
            self.words = Words(data, at, SPACE)
            self.items, self.first = self.words.hashes(data), self.words.first_word
        else:
            self.items, self.first = BYTE_KEYS[1][data], at
        self.hasher = Hasher(self.items)

    def paths(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first unit, end, anchor's hash, anchor's place) of all paths, units counted over the whole run."""
        n = len(self.items)
        none = np.zeros(0, np.int64)
        if n < window:
            return none, none, none, np.zeros(0, np.uint64), none
        h = self.hasher.all_windows(k)
        low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width, have = window - k + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        fits = np.zeros(n - window + 2, np.int64)
        long = np.diff(self.first) >= window
        np.add.at(fits, self.first[:-1][long], 1)
        np.add.at(fits, self.first[1:][long] - window + 1, -1)
        start = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
        if not len(start):
            return none, none, none, np.zeros(0, np.uint64), none
        anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.searchsorted(self.first, start, "right") - 1
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        end = start[np.append(at[1:], len(start)) - 1] + window
        return row[at], start[at], end, h[anchor[at]], anchor[at]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] times, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def squeezed(raw: bytes) -> bytes:
    """Compressed, after its length; Spark's own compression of shuffles finds less in what is packed."""
    return np.uint32(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def spelled(blob: bytes) -> bytes:
    return _ZSTD.decompress(blob[4:], int(np.frombuffer(blob, np.uint32, 1)[0]), asbytes=True)


def pack(entries: np.ndarray) -> bytes:
    """Byte planes, so that what hardly changes is compressed away."""
    return np.ascontiguousarray(entries.view(np.uint8).reshape(len(entries), -1).T).tobytes()


def unpack(raw: bytes, dtype: np.dtype, n: int | None = None, at: int = 0) -> np.ndarray:
    n = (len(raw) - at) // dtype.itemsize if n is None else n
    planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def dealt_out(kind: int, block: np.ndarray, order: np.ndarray, packed) -> Iterator[pa.RecordBatch]:
    """A row for each block, of the entries in ``order``, which is sorted by block."""
    b = block[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    for x in range(0, len(cut) - 1, 64):
        c = cut[x : x + 65].tolist()
        blobs = [squeezed(packed(order[lo:hi])) for lo, hi in zip(c[:-1], c[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), kind), pa.int32()), pa.array(b[c[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["kind", "block", "blob"])


def to_documents(kind: int, entries: np.ndarray, blocks: int, head: bytes = b"") -> Iterator[pa.RecordBatch]:
    block = entries["doc"] % blocks
    yield from dealt_out(kind, block, np.lexsort((entries["start"], entries["doc"], block)), lambda e: head + pack(entries[e]))


def removed(doc: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    out = np.empty(len(doc), SPAN)
    out["doc"], out["start"], out["length"], out["hash"] = doc, start, length, h & np.uint64(0xFFFFFFFF)
    yield from to_documents(REMOVE, out, blocks)


class Outbox:
    """Entries of a task. In each flush a path of several documents stays with the smallest; the others' spans are removed."""

    def __init__(self, blocks: int):
        self.blocks, self.held, self.count = blocks, [], 0

    def add(self, anchor: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        entries = np.empty(len(anchor), ENTRY)
        entries["doc"], entries["key"], entries["start"], entries["length"], entries["offset"] = doc, anchor & np.uint64(0xFFFFFFFF), start, end - start, place - start
        self.held.append((anchor, h, entries))
        self.count += len(anchor)
        if self.count >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        a, h, entries = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.count = [], 0
        order = np.argsort(h ^ (a * np.uint64(0x9E3779B97F4A7C15)))
        a, h, entries = a[order], h[order], entries[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])]))
        least = np.repeat(np.minimum.reduceat(entries["doc"], at), np.diff(np.append(at, len(a))))
        late = entries["doc"] > least
        e = entries[late]
        yield from removed(e["doc"], e["start"], e["length"], h[late], self.blocks)
        a, entries = a[~late], entries[~late]
        block = ((a >> np.uint64(32)) % np.uint64(self.blocks)).astype(np.int64)
        yield from dealt_out(PACKED, block, np.lexsort((entries["doc"], block)), lambda e: pack(entries[e]))


def resolve(blocks: int, hot: int):
    """Of the packed entries of each block: those whose anchor several documents have; over ``hot`` of one anchor marked APART."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                other = batch.column(0).to_numpy() != PACKED
                if other.any():
                    others.append(batch.filter(pa.array(other)))
                if not other.all():
                    yield batch.filter(pa.array(~other))

        for tile in groups(packed(), "block"):
            yield from others
            others.clear()
            entries = np.concatenate([unpack(spelled(b), ENTRY) for b in tile["blob"].to_pylist()])
            order = np.argsort(entries["key"])
            key = entries["key"][order]
            same = key[1:] == key[:-1]
            order = order[np.append(same, False) | np.append(False, same)]
            if not len(order):
                continue
            entries = entries[order]
            at = np.flatnonzero(np.append(True, entries["key"][1:] != entries["key"][:-1]))
            size = np.diff(np.append(at, len(entries)))
            shared = np.minimum.reduceat(entries["doc"], at) < np.maximum.reduceat(entries["doc"], at)
            entries["offset"][np.repeat(size > hot, size)] = APART
            yield from to_documents(PIECES, entries[np.repeat(shared, size)], blocks, np.uint32(tile["block"][0].as_py()).tobytes())
        yield from others

    return run


def find_paths(k: int, window: int, blocks: int):
    """Packed paths of all documents (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(blocks)
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, hi, data, at in slices(batch.column("text")):
                units = Units(data, at, False)
                row, start, end, anchor, place = units.paths(k, window)
                base = units.first[row]
                yield from box.add(anchor, units.hasher.windows(start, end), ids[lo:hi][row], start - base, end - base, place - base)
        yield from box.flush()

    return run


def meeting(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(list sorted by document, each one's head, documents) of a stream that is sorted by block and kind; lists come first."""
    block, blobs, ready = None, [], None
    skip = 4 if dtype == ENTRY else 0
    for batch in batches:
        of, is_doc = batch.column("block").to_numpy(), batch.column("kind").to_numpy() == DOCUMENT
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if of[lo] != block:
                block, blobs, ready = of[lo], [], None
            part = batch.slice(lo, hi - lo)
            if not is_doc[lo]:
                blobs.extend(map(spelled, part.column("blob").to_pylist()))
                continue
            if ready is None:
                lists = [unpack(b, dtype, at=skip) for b in blobs]
                entries = np.concatenate(lists) if lists else np.zeros(0, dtype)
                heads = np.repeat(np.array([np.frombuffer(b, np.uint32, 1)[0] if skip else 0 for b in blobs], np.int64), [len(x) for x in lists])
                order = np.argsort(entries["doc"], kind="stable")
                ready, blobs = (entries[order], heads[order]), []
            yield *ready, part


def of_rows(ids: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of the entries of each row's document."""
    lo, hi = np.searchsorted(entries["doc"], ids), np.searchsorted(entries["doc"], ids, "right")
    return np.repeat(np.arange(len(ids)), hi - lo), spread(lo, hi - lo)


def set_aside(docs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(doc long, text, first) and the bytes of all texts. first: of copies of a very frequent text, the smallest id.

    At most COPY_SHARE texts are that frequent, so the table of them is small at any size.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    n, size = rows_and_bytes(docs)
    often = texts.where("doc is not null").groupBy(sha.alias("sha")).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    often = saved(often.where(F.col("n") > max(100, n // COPY_SHARE)).drop("n"))
    return texts.withColumn("sha", sha).join(F.broadcast(often), "sha", "left").select("doc", "text", "first"), size


def removed_spans(texts: DataFrame, size: int, k: int, window: int, pieces, index, kept, schema: str) -> DataFrame:
    """What kept() makes of all documents and their SPANs: of windows that a smaller document has.

    pieces(blocks) makes packed texts of listed entries, index(blocks) the removed spans of those of
    each block. Blocks stand for BLOCK_BYTES of text each at any size; a task works on several, one
    after the other.
    """
    spark = texts.sparkSession
    blocks = max(16, size // BLOCK_BYTES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, blocks // 4))
    while any(blocks % p == 0 for p in range(2, int(blocks**0.5) + 1)):
        blocks += 1  # a prime: ids in steps are spread all the same
    others = texts.where("doc is not null and (first is null or doc <= first)")

    def dealt(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition(parts, "block").sortWithinPartitions("block", *more)

    def beside(lists: list[DataFrame], docs: DataFrame) -> DataFrame:
        block = F.coalesce(F.pmod("doc", F.lit(blocks)), F.pmod(F.xxhash64("text"), F.lit(blocks))).cast("int")
        rows = docs.select(F.lit(DOCUMENT).alias("kind"), block.alias("block"), "doc", "text", "first")
        for x in lists:
            rows = rows.unionByName(x, allowMissingColumns=True)
        return dealt(rows.select("kind", "block", "doc", "text", "first", "blob"), "kind")

    of = lambda df, kind: df.where(F.col("kind") == kind)
    found = saved(dealt(others.mapInArrow(find_paths(k, window, blocks), ROWS)).mapInArrow(resolve(blocks, HOT), ROWS))
    freed(spark)
    compared = saved(dealt(beside([of(found, PIECES)], others).mapInArrow(pieces(blocks), ROWS)).mapInArrow(index(blocks), ROWS))
    freed(spark)
    return beside([of(t, REMOVE) for t in (found, compared)], texts).mapInArrow(kept, schema)


def marked(units: Units, row: np.ndarray, spans: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """True for the removed units of a run of documents: spans[i] of row[i] whose hash holds, and ``whole`` documents."""
    n = len(units.items)
    start = spans["start"].astype(np.int64) + units.first[row]
    end = start + spans["length"]
    ok = end <= units.first[row + 1]
    start, end = start[ok], end[ok]
    ok = (units.hasher.windows(start, end) & np.uint64(0xFFFFFFFF)) == spans["hash"][ok]
    d = np.bincount(start[ok], minlength=n + 1) - np.bincount(end[ok], minlength=n + 1)
    return (np.cumsum(d[:n]) > 0) | np.repeat(whole, np.diff(units.first))
