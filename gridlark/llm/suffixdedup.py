"""Suffix-array dedup of bytes by run-length indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import groups
from .repeats import APART, ENTRY, PACKED, SPAN, Units, dealt_out, marked, meeting, of_rows, pack, removed, removed_spans, set_aside, spelled, spread, unpack
from .store import table
from .suffixes import suffix_order
from .text import BYTE_KEYS, Hasher, slices

WINDOW, K = 50, 20
#: Bytes of one index at most, but for a single anchor's pieces.
INDEX_BYTES = 1 << 20
#: Bytes of pieces that a task holds before it hands them on.
FLUSH_BYTES = 4 << 20


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of pieces that end with 0, with the suffixes at the ends of runs sampled.

    Rows of one run keep their neighbours when all step to the left, so the suffix before a position
    in order of what follows is known everywhere from the run ends alone: where a run begins, the
    symbol's rows before it ended a run, and the two samples are neighbours one step to the left.
    From there to the left both go on together, and their match grows by a symbol with each step.
    Kept are the runs and, sorted by position, each run head's neighbour and match; nothing else.
    """

    def __init__(self, text: np.ndarray, left: np.ndarray, window: int):
        order = suffix_order(text, left, int(text.max(initial=1)))
        bwt = text[order - 1]
        head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.char, self.length = bwt[head], np.diff(np.append(head, len(text)))
        self.first_sample, self.last_sample = order[head], order[head + self.length - 1]
        stop = np.flatnonzero(text == 0)  # ends are in order of position, and match in nothing
        del order, bwt
        by_char = np.argsort(self.char, kind="stable")
        run, before = by_char[1:], by_char[:-1]
        run, before = run[self.char[run] > 0], before[self.char[run] > 0]
        # the last of all ends comes before the least symbol
        at, source = self.first_sample[run] - 1, np.where(self.char[before] > 0, self.last_sample[before] - 1, len(text) - 1)
        order = np.argsort(np.concatenate([at, stop]))
        self.at = np.concatenate([at, stop])[order]
        self.source = np.concatenate([source, np.append(-1, stop[:-1])])[order]
        self.match = np.concatenate([_common(text, at, source, window), np.zeros(len(stop), np.int64)])[order]
        self.n = len(text)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(source, match) of every position, streamed from each sampled position to the left; source -1: none."""
        steps = np.diff(self.at, prepend=-1)
        if self.n > (last := int(self.at[-1]) + 1 if len(self.at) else 0):
            steps = np.append(steps, self.n - last)
        which = np.repeat(np.arange(len(steps)), steps)
        at, source, match = (np.append(x, y) for x, y in ((self.at, self.n - 1), (self.source, -1), (self.match, 0)))
        back = at[which] - np.arange(self.n)
        none = source[which] < 0
        return np.where(none, -1, source[which] - back), np.where(none, 0, match[which] + back)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols from a[i] and from b[i] are equal, up to the end of either piece; over ``most`` counts as that."""
    n = len(text)
    raw = np.zeros(n + 16, np.uint64)
    raw[:n] = text
    eight = raw[: n + 8].copy()
    for j in range(1, 8):
        eight |= raw[j : j + n + 8] << np.uint64(8 * j)
    out = np.full(len(a), most, np.int64)
    live = np.arange(len(a))
    for j in range(0, most, 8):
        x, y = eight[np.minimum(a[live] + j, n + 7)], eight[np.minimum(b[live] + j, n + 7)]
        differ = x ^ y
        end = (x - np.uint64(0x0101010101010101)) & ~x & np.uint64(0x8080808080808080)  # lowest mark: the first 0
        differ |= end
        stop = differ != 0
        low = differ[stop]
        low &= ~low + np.uint64(1)
        out[live[stop]] = np.minimum(most, j + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
        live = live[~stop]
        if not len(live):
            break
    return out


def _earliest(text: np.ndarray, left: np.ndarray, window: int) -> np.ndarray:
    """The first position where the next ``window`` symbols of each position start, from the index' matching statistics."""
    source, match = RunLengthIndex(text, left, window).statistics()
    here = np.arange(len(text))
    long = (match >= window) & (left > window)
    up = np.where(long, source, here)
    first = here.copy()
    live = np.flatnonzero(long)
    while len(live):  # to the head of each chain of matches
        to = up[up[live]]
        moved = to != up[live]
        up[live] = to
        live = live[moved]
    np.minimum.at(first, up[long], here[long])
    return first[up]


def _with_text(entries: np.ndarray, first: np.ndarray, data: np.ndarray) -> bytes:
    return np.int64(len(entries)).tobytes() + pack(entries) + data[spread(first, entries["length"].astype(np.int64))].tobytes()


def _parted(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    heads, datas = [], []
    for blob in map(spelled, blobs):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        heads.append(unpack(blob, ENTRY, n, 8))
        datas.append(np.frombuffer(blob, np.uint8, offset=8 + n * ENTRY.itemsize))
    return np.concatenate(heads), np.concatenate(datas)


def _hashes(n: np.ndarray, data: np.ndarray, which: int, start: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
    """A hash of the symbols start[i]:end[i] of each piece (all without end), worked on a megabyte at a time."""
    start, end = np.broadcast_to(start, n.shape), n if end is None else end
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    out, lo = np.empty(len(n), np.uint64), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 20), "right")) - 1)
        first = total[lo:hi] - total[lo]
        out[lo:hi] = Hasher(BYTE_KEYS[which][data[total[lo] : total[hi]]]).windows(first + start[lo:hi], first + end[lo:hi])
        lo = hi
    return out


def _equal(entries: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, number of the piece, its smallest document, hash): entries in order of piece, equal bytes being one (128 bits of hashes)."""
    n = entries["length"].astype(np.int64)
    one, two = (_hashes(n, data, i) for i in (0, 1))
    order = np.argsort(one)
    one, two, doc = one[order], two[order], entries["doc"][order]
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    return order, np.cumsum(new) - 1, np.minimum.reduceat(doc, np.flatnonzero(new)), two


def _find_pieces(window: int):
    return lambda blocks: _pieces(window, blocks)


def _pieces(window: int, blocks: int):
    """Texts of the listed paths, or their windows, by block of their anchor. Equal ones of a task go on for their smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            entries, block, data = (np.concatenate(x) for x in zip(*held, strict=True))
            n = entries["length"].astype(np.int64)
            first = np.cumsum(n) - n
            order, piece, least, h = _equal(entries, data)
            copy = entries["doc"][order] > least[piece]
            e = entries[order[copy]]
            yield from removed(e["doc"], e["start"], e["length"], h[copy], blocks)
            keep = order[~copy]
            keep = keep[np.lexsort((entries["doc"][keep], entries["key"][keep], block[keep]))]
            yield from dealt_out(PACKED, block, keep, lambda i: _with_text(entries[i], first[i], data))

        for entries, heads, docs in meeting(batches, ENTRY):
            ids = docs.column("doc").to_numpy()
            for lo, hi, data, at in slices(docs.column("text")):
                row, e = of_rows(ids[lo:hi], entries)
                start, n = at[row] + entries["start"][e], entries["length"][e].astype(np.int64)
                fits = start + n <= at[row + 1]  # another row may have the id
                e, start, n = e[fits], start[fits], n[fits]
                if not len(e):
                    continue
                own, block = entries[e], heads[e]
                apart = own["offset"] == APART
                if apart.any():  # windows instead, each by its hash
                    many = np.where(apart, n - window + 1, 1)
                    start, own, block = spread(start, many), np.repeat(own, many), np.repeat(block, many)
                    inside, apart = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many), np.repeat(apart, many)
                    h = Hasher(BYTE_KEYS[0][data], 1).windows(start[apart], start[apart] + window)
                    own["start"] += inside.astype(np.uint32)
                    own["key"][apart], own["length"][apart], own["offset"][apart] = h & np.uint64(0xFFFFFFFF), window, 0
                    block[apart] = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
                held.append((own, block, data[spread(start, own["length"].astype(np.int64))]))
                count += len(held[-1][2])
                if count >= FLUSH_BYTES:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return run


def _may_match(entries: np.ndarray, data: np.ndarray, some: np.ndarray, k: int, window: int) -> np.ndarray:
    """Of pieces ``some``, those that share their anchor and half a window's rest on one side with another of them.

    A window that two paths share holds the anchor at one place in both, so of its other bytes at
    least half are on one side of it, and agree. Others can't match and are not indexed. A single
    window (of one length, so with nothing beside itself) has no equal among different pieces.
    """
    half = (window - k) // 2
    n, offset = entries["length"].astype(np.int64), entries["offset"].astype(np.int64)
    keep = np.zeros(len(some), bool)
    for start, end in ((offset - half, offset + k), (offset, offset + k + half)):
        fits = (start >= 0) & (end <= n)
        h = _hashes(n, data, 0, np.where(fits, start, 0), np.where(fits, end, 0))[some]
        there = np.flatnonzero(fits[some])
        order = there[np.argsort(h[there])]
        if not len(order):
            continue
        same = h[order][1:] == h[order][:-1]
        keep[order[np.append(same, False) | np.append(False, same)]] = True
    return keep


def _covered(docs: np.ndarray, n: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(piece, first, end, hash) of the runs of symbols of each piece that a window of a smaller document covers."""
    size = n + 1
    ends = np.cumsum(size) - 1
    code = np.zeros(256, np.int64)
    code[data] = 1
    code = np.cumsum(code) * code
    text = np.zeros(int(size.sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = code[data]
    left = np.repeat(ends, size) - np.arange(len(text)) + 1
    which = np.repeat(np.arange(len(n)), size)
    hit = np.flatnonzero(docs[which] > docs[which[_earliest(text, left, window)]])
    if not len(hit):
        return hit, hit, hit, hit.astype(np.uint64)
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]]))
    at = np.flatnonzero(new)
    piece = which[hit[at]]
    base = ends[piece] - n[piece]
    first, end = hit[at] - base, hit[np.append(at[1:], len(hit)) - 1] + window - base
    before = (np.cumsum(n) - n)[piece]
    return piece, first, end, Hasher(BYTE_KEYS[1][data]).windows(before + first, before + end)


def _index_blocks(k: int, window: int):
    def of(blocks: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tile in groups(batches, "block"):
                blobs = tile.filter(pc.equal(tile["kind"], PACKED))["blob"].to_pylist()
                yield from tile.filter(pc.not_equal(tile["kind"], PACKED)).to_batches()
                if not blobs:
                    continue
                raw, data = _parted(blobs)
                blobs.clear()
                # equal pieces are indexed once, for their smallest document, which has all their windows
                order, piece, least, h = _equal(raw, data)
                length = raw["length"].astype(np.int64)
                first = (np.cumsum(length) - length)[order]
                entries, n = raw[order], length[order]
                late = entries["doc"] > least[piece]
                e = entries[late]
                yield from removed(e["doc"], e["start"], e["length"], h[late], blocks)
                at = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
                some = at[_may_match(raw, data, order[at], k, window)]
                some = some[np.argsort(entries["key"][some])]
                key, total = entries["key"][some], np.cumsum(n[some])
                edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(some) else np.zeros(1, np.int64)
                found, lo = [], 0
                while lo < len(edges) - 1:  # whole anchors together
                    start = total[edges[lo] - 1] if edges[lo] else 0
                    hi = max(lo + 1, int(np.searchsorted(total[edges[1:] - 1], start + INDEX_BYTES, "right")))
                    # by document: the first place of a window is in its smallest
                    part = some[edges[lo] : edges[hi]]
                    part = part[np.argsort(least[piece[part]], kind="stable")]
                    p, a, b, h = _covered(least[piece[part]], n[part], data[spread(first[part], n[part])], window)
                    found.append((piece[part[p]], a, b, h))
                    lo = hi
                if not found:
                    continue
                p, a, b, h = (np.concatenate(x) for x in zip(*found, strict=True))
                # what goes of a piece goes at each place where its smallest document has it
                order = np.argsort(p, kind="stable")
                p, a, b, h = p[order], a[order], b[order], h[order]
                own = np.flatnonzero(~late)
                lo, hi = np.searchsorted(p, piece[own]), np.searchsorted(p, piece[own], "right")
                e, s = np.repeat(own, hi - lo), spread(lo, hi - lo)
                yield from removed(entries["doc"][e], entries["start"][e] + a[s], (b - a)[s], h[s], blocks)

        return run

    return of


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spans, _, docs in meeting(batches, SPAN):
            ids = docs.column("doc")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            first = docs.column("first")
            copy = first.is_valid().to_numpy(zero_copy_only=False) & known
            copy &= ids > first.fill_null(0).to_numpy()
            for lo, hi, data, at in slices(docs.column("text")):
                units = Units(data, at, False)
                size = np.diff(at)
                row, e = of_rows(ids[lo:hi], spans)
                mine = known[lo:hi][row]
                gone = marked(units, row[mine], spans[e[mine]], copy[lo:hi] & (size >= window))
                row = np.repeat(np.arange(hi - lo), size)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(np.bincount(row[gone], minlength=hi - lo), pa.int64()), pa.array(np.bincount(row[begins], minlength=hi - lo), pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def dedup_bytes(docs: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay) of every row.

    A byte goes if a ``window``-byte string over it also starts in a document of a smaller id, judged on
    the input; strings never cross documents. Pieces of text around an anchor that several documents
    have meet in a block of that anchor. There equal pieces are one, and a run-length index is built
    of all that may match: its matching statistics, from samples at the run ends, link each position
    with another one that begins with the same window, and the first place of each chain of links
    tells the smallest document. An index holds whole anchors and is dropped when its task ends.

    Null and empty texts have no bytes. Null ids take no part: such a row keeps all. Rows of equal
    ids, repeated rows among them, don't remove each other's bytes; all are removed alike by smaller
    ids. Ties need no rule, as only a smaller id removes. A very long text is one row's work, linear
    in its bytes. An empty table gives none. Kept bytes need not be whole characters. Other columns,
    whatever their names, are not read.
    """
    texts, size = set_aside(docs, key)
    return removed_spans(texts, size, K, window, _find_pieces(window), _index_blocks(K, window), _kept(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(ids: list, texts: list, window: int = WINDOW) -> pd.DataFrame:
    """The same from a table of all strings, for small tables."""
    raw = [(t or "").encode() for t in texts]
    least: dict = {}
    for i, b in zip(ids, raw, strict=True):
        for s in range(len(b) - window + 1):
            k = b[s : s + window]
            if least.setdefault(k, i) > i:
                least[k] = i
    out = []
    for i, b in zip(ids, raw, strict=True):
        gone = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - window + 1):
            if least[b[s : s + window]] < i:
                gone[s] += 1
                gone[s + window] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
