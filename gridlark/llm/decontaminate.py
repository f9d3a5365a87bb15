"""Benchmark decontamination by an FM-index per shard of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import saved, table
from .suffixes import suffix_order
from .text import LOWER, NOT_ALNUM, Words, slices, small_ints

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Symbols of a piece of indexed text; the next piece repeats the last WINDOW - 1 of them.
PIECE = 64
#: Every so many positions of a piece, from its first, the suffix array is kept.
SAMPLE = 8
#: Symbols of one index at most.
SHARD_SYMBOLS = 1 << 20
#: Bytes of benchmark texts searched in one pass over the documents; more make more passes.
BLOCK_BYTES = 32 << 20


class WaveletMatrix:
    """Ranks of every symbol of a sequence, a bit level at a time from the highest bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        s = symbols
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] is among the first at[i]."""
        lo, hi = np.zeros_like(at), at
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[at + 1] - ones[at] == 1
            a, b = ones[lo], ones[at]
            lo, at = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - lo


class FMIndex:
    """Of pieces of at most PIECE symbols over 1..top, each ended by symbol 0; ends are ordered by position."""

    def __init__(self, text: np.ndarray, left: np.ndarray, sampled: np.ndarray, top: int):
        """left[i]: symbols from i to the end of its piece, the 0 included; sampled[i]: position i is kept."""
        n = len(text)
        order = suffix_order(text, left, top)
        self.bwt = text[order - 1].astype(np.int64)  # a piece's first row has the 0 before it, or the last 0
        self.below = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletMatrix(self.bwt, max(1, int(top).bit_length()))
        keep = sampled[order]
        self.kept_before = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
        self.keep, self.kept = keep, order[keep]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns, searched backward together; patterns are padded at the right."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < lengths) & (hi > lo))
            if len(live):
                c = patterns[live, j]
                lo[live], hi[live] = self.below[c] + self.tree.rank(c, lo[live]), self.below[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the left until a kept position."""
        found, steps, ids = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(ids):
            done = self.keep[rows]
            found[ids[done]] = self.kept[self.kept_before[rows[done]]] + steps
            ids, rows, steps = ids[~done], rows[~done], steps + 1
            if len(ids):
                c, r = self.tree.access(rows)
                rows = self.below[c] + r
        return found


class Benchmark:
    """Windows of a block of items, over the dictionary of their words."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        column = pa.array(texts, pa.string())
        hashes, owner = [], []
        for lo, hi, data, at in slices(column):
            data = LOWER[data]
            words = Words(data, at, NOT_ALNUM)
            hashes.append(words.hashes(data))
            owner.append(words.row + lo)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        row = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.words = np.unique(h)
        code = np.searchsorted(self.words, h).astype(np.int64) + 1
        counts = np.bincount(row, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        patterns, item = [], []
        for i, n in enumerate(counts):
            for s in range(max(1, n - window + 1) if n else 0):
                patterns.append(code[first[i] + s : first[i] + min(n, s + window)])
                item.append(i)
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        padded = np.zeros((len(patterns), window), np.int64)
        for p, x in zip(padded, patterns, strict=True):
            p[: len(x)] = x
        self.window = window
        self.shortest = int(self.lengths.min(initial=window))
        if len(patterns):
            self.patterns, to = np.unique(padded, axis=0, return_inverse=True)
            to = to.reshape(-1)
        else:
            self.patterns, to = padded, np.zeros(0, np.int64)
        self.lengths = (self.patterns > 0).sum(1)
        by = np.argsort(to, kind="stable")
        self.items = np.array(item, np.int64)[by]
        self.first_item = np.searchsorted(to[by], np.arange(len(self.patterns) + 1))
        self.ids = [str(i) for i in ids]


def _occurrences(code: np.ndarray, row: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(word position, pattern) of all windows in a run of documents, where code is 0 outside the dictionary.

    A word that no item has ends a stretch; stretches shorter than every window can't match. Both
    are left out of the index, which loses nothing.
    """
    n = len(code)
    edge = np.ones(n + 1, bool)
    edge[1:n] = (row[1:] != row[:-1]) | (code[1:] == 0) | (code[:-1] == 0)
    cuts = np.flatnonzero(edge)
    lengths = np.diff(cuts)
    use = (code[cuts[:-1]] > 0) & (lengths >= bench.shortest) if n else np.zeros(0, bool)
    starts, lengths = cuts[:-1][use] if n else cuts[:0], lengths[use]
    step = PIECE - bench.window + 1
    pieces = np.maximum(1, -(-(lengths - bench.window + 1) // step))
    at = np.repeat(starts, pieces) + step * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(PIECE, np.repeat(starts + lengths, pieces) - at)
    positions, patterns = [], []
    total = np.cumsum(size + 1)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SHARD_SYMBOLS, "right")))
        long = size[lo:hi] + 1
        begin = np.cumsum(long) - long
        inside = np.arange(long.sum()) - np.repeat(begin, long)
        source = np.repeat(at[lo:hi], long) + inside
        left = np.repeat(long, long) - inside
        text = np.where(left > 1, code[np.minimum(source, n - 1)], 0)
        index = FMIndex(text, left, inside % SAMPLE == 0, len(bench.words))
        a, b = index.search(bench.patterns, bench.lengths)
        some = np.flatnonzero(b > a)
        many = (b - a)[some]
        rows = np.repeat(a[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found = index.locate(rows)
        positions.append(source[found])
        patterns.append(np.repeat(some, many))
        lo = hi
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(positions), np.concatenate(patterns)


def _marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True inside any of the spans: their union."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def _scan(column: pa.Array, bench: Benchmark) -> Iterator[tuple]:
    """For each run of rows: first row, bytes and offsets of the texts, words, hit words, (row, item) pairs."""
    for lo, hi, data, at in slices(column):
        data = LOWER[data]
        words = Words(data, at, NOT_ALNUM)
        code = small_ints(words.hashes(data), bench.words) + 1
        pos, pat = _occurrences(code, words.row, bench)
        hit = _marked(len(code), pos, pos + bench.lengths[pat])
        many = bench.first_item[pat + 1] - bench.first_item[pat]
        item = bench.items[np.repeat(bench.first_item[pat], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        pairs = np.unique(np.repeat(words.row[pos], many) * max(1, len(bench.ids)) + item)
        yield lo, hi, at, words, hit, pairs // max(1, len(bench.ids)), pairs % max(1, len(bench.ids))


def _blocks(benchmark: DataFrame, id_col: str, limit: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about ``limit`` bytes; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(id_col, "text").toLocalIterator(prefetchPartitions=False):
        ids.append(r[0])
        texts.append(r[1] or "")
        size += len(texts[-1])
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


HITS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_STATE = "doc_id long, text string, hit binary, items array<string>"


def _each_block(benchmark: DataFrame, id_col: str) -> Iterator[tuple[Benchmark, bool]]:
    """The blocks of the benchmark, one at a time, and whether it is the last."""
    before = None
    for ids, texts in _blocks(benchmark, id_col, BLOCK_BYTES):
        if before is not None:
            if not ids:
                break
            yield Benchmark(*before), False
        before = ids, texts
    yield Benchmark(*before), True


def _hits(batch: pa.RecordBatch, bench: Benchmark) -> Iterator[tuple]:
    """first row, last row + 1, words, hit words and items of each row, those of earlier blocks included."""
    known = "hit" in batch.schema.names
    for lo, hi, _, words, hit, rows, item in _scan(batch.column("text"), bench):
        items: list[list] = [[] for _ in range(hi - lo)]
        for r, i in zip(rows.tolist(), item.tolist(), strict=True):
            items[r].append(bench.ids[i])
        if known:
            part = batch.slice(lo, hi - lo)
            hit |= np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=n) for h, n in zip(part.column("hit").to_pylist(), words.per_row.tolist(), strict=True)]).astype(bool)
            items = [a + b for a, b in zip(items, part.column("items").to_pylist(), strict=True)]
        yield lo, hi, words, hit, [sorted(set(x)) for x in items]


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids with an occurring window), spans (hit runs of words) of every document.

    A shard is a run of whole documents inside a task; its index is built, searched and dropped
    there, so a lost executor costs the shards of its tasks and no shuffle is needed. The benchmark is
    the query set: it goes to all tasks in blocks of BLOCK_BYTES. The driver and each task hold one
    block at a time: with more than one, there is a pass over the documents for each, which carries
    the hits so far along with the row and is written before the next.

    Null and empty texts have no words. Rows that repeat are reported each, so ties need no rule.
    Items of equal text are all reported; items without words never. Null ids stay null. Memory is
    linear in the longest text. An empty table gives none. Other columns, whatever their names, are
    not read.
    """
    sc = docs.sparkSession.sparkContext
    table_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for bench, last in _each_block(benchmark, id_col):
        shared = sc.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for lo, hi, words, hit, items in _hits(batch, shared.value):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    s, e = edge[0::2], edge[1::2]
                    # a run that goes on over a document's end is two spans
                    cut = words.first_word[1:-1]
                    extra = cut[(cut > 0) & (cut < len(hit))]
                    extra = np.unique(extra[hit[extra] & hit[extra - 1]]) if len(extra) else extra
                    s, e = np.sort(np.concatenate([s, extra])), np.sort(np.concatenate([e, extra]))
                    row = words.row[s] if len(s) else s
                    runs: list[list] = [[] for _ in range(hi - lo)]
                    for r, x, y in zip(row.tolist(), (s - words.first_word[row]).tolist(), (e - words.first_word[row]).tolist(), strict=True):
                        runs[r].append({"start": x, "end": y})
                    n_hit = np.bincount(words.row[hit], minlength=hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, hi - lo), pa.array(words.per_row, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                        ["doc_id", "n_words", "n_hit", "items", "spans"],
                    )

        def so_far(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for lo, hi, words, hit, items in _hits(batch, shared.value):
                    packed = [np.packbits(hit[a:b]).tobytes() for a, b in zip(words.first_word[:-1].tolist(), words.first_word[1:].tolist(), strict=True)]
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(packed, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "hit", "items"])

        if last:
            return table_.mapInArrow(run, HITS)
        table_ = saved(table_.mapInArrow(so_far, _STATE))
        shared.unpersist()
    raise AssertionError("there is always a last block")


def cut(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id") -> DataFrame:
    """``docs`` without the spans that benchmark windows hit; other columns stay, but n_chars follows the text.

    A removed span becomes one space. Where the rest still holds a window, because words came
    together, it is cut again. Documents without a hit are unchanged; those with no word left go.
    The benchmark is cut out a block of BLOCK_BYTES at a time, each pass written before the next;
    with more than one block, all again until a round finds no hit.

    Null and empty texts are unchanged. Rows that repeat are cut alike. An empty table gives none.
    """
    sc = docs.sparkSession.sparkContext
    names = docs.columns

    def clean(column: pa.Array, bench: Benchmark) -> tuple[list[str | None], list[bool]]:
        texts, keep = column.to_pylist(), [True] * len(column)
        again = list(range(len(texts)))
        while again:
            part = pa.array([texts[i] for i in again], pa.string())
            hits: list[int] = []
            for lo, _, at, words, gone, _, _ in _scan(part, bench):
                for r in np.unique(words.row[gone]).tolist():
                    i, (a, b) = again[lo + r], words.first_word[r : r + 2]
                    raw, out, last = texts[i].encode(), [], 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                    for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                        out.append(raw[last : words.starts[a + s] - at[r]])
                        last = int(words.ends[a + e - 1] - at[r])
                    texts[i] = b" ".join([*out, raw[last:]]).decode()
                    keep[i] = not gone[a:b].all()
                    hits.append(i)
            again = hits
        return texts, keep

    def one_pass(table_: DataFrame, bench: Benchmark) -> DataFrame:
        shared = sc.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.column("text")
                texts, keep = clean(before, shared.value)
                cols = {n: batch.column(n) for n in names}
                changed = [a != b for a, b in zip(texts, before.to_pylist(), strict=True)]
                cols["text"] = pa.array(texts, before.type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names).filter(pa.array(keep, pa.bool_()))

        return table_.mapInArrow(run, table_.schema)

    blocks = _each_block(benchmark, id_col)
    bench, last = next(blocks)
    if last:
        return one_pass(docs, bench)
    while True:
        docs = saved(one_pass(docs, bench))
        for bench, _ in blocks:
            docs = saved(one_pass(docs, bench))
        if spans(docs, benchmark, id_col).where("n_hit > 0").isEmpty():
            return docs
        blocks = _each_block(benchmark, id_col)
        bench, _ = next(blocks)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(ids: list, texts: list, items: list, item_texts: list, window: int = WINDOW) -> pd.DataFrame:
    """The same by plain Python, for small tables."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for i, t in zip(ids, texts, strict=True):
        w = low(t)
        hit, got = [False] * len(w), set()
        for k, b in zip(items, item_texts, strict=True):
            x = low(b)
            wins = {tuple(x[s : s + window]) for s in range(max(1, len(x) - window + 1))} if x else set()
            for p in wins:
                for s in range(len(w) - len(p) + 1):
                    if tuple(w[s : s + len(p)]) == p:
                        hit[s : s + len(p)] = [True] * len(p)
                        got.add(str(k))
        out.append((i, len(w), sum(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), any(hit)))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
