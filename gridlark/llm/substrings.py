"""Substring dedup by de Bruijn compaction: k-mers of words as edges, compacted through Spark joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .repeats import Units, set_aside, spread
from .store import freed, removed, saved, saved_at, table
from .text import Hasher, slices

WINDOW, K = 50, 16
_SECOND = np.uint64(0x5851F42D4C957F2D)


def _second(units: Units) -> Hasher:
    return Hasher(units.items ^ _SECOND, 1)


def _paths(k: int, window: int):
    """Runs of windows around one anchor: (doc, th, start, n windows, anchor, hash of all words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(batch.column("text")):
                units = Units(data, at, True)
                row, start, end, anchor, _ = units.paths(k, window)
                if not len(row):
                    continue
                h = units.hasher.windows(start, end)
                pick = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pick), batch.column("th").take(pick), pa.array(start - units.first[row], pa.int32()), pa.array(end - start - window + 1, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64))],
                    ["doc", "th", "start", "n", "anchor", "h"],
                )

    return run


def _edges(window: int):
    """Edges of the listed paths, in the order of the document: whole ones, and of others each window.

    An edge is known by 96 bits, e and f. pv and nx are f of the edges before and after, 0 where the listed words don't go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(batch.column("text")):
                units = Units(data, at, True)
                lists = [batch.column(c).slice(lo, hi - lo) for c in ("starts", "ns", "whole")]
                many = np.diff(lists[0].offsets.to_numpy())
                row = np.repeat(np.arange(hi - lo), many)
                start, n, whole = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                order = np.lexsort((start, row))
                row, start, n, whole = row[order], start[order] + units.first[row[order]], n[order], whole[order] > 0
                times = np.where(whole, 1, n)
                row, start, n = np.repeat(row, times), spread(start, times), np.repeat(np.where(whole, n, 1), times)
                if not len(row):
                    continue
                end = start + n + window - 1
                one, two = units.hasher.windows(start, end), _second(units).windows(start, end)
                name = ((two >> np.uint64(32)) | np.uint64(1)).astype(np.uint32).view(np.int32)
                on = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + n[:-1])
                pv, nx = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
                pv[1:][on], nx[:-1][on] = name[:-1][on], name[1:][on]
                pick = pa.array(row + lo)
                th = batch.column("th").take(pick).to_numpy().astype(np.int64) & 0xFFFFFFFF
                place = ((start - units.first[row]) << 32) | th
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pick), pa.array(place), pa.array(n, pa.int32()), pa.array(one.view(np.int64)), *map(pa.array, (name, pv, nx))],
                    ["doc", "place", "n", "e", "f", "pv", "nx"],
                )

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of edges, sorted by place, that go on along one unitig: (doc, th, start, n, src, src_th, src_start)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, place, n, src, from_, unitig = (batch.column(c).to_numpy() for c in ("doc", "place", "n", "src", "src_place", "unitig"))
        start, th, a = place >> 32, place & 0xFFFFFFFF, from_ >> 32
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (src[1:] != src[:-1]) | (unitig[1:] != unitig[:-1])
        new[1:] |= (start[1:] != start[:-1] + n[:-1]) | (a[1:] != a[:-1] + n[:-1])
        at = np.flatnonzero(new)
        cols = [doc[at], th[at], start[at], np.add.reduceat(n.astype(np.int64), at), src[at], from_[at] & 0xFFFFFFFF, a[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "th", "start", "n", "src", "src_th", "src_start"])


def _listed(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row, fields) of a column of lists of structs."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return row, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _source_words(window: int):
    """Of the spans asked of each source document: 128 bits of hashes of the words that it has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(batch.column("text")):
                units = Units(data, at, True)
                row, asked = _listed(batch.column("asked").slice(lo, hi - lo))
                start = asked["src_start"] + units.first[row]
                end = start + asked["n"] + window - 1
                ok = end <= units.first[row + 1]
                row, start, end = row[ok], start[ok], end[ok]
                pick = pa.array(row + lo)
                h = [x.windows(start, end).view(np.int64) for x in (units.hasher, _second(units))]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pick), batch.column("th").take(pick), pa.array(asked["src_start"][ok]), pa.array(asked["n"][ok]), *map(pa.array, h)], ["src", "src_th", "src_start", "n", "v", "w"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, first = batch.column("doc").to_pylist(), batch.column("first").to_pylist()
            for lo, hi, data, at in slices(batch.column("text")):
                units = Units(data, at, True)
                words, n = units.words, len(units.items)
                row, spans = _listed(batch.column("spans").slice(lo, hi - lo).fill_null([]))
                start = spans["start"] + units.first[row]
                end = start + spans["n"] + window - 1
                ok = end <= units.first[row + 1]
                start, end = start[ok], end[ok]
                same = np.ones(len(start), bool)
                for x, c in ((units.hasher, "v"), (_second(units), "w")):
                    same &= x.windows(start, end).view(np.int64) == spans[c][ok]
                d = np.bincount(start[same], minlength=n + 1) - np.bincount(end[same], minlength=n + 1)
                copy = np.array([f is not None and i is not None and i > f and m >= window for i, f, m in zip(doc[lo:hi], first[lo:hi], words.per_row.tolist(), strict=True)], bool)
                gone = (np.cumsum(d[:n]) > 0) | copy[words.row]
                texts, raw = [], data.tobytes()
                for r in range(hi - lo):
                    a, b = words.first_word[r], words.first_word[r + 1]
                    keep = np.flatnonzero(~gone[a:b]) + a
                    texts.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), pa.array(words.per_row, pa.int64()), pa.array(np.bincount(words.row[gone], minlength=hi - lo), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def unitigs(edges: DataFrame) -> DataFrame:
    """(e, f, src, src_place, unitig) of the edges that several documents have.

    edges: occurrences (doc, place, n, e, f, pv, nx). An edge's source is its first place in its
    smallest document. An edge and the next are compacted where the node between them has one
    way in and one way out, and their sources follow each other; a unitig is a chain of such
    edges, so one stretch of one source document.
    """
    degree = lambda c: F.when(F.min(c) == F.max(c), F.min(c))  # noqa: E731  the one neighbour; null: several
    known = edges.groupBy("e", "f").agg(
        F.min("doc").alias("src"), F.max("doc").alias("most"), F.min_by("place", "doc").alias("src_place"), F.first("n").alias("n"),
        degree(F.when(F.col("nx") != 0, F.col("nx"))).alias("out"), degree(F.when(F.col("pv") != 0, F.col("pv"))).alias("in"),
    ).where("src < most").drop("most")
    known = saved(known)
    start = F.shiftright("src_place", 32)
    th = F.col("src_place").bitwiseAND(F.lit(0xFFFFFFFF))
    ends = known.where("out is not null").select("src", th.alias("th"), (start + F.col("n")).alias("at"), F.col("out").alias("f"), F.col("f").alias("in"))
    begins = known.withColumn("th", th).withColumn("at", start.cast("long"))
    chained = begins.join(ends.withColumn("on", F.lit(1)), ["src", "th", "at", "f", "in"], "left")
    chained = chained.withColumn("unitig", F.sum(F.when(F.col("on").isNull(), 1).otherwise(0)).over(W.partitionBy("src", "th").orderBy("at", "e").rowsBetween(W.unboundedPreceding, 0)))
    return chained.select("e", "f", "src", "src_place", "unitig")


def dedup_words(docs: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by one space) of every row.

    A word goes if one of its ``window``-word windows also starts in a document of a smaller id,
    judged on the input. Edges of the graph are the windows (nodes are the window - 1 words between
    two). Windows of a document with one anchor, a K-word k-mer, are a run; anchors that one document
    has alone can't repeat and are left out, and where all documents have the same run it is one
    edge from the start. Degrees come from the edges before and after each occurrence; chains
    without branches are compacted through joins (see unitigs()). A document's edges become spans
    along unitigs, and a span counts if the words of its source document at the source's
    coordinates are the document's own (128 bits of hashes, each from its own text).

    Null and empty texts have no words. Null ids take no part: such a row keeps all its words. Rows
    of equal ids, repeated rows among them, don't remove each other's words, and are told apart by
    their text. Documents of fewer words than a window are kept. Ties need no rule, as only a smaller
    id removes. A very long text is one row's work, linear in its words. An empty table gives none.
    Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    texts, _ = set_aside(docs, key)
    unique = texts.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    texts = texts.withColumn("th", F.lit(0).cast("long") if unique else F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    others = texts.where("doc is not null and (first is null or doc <= first)").select("doc", "th", "text")
    paths, at_paths = saved_at(others.mapInArrow(_paths(K, window), "doc long, th long, start int, n int, anchor long, h long"))
    # each step is written, so that shuffle files of one go before the next; and joins on hot keys read exchanges that can be split
    anchors = paths.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("h") == F.max("h")).cast("int").alias("whole"))
    anchors, at_anchors = saved_at(anchors.where("lo < hi").select("anchor", "whole"))
    freed(spark)
    lists = paths.select("doc", "th", "start", "n", "anchor").join(anchors, "anchor").groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n", "whole")).alias("l"))
    lists, at_lists = saved_at(lists.select("doc", "th", *[F.col(f"l.{c}").alias(d) for c, d in (("start", "starts"), ("n", "ns"), ("whole", "whole"))]))
    removed(spark, at_paths)
    removed(spark, at_anchors)
    freed(spark)
    edges = others.join(lists, ["doc", "th"]).mapInArrow(_edges(window), "doc long, place long, n int, e long, f int, pv int, nx int")
    edges, at_edges = saved_at(edges)
    removed(spark, at_lists)
    freed(spark)
    chains, at_chains = saved_at(unitigs(edges))
    freed(spark)
    walked = edges.select("doc", "place", "n", "e", "f").join(chains, ["e", "f"]).where("src < doc").select("doc", "place", "n", "src", "src_place", "unitig")
    th = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    walked = walked.repartition("doc", th).sortWithinPartitions("doc", th, "place")
    spans, at_spans = saved_at(walked.mapInArrow(_spans, "doc long, th long, start long, n long, src long, src_th long, src_start long").distinct())
    removed(spark, at_edges)
    removed(spark, at_chains)
    freed(spark)
    asked = spans.select("src", "src_th", "src_start", "n").distinct().groupBy(F.col("src").alias("doc"), F.col("src_th").alias("th")).agg(F.collect_list(F.struct("src_start", "n")).alias("asked"))
    sources = others.join(asked, ["doc", "th"]).mapInArrow(_source_words(window), "src long, src_th long, src_start long, n long, v long, w long").distinct()
    verified = spans.join(sources, ["src", "src_th", "src_start", "n"]).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n", "v", "w")).alias("spans"))
    verified = saved(verified)
    removed(spark, at_spans)
    freed(spark)
    rows = texts.join(verified, ["doc", "th"], "left").select("doc", "text", "first", "spans")
    return rows.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_words(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(ids: list, texts: list, window: int = WINDOW) -> pd.DataFrame:
    """The same from a table of all windows, for small tables."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    least: dict = {}
    for i, w in zip(ids, words, strict=True):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
