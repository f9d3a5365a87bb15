"""Quality by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import Logistic, first_by_hash, rows_of, sigmoid
from .store import table
from .text import SPACE, Words, slices

#: Fitting takes so many labelled and so many other documents at most.
MAX_LABELLED, MAX_POOL = 8000, 8000
ROUNDS, GROWTH = 5, 0.1
META_BUCKETS = 32

_KINDS = np.zeros((256, 7), np.float64)
_KINDS[0x41:0x5B, 0] = _KINDS[0x61:0x7B, 1] = _KINDS[0x30:0x3A, 2] = _KINDS[0x80:, 3] = 1
_KINDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F, 0x27, 0x22], 4] = 1  # sentence marks
_KINDS[0x0A, 5] = 1
_KINDS[:, 6] = _KINDS[:, :6].sum(1) == 0
_KINDS[SPACE, 6] = 0


def text_view(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of byte kinds, word lengths, capital words and repeated words of each text."""
    n = len(at) - 1
    size = np.maximum(1, np.diff(at)).astype(float)
    row = np.repeat(np.arange(n), np.diff(at))
    cols = [np.bincount(row, _KINDS[data, k], n) / size for k in range(7)]
    words = Words(data, at, SPACE)
    many = np.maximum(1, words.per_row).astype(float)
    length = (words.ends - words.starts).astype(float)
    h = words.hashes(data)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    pair = np.unique((words.row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    capital = (data[words.starts] >= 0x41) & (data[words.starts] <= 0x5A)
    odd = _KINDS[data[words.ends - 1], 6]
    for x in (same, capital, odd, (length <= 1).astype(float)):
        cols.append(np.bincount(words.row, x, n) / many)
    mean = np.bincount(words.row, length, n) / many
    cols += [mean, np.sqrt(np.maximum(0, np.bincount(words.row, length**2, n) / many - mean**2))]
    cols.append(np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=n) / many)
    cols.append(np.log1p(many))
    return np.column_stack(cols)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the length that the page's metadata states."""
    out = np.zeros((len(source), META_BUCKETS * 2 + 2))
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32(str(s).encode()) % META_BUCKETS] = 1
        out[i, META_BUCKETS + zlib.crc32(str(g).encode()) % META_BUCKETS] = 1
        size = np.log1p(max(0, c or 0))
        out[i, -2:] = size, size * size
    return out


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo, hi, data, at in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            yield part.column(0), text_view(data, at), meta_view(*(part.column(k).to_pylist() for k in (2, 3, 4)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, a, b in _views(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())], ["doc_id", "a", "b"])


class CoTraining:
    """Two classifiers of two views.

    In each round either view labels the pool rows that it is surest of, in the labelled rows' share
    of classes, for the other view's training set. After the last round each view is calibrated, and
    the calibrated views are combined, on labelled rows that no view was trained on.
    """

    def __init__(self, rounds: int = ROUNDS, growth: float = GROWTH):
        self.rounds, self.growth = rounds, growth

    def fit(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> CoTraining:
        check = np.arange(len(y)) % 4 == 3
        if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
            check = np.zeros(len(y), bool)
        own = [(v[~check], y[~check]) for v in labelled]
        taught = [(v[:0], y[:0]) for v in labelled]
        free = [np.ones(len(pool[0]), bool) for _ in labelled]
        share = float(np.clip(y.mean(), 0.02, 0.98))
        self.views = [Logistic().fit(*o) for o in own]
        for _ in range(self.rounds):
            for v in (0, 1):
                other, rest = 1 - v, np.flatnonzero(free[1 - v])
                if not len(rest):
                    continue
                p = self.views[v].proba(pool[v][rest])
                n = max(1, int(len(free[v]) * self.growth))
                order = np.argsort(p, kind="stable")
                low, high = order[: int(round(n * (1 - share)))], order[::-1][: int(round(n * share))]
                low, high = low[p[low] < 0.2], high[p[high] > 0.8]  # confident ones only
                pick = rest[np.concatenate([low, high])]
                taught[other] = (np.concatenate([taught[other][0], pool[other][pick]]), np.concatenate([taught[other][1], np.zeros(len(low)), np.ones(len(high))]))
                free[other][pick] = False
            for v in (0, 1):
                x, t = np.concatenate([own[v][0], taught[v][0]]), np.concatenate([own[v][1], taught[v][1]])
                self.views[v] = Logistic().fit(x, t, np.concatenate([np.ones(len(own[v][1])), np.full(len(taught[v][1]), 0.5)]))
        held = check if check.any() else np.ones(len(y), bool)
        logits = [self.views[v].logit(labelled[v][held])[:, None] for v in (0, 1)]
        self.calibration = [Logistic().fit(z, y[held]) for z in logits]
        both = np.column_stack([c.logit(z) for c, z in zip(self.calibration, logits, strict=True)])
        self.top = Logistic().fit(both, y[held])
        return self

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [c.logit(v.logit(x)[:, None]) for c, v, x in zip(self.calibration, self.views, (a, b), strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), self.top.proba(np.column_stack(z))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> CoTraining | None:
    """None where the labels don't hold both classes."""
    spark = docs.sparkSession
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
    marked = first_by_hash(marked, max_labelled, 3).toPandas()
    pool = first_by_hash(docs.where("doc_id is not null").select("doc_id").distinct(), max_pool, 4).toPandas()
    if marked["quality"].nunique() < 2:
        return None
    ids = sorted({*map(int, marked["doc_id"]), *map(int, pool["doc_id"])})
    chosen = rows_of(docs.select("doc_id", "text", "source", "lang", "n_chars"), spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    got = chosen.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(_sampled, "doc_id long, a binary, b binary").toArrow()
    rows = dict(zip(got["doc_id"].to_pylist(), zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True), strict=True))
    known = dict(zip(map(int, marked["doc_id"]), map(float, marked["quality"]), strict=True))
    mine = [i for i in known if i in rows]
    rest = sorted(i for i in map(int, pool["doc_id"]) if i not in known and i in rows)
    y = np.array([known[i] for i in mine])
    if len(set(y)) < 2:
        return None
    stack = lambda at, k: np.array([np.frombuffer(rows[i][k]) for i in at]).reshape(len(at), -1)
    labelled, free = tuple(stack(mine, k) for k in (0, 1)), tuple(stack(rest, k) if rest else stack(mine[:1], k)[:0] for k in (0, 1))
    return CoTraining().fit(labelled, y, free)


def score(docs: DataFrame, model: CoTraining | None) -> DataFrame:
    """doc_id, p_text, p_meta (calibrated views) and score of every whole document.

    Null and empty texts have the features of no word, null metadata is a value of its own. Without
    a model every score is 1, so nothing is rejected. Rows that repeat are scored each, and alike;
    ties need no rule. Memory is linear in the longest text. An empty table gives none. Other
    columns, whatever their names, are not read.
    """
    if model is None:
        return docs.select("doc_id", *[F.lit(1.0).alias(c) for c in ("p_text", "p_meta", "score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, a, b in _views(batches):
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.float64()) for x in shared.value.scores(a, b))], ["doc_id", "p_text", "p_meta", "score"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, p_text double, p_meta double, score double")


def accepted(docs: DataFrame, model: CoTraining | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is at least ``least``."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = batch.select(["doc_id", "text", "source", "lang", "n_chars"])
            score_ = [shared.value.scores(a, b)[2] for _, a, b in _views([views])]
            if score_:
                yield batch.filter(pa.array(np.concatenate(score_) >= least))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("keep"))
