"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) on hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import first_by_hash, fold, rows_of, sigmoid
from .store import saved, table
from .text import BYTE_KEYS, LOWER, NOT_ALNUM, Hasher, Words, slices

BITS = 20
#: Fitting takes so many confirmed toxic and so many unlabelled documents at most, of any length: the driver gets a count
#: for each of 2 ** BITS features, and of each document the features that the model uses.
MAX_POSITIVE, MAX_UNLABELLED = 4096, 12288
#: A word counts as itself and by its first so many bytes, where it is longer.
PREFIXES = (4, 5, 6)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning of a run of texts; not yet distinct."""
    data = LOWER[data]
    words = Words(data, at, NOT_ALNUM)
    hashed = Hasher(BYTE_KEYS[0][data], 0)
    shift = np.uint64(64 - BITS)
    rows, feats = [words.row], [hashed.windows(words.starts, words.ends) >> shift]
    for n in PREFIXES:
        long = words.ends - words.starts > n
        s = words.starts[long]
        rows.append(words.row[long])
        feats.append((hashed.windows(s, s + n) ^ np.uint64(0x5DEECE66D0000000 + (n << 52))) >> shift)
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def distinct(row: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | feat)
    return both >> BITS, both & ((1 << BITS) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many confirmed and unlabelled documents of a task each feature is."""
    count = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        kinds = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("unlabelled", "positive")]
        for lo, hi, data, at in slices(batch.column("text")):
            row, feat = distinct(*features(data, at))
            for k in (0, 1):
                count[k] += np.bincount(feat[kinds[k][lo:hi][row]], minlength=1 << BITS)
    some = np.flatnonzero(count.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[0][some]), pa.array(count[1][some])], ["feat", "u", "p"])


def _sampled(use: np.ndarray):
    """Of each document, which of the sorted features ``use`` it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.full(1 << BITS, -1, np.int32)
        known[use] = np.arange(len(use))
        for batch in batches:
            for lo, hi, data, at in slices(batch.column("text")):
                row, feat = distinct(*features(data, at))
                row, feat = row[known[feat] >= 0], known[feat[known[feat] >= 0]]
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [feat[ends[i] : ends[i + 1]].tobytes() for i in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), part.column("unlabelled"), pa.array(packed, pa.binary())], ["doc_id", "positive", "unlabelled", "feats"])

    return run


class NonNegativePU:
    """Linear model of binary features under the non-negative PU risk with the logistic loss.

    risk = prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]). Where the second term is
    below zero its gradient is turned round, which undoes overfitting to the unlabelled rows.
    """

    def __init__(self, prior: float, epochs: int = 150, rate: float = 0.1, decay: float = 2e-5, least: int = 3):
        self.prior, self.epochs, self.rate, self.decay, self.least = prior, epochs, rate, decay, least

    def chosen(self, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
        """Features whose excess in the positives is more than chance finds in so many of them (Poisson deviance)."""
        due = n_p * (in_u + 1) / (n_u + 2)
        excess = in_p * np.log(np.maximum(in_p, 1) / due) - (in_p - due)
        return np.flatnonzero((in_p > due) & (in_p >= self.least) & (excess >= np.log(max(2, (in_p > 0).sum()))))

    def fit(self, use: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> NonNegativePU:
        """From the features of each document, as positions in ``use``."""

        def csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
            return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), flat

        (pr, pc), (ur, uc) = csr(positive), csr(unlabelled)
        n_p, n_u, m = max(1, len(positive)), max(1, len(unlabelled)), len(use)
        w, bias = np.zeros(m), float(np.log(self.prior / (1 - self.prior)))
        m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
        for t in range(1, self.epochs + 1):
            fp = np.bincount(pr, w[pc], len(positive)) + bias
            fu = np.bincount(ur, w[uc], len(unlabelled)) + bias
            loss_u = np.logaddexp(0, fu).mean() if len(fu) else 0.0
            loss_p = np.logaddexp(0, fp).mean() if len(fp) else 0.0
            gap = loss_u - self.prior * loss_p
            # d/df: l(f) = log(1 + e^-f), l(-f) = log(1 + e^f)
            g_pos = self.prior * (sigmoid(fp) - 1) / n_p
            g_neg_p, g_neg_u = -self.prior * sigmoid(fp) / n_p, sigmoid(fu) / n_u
            a, b = (g_pos + g_neg_p, g_neg_u) if gap >= 0 else (-g_neg_p, -g_neg_u)
            grad = np.append(np.bincount(pc, a[pr], m) + np.bincount(uc, b[ur], m), a.sum() + b.sum())
            grad[:m] += self.decay * w
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            step = self.rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
            w, bias = w - step[:m], bias - step[m]
            # soft threshold: features that the risk does not ask for stay at 0
            w = np.sign(w) * np.maximum(np.abs(w) - self.rate * 0.02, 0)
        self.table = np.zeros(1 << BITS, np.float32)
        self.table[use] = w
        self.bias = float(bias)
        return self

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, feat = features(data, at)
        some = self.table[feat] != 0
        row, feat = distinct(row[some], feat[some])
        return sigmoid(np.bincount(row, self.table[feat], len(at) - 1) + self.bias)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> NonNegativePU | None:
    """From confirmed toxic documents and any documents as unlabelled, of the folds 1 to 4 of 5.

    The class prior is the share of toxic among the labelled rows of those folds. None without a
    confirmed toxic document.
    """
    spark = docs.sparkSession
    learn = fold(F.col("doc_id"), 5) != 0
    marked = labels.where(learn & F.col("toxic").isNotNull()).join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
    share = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share:
        return None
    positive = first_by_hash(marked.where("toxic = 1").select("doc_id").distinct(), max_positive, 1)
    unlabelled = first_by_hash(docs.select("doc_id").where(learn).distinct(), max_unlabelled, 2)
    pick = positive.withColumn("positive", F.lit(True)).join(unlabelled.withColumn("unlabelled", F.lit(True)), "doc_id", "full").na.fill(False)
    pick = spark.createDataFrame(pick.toPandas(), "doc_id long, positive boolean, unlabelled boolean")  # max_positive + max_unlabelled ids
    chosen = saved(rows_of(docs.select("doc_id", "text"), pick).select("doc_id", "text", "positive", "unlabelled"))
    counts = chosen.mapInArrow(_counted, "feat int, u long, p long").groupBy("feat").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toPandas()
    count = np.zeros((2, 1 << BITS), np.int64)
    count[:, counts["feat"]] = counts[["u", "p"]].to_numpy().T
    n_u, n_p = chosen.agg(F.count_if("unlabelled"), F.count_if("positive")).first()
    if not n_p:
        return None
    model = NonNegativePU(min(0.9, max(1e-3, share)))
    use = model.chosen(count[1], count[0], n_p, n_u)
    got = chosen.mapInArrow(_sampled(use), "doc_id long, positive boolean, unlabelled boolean, feats binary").toArrow()
    rows: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for _, f, p, u in sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "feats", "positive", "unlabelled")), strict=True)):
        for k, there in ((0, u), (1, p)):
            if there:
                rows[k].append(np.frombuffer(f, np.int32))
    return model.fit(use, rows[1], rows[0])


def score(docs: DataFrame, model: NonNegativePU | None) -> DataFrame:
    """doc_id and score of every whole text. Null and empty texts get the score of no word; without a model, 0.

    Rows that repeat are scored each, and alike; ties need no rule. Memory is linear in the longest
    text. An empty table gives none. Other columns, whatever their names, are not read.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.scores(data, at), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
