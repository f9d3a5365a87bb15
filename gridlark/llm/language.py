"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import first_by_hash, fold, rows_of
from .store import table

#: Components of a vector, letters that are told apart, letters of an n-gram.
DIM, SYMBOLS, N = 512, 40, 3
GRAMS = SYMBOLS**N
#: Prototypes are bundled from so many documents at most.
MAX_TRAIN = 20000
UNKNOWN = "und"


@cache
def symbols() -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter, 1 to 26 for a to z, one of the rest for others."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            out[cp] = 27 + cp * 2654435761 % 2**32 * (SYMBOLS - 27) // 2**32
    out[97:123] = np.arange(1, 27)
    return out


@cache
def gram_vectors(seed: int = 7) -> np.ndarray:
    """Of every n-gram: its letters' random +-1 vectors, each rotated by its distance from the end, bound by product."""
    letters = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (SYMBOLS, DIM)).astype(np.int8) * 2 - 1
    out = np.ones((1, DIM), np.int8)
    for i in range(N):
        turned = np.roll(letters, N - 1 - i, axis=1)
        out = (out[:, None, :] * turned[None, :, :]).reshape(-1, DIM)
    return out


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Of each text its n-grams that hold a letter and how often, or None where it has no letter."""
    table_ = symbols()
    for t in texts:
        s = table_[np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)] if t else np.zeros(0, np.uint8)
        if not s.any():
            yield None
            continue
        keep = np.ones(len(s), bool)  # a run of other characters counts as one
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = np.concatenate([[0], s[keep], [0]]).astype(np.int64)
        g = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        counts = np.bincount(g, minlength=GRAMS) if len(g) > 2000 else None
        if counts is None:
            at, n = np.unique(g, return_counts=True)
        else:
            at = np.flatnonzero(counts)
            n = counts[at]
        yield at, n.astype(np.float32)


def bundle(grams_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sum of a text's n-gram vectors, at length 1."""
    v = grams_[1] @ gram_vectors()[grams_[0]].astype(np.float32)
    return v / max(1e-9, float(np.linalg.norm(v)))


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by language over a task: one row a language and component."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, g in zip(batch.column("lang").to_pylist(), grams(batch.column("text").to_pylist()), strict=True):
            if g is not None:
                sums[lang] = sums.get(lang, 0) + bundle(g).astype(np.float64)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM), pa.int32()), pa.array(np.rint(v * 2**20), pa.int64())], ["lang", "dim", "v"])


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Prototypes: of each language the bundle of its documents. Uses text and lang of ``max_train`` documents at most.

    Sums are of whole numbers, so their order changes nothing. Memory is languages x DIM.
    """
    picked = first_by_hash(docs.where("lang is not null").select("doc_id").distinct(), max_train, 6)
    picked = docs.sparkSession.createDataFrame(picked.toPandas(), "doc_id long")
    chosen = rows_of(docs.where("lang is not null").select("doc_id", "text", "lang"), picked).select("text", "lang")
    got = chosen.mapInArrow(_bundled, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).toPandas()
    names = sorted(got["lang"].unique())
    out = np.zeros((len(names), DIM))
    for i, name in enumerate(names):
        own = got[got["lang"] == name]
        out[i, own["dim"].to_numpy()] = own["v"].to_numpy()
    return names, (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, at least 0) of every whole text.

    `und` with score 0 where the text is null or has no letter, or no language was learned. Equal
    cosines go to the name that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, proto = shared.value
        for batch in batches:
            langs, scores = [], []
            for start in range(0, batch.num_rows, 200):
                for g in grams(batch.column(1).slice(start, 200).to_pylist()):
                    c = proto @ bundle(g) if g is not None and known else None
                    best = int(np.argmax(c)) if c is not None else 0
                    langs.append(UNKNOWN if c is None else known[best])
                    scores.append(0.0 if c is None else min(1.0, max(0.0, float(c[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    found = predict(docs, *fit(docs.where(~held & F.col("doc_id").isNotNull())))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
