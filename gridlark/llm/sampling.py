"""Bounded, repeatable samples of rows for fitting models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, n: int) -> Column:
    """crc32(key as text) mod n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def first_by_hash(df: DataFrame, bound: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``bound`` rows at most, the first in a hash order of the key; the same rows at every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(bound)


def rows_of(docs: DataFrame, picked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is among ``picked``, whose size its caller has bounded."""
    return docs.join(F.broadcast(picked), key)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """L2-regularised logistic regression on dense standardised features, by Newton steps."""

    def __init__(self, penalty: float = 1.0):
        self.penalty, self.w = penalty, None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 25) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weight = np.ones(len(x)) if weight is None else weight
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], self.penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = sigmoid(z @ w)
            g = z.T @ (weight * (p - y)) + ridge * w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10) @ self.w[:-1] + self.w[-1]

    def proba(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))
