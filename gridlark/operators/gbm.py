"""Tree ensembles: tables, files, inference in Arrow batches, and training."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

FEATURES = 105
# The file's magic by version, its header, and its node records by version.
MAGIC = {1: b"SRBGBM1\0", 2: b"SRBGBM2\0", 3: b"SRBGBM3\0"}
HEADER = "<8s6I"
NODES = {1: "<iidIHBB", 2: "<iidIHBB", 3: "<iiiHBB"}


@dataclass
class Model:
    """Arrays of all trees. A child below 0 is leaf -child - 1. A categorical node's categories are the
    set bits of masks[decision:decision + count], 64 to a word."""

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    decision: np.ndarray
    count: np.ndarray
    feature: np.ndarray
    categorical: np.ndarray
    leaves: np.ndarray
    masks: np.ndarray
    n_features: int = FEATURES

    def check(self) -> Model:
        n, m = len(self.left), len(self.leaves)
        for child in (self.left, self.right, self.roots):
            if ((child >= n) | (child < -m)).any():
                raise ValueError("a child is out of range")
        if ((self.feature < 0) | (self.feature >= self.n_features)).any():
            raise ValueError("a feature is out of range")
        cat = self.categorical.astype(bool)
        if ((self.decision[cat] < 0) | (self.decision[cat] + self.count[cat] > len(self.masks))).any():
            raise ValueError("categories are out of range")
        return self

    def _laid_out(self) -> list[tuple[np.ndarray, ...]]:
        """Each tree on its own, level by level with the children of a node side by side, so that its tables fit the nearest cache.

        (left child, feature, decision, value, node's number, depth); the right child is the next one. A leaf
        leads to itself, as no feature is over its decision. Made once.
        """
        if not hasattr(self, "_trees"):
            most = np.iinfo(np.int32).max
            trees = []
            for root in self.roots.tolist():
                levels, cur, end = [], np.array([root]), 1
                while True:
                    inner = cur >= 0
                    levels.append((cur, np.where(inner, end + 2 * (np.cumsum(inner) - 1), np.arange(end - len(cur), end))))
                    if not inner.any():
                        break
                    cur = np.stack([self.left[cur[inner]], self.right[cur[inner]]], 1).ravel()
                    end += len(cur)
                node, left = (np.concatenate(x) for x in zip(*levels, strict=True))
                inner = node >= 0
                at = np.where(inner, node, 0)
                pick = lambda x, other, inner=inner, at=at: np.where(inner, x[at], other) if len(x) else np.full(len(at), other)
                value = np.where(inner, 0.0, self.leaves[np.where(inner, 0, -node - 1)])
                trees.append((left, pick(self.feature, 0), pick(np.clip(self.decision, -most - 1, most), most).astype(np.int32), value, np.where(inner, node, -1), len(levels) - 1))
            self._trees = trees
        return self._trees

    def residual(self, x: np.ndarray, trees: int | None = None, rows: int = 8192) -> np.ndarray:
        """Sums of the trees in order for rows of integers: blocks of rows, in each tree after tree, a level at a time."""
        any_cat = bool(self.categorical.any())
        out = np.zeros(len(x))
        for lo in range(0, len(x), rows):
            part = np.ascontiguousarray(x[lo : lo + rows].T, np.int32)
            n = part.shape[1]
            flat, row, total = part.ravel(), np.arange(n), out[lo : lo + rows]
            for left, feature, decision, value, node, depth in self._laid_out()[:trees]:
                by_category = any_cat and self.categorical[node[node >= 0]].any()
                first = feature * n
                at = np.zeros(n, np.int64)
                for _ in range(depth):
                    place = first.take(at)
                    place += row
                    v = flat.take(place)
                    right = v > decision.take(at)
                    if by_category:
                        self._by_category(node.take(at), v, right)
                    at = left.take(at)
                    at += right
                total += value.take(at)
        return out

    def _by_category(self, node: np.ndarray, v: np.ndarray, right: np.ndarray) -> None:
        """Sets ``right`` at categorical nodes: left for the listed categories, right for others and negative ones."""
        cat = (node >= 0) & self.categorical[node].astype(bool)
        if cat.any():
            c, w = node[cat], v[cat].astype(np.int64)
            known = (w >= 0) & ((w >> 6) < self.count[c])
            word = np.where(known, self.decision[c] + (w >> 6), 0)
            bit = (self.masks[word] >> (np.maximum(w, 0) & 63).astype(np.uint64)) & np.uint64(1)
            right[cat] = ~known | (bit == 0)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """gbm_roots, gbm_nodes, gbm_leaves, gbm_masks."""
        node = zip(range(len(self.left)), *(a.tolist() for a in (self.left, self.right, self.decision, self.count, self.feature)), self.categorical.astype(bool).tolist(), strict=True)
        return {
            "gbm_roots": spark.createDataFrame(list(enumerate(self.roots.tolist())), "tree int, root int"),
            "gbm_nodes": spark.createDataFrame(list(node), "idx int, left int, right int, decision int, category_count int, feature int, categorical boolean"),
            "gbm_leaves": spark.createDataFrame(list(enumerate(self.leaves.tolist())), "idx int, value double"),
            "gbm_masks": spark.createDataFrame(list(enumerate(self.masks.view(np.int64).tolist())), "idx int, word long"),
        }


def words_of(categories: list[int]) -> np.ndarray:
    """Categories as 64-bit words."""
    out = np.zeros(max(categories, default=-1) // 64 + 1, np.uint64)
    for c in categories:
        out[c // 64] |= np.uint64(1 << (c % 64))
    return out


def decode(data: bytes) -> Model:
    """A model file of version 1 (threshold as float, category lists), 2 (masks) or 3 (integer thresholds)."""
    if len(data) < struct.calcsize(HEADER):
        raise ValueError("truncated model")
    magic, version, n_features, trees, nodes, leaves, cats = struct.unpack_from(HEADER, data)
    if MAGIC.get(version) != magic:
        raise ValueError("not a model file")
    if n_features != FEATURES:
        raise ValueError(f"{n_features} features, not {FEATURES}")
    at = struct.calcsize(HEADER)
    want = at + 4 * trees + struct.calcsize(NODES[version]) * nodes + 8 * leaves + (2 if version == 1 else 8) * cats
    if len(data) != want:
        raise ValueError("truncated model" if len(data) < want else "trailing bytes after the model")
    roots = np.frombuffer(data, "<i4", trees, at)
    at += 4 * trees
    kinds = [("left", "<i4"), ("right", "<i4"), *([("threshold", "<f8"), ("offset", "<u4")] if version < 3 else [("decision", "<i4")]), ("count", "<u2"), ("feature", "u1"), ("categorical", "u1")]
    rows = np.frombuffer(data, np.dtype(kinds), nodes, at)
    at += rows.nbytes
    values = np.frombuffer(data, "<f8", leaves, at)
    at += 8 * leaves
    cat = rows["categorical"].astype(bool)
    decision = rows["decision"].astype(np.int64) if version == 3 else np.where(cat, rows["offset"], np.floor(rows["threshold"])).astype(np.int64)
    count = rows["count"].astype(np.int64)
    if version == 1:
        listed, masks = np.frombuffer(data, "<u2", cats, at), []
        for i in np.flatnonzero(cat):
            words = words_of(listed[decision[i] : decision[i] + count[i]].tolist())
            decision[i], count[i] = sum(map(len, masks)), len(words)
            masks.append(words)
        words = np.concatenate(masks) if masks else np.zeros(1, np.uint64)
    else:
        words = np.frombuffer(data, "<u8", cats, at)
    return Model(roots.astype(np.int64), rows["left"].astype(np.int64), rows["right"].astype(np.int64), decision, count, rows["feature"].astype(np.int64), rows["categorical"], values, words if len(words) else np.zeros(1, np.uint64), n_features).check()


def encode(m: Model, version: int = 3) -> bytes:
    """A model file of version 3 (masks, integer thresholds) or 1 (compact: thresholds as float, listed categories)."""
    if m.count.max(initial=0) > 65535 or m.feature.max(initial=0) > 255:
        raise ValueError("too many categories or features for the format")
    common = [("count", "<u2"), ("feature", "u1"), ("categorical", "u1")]
    if version == 3:
        rows = np.empty(len(m.left), np.dtype([("left", "<i4"), ("right", "<i4"), ("decision", "<i4"), *common]))
        rows["count"], rows["decision"], cats = m.count, m.decision, m.masks.astype("<u8")
    elif version == 1:
        rows = np.zeros(len(m.left), np.dtype([("left", "<i4"), ("right", "<i4"), ("threshold", "<f8"), ("offset", "<u4"), *common]))
        rows["threshold"] = np.where(m.categorical.astype(bool), 0, m.decision)
        listed: list[int] = []
        for i in np.flatnonzero(m.categorical):
            words = m.masks[m.decision[i] : m.decision[i] + m.count[i]].tolist()
            own = [64 * w + b for w, x in enumerate(words) for b in range(64) if x >> b & 1]
            rows["offset"][i], rows["count"][i] = len(listed), len(own)
            listed += own
        if max(listed, default=0) > 65535:
            raise ValueError("a category doesn't fit the format")
        cats = np.array(listed, "<u2")
    else:
        raise ValueError(f"version {version} can't be written")
    for k in ("left", "right", "feature", "categorical"):
        rows[k] = getattr(m, k)
    head = struct.pack(HEADER, MAGIC[version], version, m.n_features, len(m.roots), len(m.left), len(m.leaves), len(cats))
    return head + m.roots.astype("<i4").tobytes() + rows.tobytes() + m.leaves.astype("<f8").tobytes() + cats.tobytes()


def same_residuals(a: Model, b: Model, rows: int = 128, seed: int = 1, most: float = 1e-12) -> bool:
    """Whether two models agree on random whole numbers, negative ones and categories over 64 among them."""
    x = np.random.Generator(np.random.PCG64(seed)).integers(-5, 700, (rows, a.n_features)).astype(np.int32)
    return a.n_features == b.n_features and bool((np.abs(a.residual(x) - b.residual(x)) <= most).all())


def read_model(spark: SparkSession, path: str) -> Model:
    return decode(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def find_model(spark: SparkSession, name: str, places: list[str]) -> str | None:
    """The first of the folders that has the file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for place in places:
        p = jvm.org.apache.hadoop.fs.Path(f"{place.rstrip('/')}/{name}" if place else name)
        if p.getFileSystem(conf).exists(p):
            return p.toString()
    return None


def from_trees(trees: list[dict], n_features: int = FEATURES) -> Model:
    """From nested {"feature", "threshold" or "categories", "left", "right"} and {"leaf"}; thresholds are floored, as features are whole."""
    cols: dict[str, list] = {k: [] for k in ("left", "right", "decision", "count", "feature", "categorical")}
    roots, leaves, masks = [], [], []

    def add(t: dict) -> int:
        if "leaf" in t:
            leaves.append(float(t["leaf"]))
            return -len(leaves)
        at = len(cols["left"])
        for v in cols.values():
            v.append(0)
        cols["feature"][at] = t["feature"]
        if "categories" in t:
            words = words_of(list(t["categories"]))
            cols["decision"][at], cols["count"][at], cols["categorical"][at] = len(masks), len(words), 1
            masks.extend(words.tolist())
        else:
            cols["decision"][at] = int(np.floor(t["threshold"]))
        cols["left"][at], cols["right"][at] = add(t["left"]), add(t["right"])
        return at

    for t in trees:
        roots.append(add(t))
    arrays = {k: np.array(v, np.int64) for k, v in cols.items()}
    return Model(np.array(roots, np.int64), **arrays, leaves=np.array(leaves), masks=np.array(masks or [0], np.uint64), n_features=n_features).check()


def from_text(text: str) -> Model:
    """From a boosted model's text dump: blocks Tree=..., with split_feature, threshold, decision_type, children, leaf_value, cat_boundaries and cat_threshold."""
    trees = []
    for block in re.split(r"\nTree=\d+\n", text)[1:]:
        f = dict(line.split("=", 1) for line in block.split("\n\n")[0].splitlines() if "=" in line)
        num = lambda k, t=int, f=f: [t(v) for v in f.get(k, "").split()]
        values = num("leaf_value", float)
        feature, threshold, kind = num("split_feature"), num("threshold", float), num("decision_type")
        left, right, bound, cats = num("left_child"), num("right_child"), num("cat_boundaries"), num("cat_threshold")

        def node(i: int, *, values=values, feature=feature, threshold=threshold, kind=kind, left=left, right=right, bound=bound, cats=cats) -> dict:
            if i < 0:
                return {"leaf": values[-i - 1]}
            again = dict(values=values, feature=feature, threshold=threshold, kind=kind, left=left, right=right, bound=bound, cats=cats)
            out = {"feature": feature[i], "left": node(left[i], **again), "right": node(right[i], **again)}
            if kind[i] & 1:
                words = cats[bound[int(threshold[i])] : bound[int(threshold[i]) + 1]]
                return out | {"categories": [32 * w + b for w, x in enumerate(words) for b in range(32) if x >> b & 1]}
            return out | {"threshold": threshold[i]}

        trees.append(node(0 if feature else -1))
    return from_trees(trees)


def residuals(df: DataFrame, model: Model, column: str = "features", trees: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (of it the columns ``keep``, where given) with ``residual``. The model goes to each executor once; a batch of rows runs through tree after tree."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            kept = [n for n in batch.schema.names if keep is None or n in keep]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(m.residual(x, trees))], [*kept, "residual"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if keep is None or f.name in keep)
    return df.mapInArrow(run, fields + "residual double")


def predicted(raw: Column, residual: Column) -> Column:
    """raw * exp(residual), rounded half to even; 0 and unreachable stay, NaN and less than 0 become 0, and 32 bits are the most."""
    v = F.rint(raw * F.exp(residual))
    v = F.when(F.isnan(v) | (v <= 0), 0.0).when(v > 4294967295.0, 4294967295.0).otherwise(v)
    return F.when(raw.isNull() | (raw == 0), raw).otherwise(v).cast("long")


def predict(df: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``df``, or of it the columns ``keep`` (raw among them), with residual and prediction."""
    return residuals(df, model, keep=keep).withColumn("prediction", predicted(F.col("raw"), F.col("residual")))


def train(df: DataFrame, column: str = "features", target: str = "residual", trees: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 7) -> tuple[Model, list[tuple[int, float]]]:
    """(model, features by gain) fitted by Spark's own boosted trees.

    These know the squared and absolute loss only, so a model trained with another loss can't be reproduced.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    data = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("x"), F.col(target).alias("y"))
    fitted = GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.85, maxBins=127).fit(data)

    def convert(node, weight: float) -> dict:  # noqa: ANN001
        if node.numDescendants() == 0:
            return {"leaf": node.prediction() * weight}
        return {"feature": node.split().featureIndex(), "threshold": node.split().threshold(), "left": convert(node.leftChild(), weight), "right": convert(node.rightChild(), weight)}

    made = from_trees([convert(t._call_java("rootNode"), w) for t, w in zip(fitted.trees, fitted.treeWeights, strict=True)])
    gain = sorted(enumerate(fitted.featureImportances.toArray().tolist()), key=lambda p: -p[1])
    return made, gain
