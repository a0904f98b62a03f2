"""Inference of exported trees and small networks, group folds, and training with Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Forest:
    """Trees as flat arrays: feature (-1: leaf), threshold, left, right, and class shares of the leaves."""

    def __init__(self, trees: Sequence[dict[str, np.ndarray]]):
        self.trees = trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean leaf share per class; all rows walk a tree together, level by level."""
        total = 0.0
        for t in self.trees:
            at = np.zeros(len(x), "int64")
            while True:
                f = t["feature"][at]
                live = np.flatnonzero(f >= 0)
                if not len(live):
                    break
                go = x[live, f[live]] <= t["threshold"][at[live]]
                at[live] = np.where(go, t["left"][at[live]], t["right"][at[live]])
            total = total + t["share"][at]
        return total / len(self.trees)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, trees: int, depth: int, seed: int) -> Forest:
        """Small forest on bootstrap samples, splits by Gini over a random half of the features at deciles."""
        rng = np.random.RandomState(seed)
        out = []
        for _ in range(trees):
            pick = rng.randint(0, len(x), len(x))
            nodes: list[list] = []

            def grow(rows: np.ndarray, level: int) -> int:
                k = len(nodes)
                share = np.bincount(y[rows], minlength=classes) / len(rows)
                nodes.append([-1, 0.0, -1, -1, share])
                if level < depth and share.max() < 1:
                    best = None
                    for f in rng.permutation(x.shape[1])[: max(1, (x.shape[1] + 1) // 2)]:
                        for th in np.unique(np.quantile(x[rows, f], np.linspace(0.1, 0.9, 9))):
                            go = x[rows, f] <= th
                            if 0 < go.sum() < len(rows):
                                g = sum(s.sum() * (1 - ((np.bincount(y[rows[s]], minlength=classes) / s.sum()) ** 2).sum()) for s in (go, ~go))
                                if best is None or g < best[0]:
                                    best = (g, f, th, go)
                    if best:
                        nodes[k][0], nodes[k][1] = int(best[1]), float(best[2])
                        nodes[k][2] = grow(rows[best[3]], level + 1)
                        nodes[k][3] = grow(rows[~best[3]], level + 1)
                return k

            grow(pick, 0)
            cols = list(zip(*nodes))
            out.append({"feature": np.array(cols[0]), "threshold": np.array(cols[1]), "left": np.array(cols[2]), "right": np.array(cols[3]), "share": np.array(cols[4])})
        return cls(out)


def score(df: DataFrame, features: Sequence[str], model, classes: int) -> DataFrame:
    """Adds share (array of class probabilities) and class; a row with a null feature has neither. Arrow batches only."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy("float64") for c in cols], 1)
        ok = np.isfinite(x).all(1)
        out = [None] * len(x)
        if ok.any():
            for k, row in zip(np.flatnonzero(ok), shared.value.predict(x[ok])):
                out[k] = row.tolist()
        return pd.Series(out, dtype=object)

    d = df.withColumn("share", run(*[F.col(c).cast("double") for c in features]))
    return d.withColumn("class", (F.array_position("share", F.array_max("share")) - 1).cast("int"))


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 11) -> DataFrame:
    """Adds fold: all rows of a group in one fold, by the digest of seed and group (the same on any engine)."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 8)
    return df.withColumn("fold", F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(folds)).cast("int"))


def mean_share(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Windows to sequences: mean class shares and the class they favour (ties: the lower)."""
    g = df.filter("share is not null").groupBy(*keys).agg(F.count("*").alias("windows"), *[F.avg(F.get("share", k)).alias(f"s{k}") for k in range(classes)])
    best = F.greatest(*[F.col(f"s{k}") for k in range(classes)])
    case = F.lit(classes - 1)
    for k in reversed(range(classes - 1)):
        case = F.when(F.col(f"s{k}") == best, k).otherwise(case)
    return g.withColumn("class", case)


def random_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 6, seed: int = 7):
    """Spark's own random forest on a feature vector."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return v, RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(v.transform(train))


def logistic(df: DataFrame, features: Sequence[str], label: str, ridge: float = 1e-6, rounds: int = 25) -> np.ndarray:
    """Coefficients (constant first) of a logistic regression by Newton's method: each round is one aggregate of sums that
    merge, (features + 1) squared numbers large, whatever the rows. Rows with a null or NaN take no part."""
    k = len(features) + 1
    rows = df.select(F.col(label).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    b = np.zeros(k)
    for _ in range(rounds):
        eta = sum((float(w) * c for w, c in zip(b[1:], x[1:])), F.lit(float(b[0])))
        p = 1 / (1 + F.exp(-eta))
        d = rows.withColumn("__p", p)
        w = F.col("__p") * (1 - F.col("__p"))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = d.agg(*[F.sum((F.col("__y") - F.col("__p")) * x[i]) for i in range(k)], *[F.sum(w * x[i] * x[j]) for i, j in pairs]).first()
        if got[0] is None:
            return b
        g, h = np.array(got[:k]) - ridge * b, np.eye(k) * ridge
        for (i, j), v in zip(pairs, got[k:]):
            h[i, j] += v
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b


class Layers:
    """Inference of a small network: normalised inputs through dense layers with rectifiers, one output as a probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: Sequence[np.ndarray], biases: Sequence[np.ndarray]):
        if (scale <= 0).any() or any(w.shape[0] != len(b) for w, b in zip(weights, biases)) or any(v.shape[1] != w.shape[0] for w, v in zip(weights, weights[1:])):
            raise ValueError("layers don't fit together")
        self.mean, self.scale, self.weights, self.biases = mean, scale, weights, biases

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, 2): shares of the two classes."""
        h = (x - self.mean) / self.scale
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            h = h @ w.T + b
            if k < len(self.weights) - 1:
                h = np.maximum(h, 0)
        z = np.exp(-np.abs(h[:, 0]))
        p = np.where(h[:, 0] >= 0, 1 / (1 + z), z / (1 + z))
        return np.column_stack([1 - p, p])


class Gru:
    """Inference of a gated recurrent unit over a sequence, its last state through a linear layer to class shares."""

    def __init__(self, w: np.ndarray, u: np.ndarray, b: np.ndarray, out: np.ndarray, out_b: np.ndarray):
        self.w, self.u, self.b, self.out, self.out_b, self.size = w, u, b, out, out_b, u.shape[1]

    def step(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Gates in the order update, reset, candidate."""
        n = self.size
        sig = lambda a: 1 / (1 + np.exp(-a))
        a, c = x @ self.w.T + self.b, h @ self.u.T
        z, r = sig(a[..., :n] + c[..., :n]), sig(a[..., n : 2 * n] + c[..., n : 2 * n])
        new = np.tanh(a[..., 2 * n :] + r * c[..., 2 * n :])
        return z * h + (1 - z) * new

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(sequences, time, features) -> (sequences, classes)."""
        h = np.zeros((len(x), self.size))
        for k in range(x.shape[1]):
            h = self.step(h, x[:, k])
        e = h @ self.out.T + self.out_b
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
