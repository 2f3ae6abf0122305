"""Small models fitted on the driver from bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are fitted on, the first by a hash of their ids.
LABELLED_ROWS = 20_000


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. Null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled_sample(labels: DataFrame, column: str, most: int = LABELLED_ROWS) -> DataFrame:
    """At most ``most`` rows (label_id, label, fold) with a label of 0 or 1 outside the held-out fold; an id with both labels is left out."""
    ids = F.col("doc_id").cast("long")
    rows = labels.select(ids.alias("label_id"), F.col(column).cast("int").alias("label")).where("label_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.withColumn("fold", fold_of(F.col("label_id"))).where("fold <> 2")
    rows = rows.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("high"), F.min("fold").alias("fold")).where("label = high").drop("high")
    return rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, l2: float = 1.0):
        self.l2 = l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(x)) if weight is None else weight
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        std = x.std(0) if len(x) else np.ones(x.shape[1])
        self.scale = np.where(std > 1e-9, std, 1.0)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        # one invented row of either label keeps the intercept finite where a class is missing
        z, y, weight = np.vstack([z, np.eye(1, z.shape[1]), np.eye(1, z.shape[1])]), np.append(y, [0, 1]), np.append(weight, [0.5, 0.5])
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.l2)
        penalty[0] = 1e-6
        for _ in range(30):
            p = sigmoid(z @ self.w)
            slope = z.T @ (weight * (p - y)) + penalty * self.w
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    _, rank, count = np.unique(score, return_inverse=True, return_counts=True)
    mid = np.cumsum(count) - (count - 1) / 2
    r, pos = mid[rank], y == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return float((r[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")
