"""Logistic regression by follow-the-regularised-leader, and the bounded,
labelled sample it is trained on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.util import held_out


class Ftrl:
    """FTRL-proximal over hashed features: per-coordinate rates, L1 and L2."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1e-3):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example: distinct features ``at`` with values ``x``, label 0 to 1."""
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One label (0 or 1) a doc_id: the mean of its labels, from a half up as 1.
    Null ids and labels, and the ids held out, have none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y"))
    known = known.where("doc_id is not null and y is not null").where(~held_out())
    return known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The columns of ``ids`` (doc_id, once each, a bounded number: they are
    broadcast) and one text an id: of several rows, that of the least hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy(*ids.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(rank, y, text) of at most ``most`` labelled ids, those of smallest hash, one
    text each; in one partition, in a fixed order."""
    ids = labelled(labels, column).withColumn("rank", F.xxhash64(F.lit(5), "doc_id")).orderBy("rank", "doc_id").limit(most)
    return one_text(docs, ids).select("rank", "y", "text").repartition(1).sortWithinPartitions("rank", "text")
