"""Bounded samples of labelled rows, and the logistic fit that classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labels_of(labels: DataFrame, label: str) -> DataFrame:
    """One 0/1 label per doc_id (the larger one where rows disagree); null ids and labels go."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_ids(labels: DataFrame, per_class: int, seed: int = 1) -> DataFrame:
    """(doc_id, label, part): at most per_class rows of each label, by a hash of the id.

    part: 0 or 1, to fit one thing on one half and another on the other.
    """
    key = F.xxhash64(F.lit(seed), "doc_id")
    halves = [labels.where(F.col("label") == y).orderBy(key, "doc_id").limit(per_class) for y in (0, 1)]
    return halves[0].unionByName(halves[1]).withColumn("part", (F.shiftright(key, 7) % 2 != 0).cast("int"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method with a ridge on the weights."""
    a = np.column_stack([x, np.ones(len(x))]).astype(float)
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
