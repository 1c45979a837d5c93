"""Bounded samples of labelled rows, the folds, and the logistic regression that two classifiers end with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, utf8_size

FOLDS = 5
#: Bytes of a text beyond which it is not learned from (it is scored all the same), so that the sample's size is bounded too.
LONGEST = 1 << 17


def remainder(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds; null id: null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str) -> F.Column:
    return F.coalesce(remainder(id_col, FOLDS) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, scratch: Scratch, name: str = "sample", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and y of at most `each` training rows of each label, chosen by hash, of at most LONGEST bytes; labels of held-out rows are not read.

    The ids chosen, 2 x each at most, are what is broadcast.
    """
    known = labels.select(F.col(id_col).alias("l"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (remainder("l", FOLDS) != 0))
    chosen = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).groupBy("l").agg(F.first("y").alias("y")).orderBy(F.xxhash64("l"), "l").limit(each)
        chosen = some if chosen is None else chosen.union(some)
    chosen = scratch.table(chosen.coalesce(1), f"{name}_ids")
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("d") == F.col("l"))
    return scratch.table(rows.filter(utf8_size("text") <= LONGEST).select("d", "text", "y"), name)


def priors(labels: DataFrame, label: str, id_col: str = "doc_id") -> float:
    """The share of label 1 among all training rows."""
    row = labels.filter(F.col(label).isin(0, 1) & (remainder(id_col, FOLDS) != 0)).agg(F.avg(F.col(label).cast("double")).alias("p")).first()
    return min(max(row["p"] if row["p"] is not None else 0.5, 1e-3), 1 - 1e-3)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) by Newton's method with a ridge on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (y - p)) - penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
