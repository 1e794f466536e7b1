"""Bits that the two text classifiers share: labelled rows, a bounded sample of them, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from parcelsight.llm.common import held_out


def sample_ids(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most about ``per_class`` rows of either class.

    The rows with the smallest hashes of their ids are taken, so that reruns agree. The class sizes
    are counted over all labelled rows first; a hash limit then takes the wanted share, and no sort
    of all rows is needed.
    """
    marks = (labels.filter(F.col(label).isin(0, 1) & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = [F.when(F.col("label") == k, F.lit(int(min(1.0, per_class / n) * (1 << 30))))
              for k, n in sizes.items() if n]
    if not limits:
        return docs.select("doc_id", "text", F.lit(0).alias("label")).filter(F.lit(False))
    chosen = marks.filter(draw < F.coalesce(*limits))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3,
                 steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) by Newton's method on standardised columns."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) / weight.sum() + ridge * w
        curvature = (z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def apply_logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
