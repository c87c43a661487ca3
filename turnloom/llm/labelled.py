"""Bounded labelled samples to fit on, and a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import keyed


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bounds: dict[int, int]) -> DataFrame:
    """(key, text, label): at most `bounds[y]` distinct labelled texts of each class y.

    Rows are taken in the order of a hash of their key. A document with contradicting or null labels
    is not used. The chosen keys are at most sum(bounds) rows, which bounds the broadcast.
    """
    known = (labels.where(usable & F.col(label).isin(*bounds)).groupBy("doc_id")
             .agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other"))
    chosen = None
    for y, n in bounds.items():
        some = (known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
                .select(F.col("doc_id").cast("long").alias("key"), "label"))
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = keyed(docs).join(F.broadcast(chosen), "key")
    return (rows.groupBy("text", "label").agg(F.min("key").alias("key")).select("key", "text", "label"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x) by Newton steps; the slope is held back by `ridge`."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, float(np.log((np.sum(y) + 0.5) / (len(y) - np.sum(y) + 0.5)))
    centre, scale = x.mean(), x.std() or 1.0
    design = np.stack([(x - centre) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + ridge * w
        bend = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)
