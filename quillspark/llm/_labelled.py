"""Bounded samples of labelled documents to fit classifiers on, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drawn, share


def sample(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int, row_bytes: int, held_out: Column | None = None) -> list[tuple[str, int]]:
    """About ``per_class`` (text, 0/1) rows of each class, by a hash of doc_id, none longer than ``row_bytes``.

    The bound becomes a threshold on the hash, so what is joined to the documents is
    small and is broadcast.  A document with several labels has the largest of them.
    Where many documents share a drawn id, no more than twice the bound are taken, by a hash of the text.
    """
    known = docs.sparkSession.createDataFrame([], "doc_id long, y int") if label not in labels.columns else labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label) > 0).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    if held_out is not None:
        known = known.where(~held_out)
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    largest = F.lit(-1).cast("long")
    for y, n in counts.items():
        largest = F.when(F.col("y") == y, F.lit(share(per_class, n))).otherwise(largest)
    picked = known.where(drawn(largest, "doc_id", seed=29))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= row_bytes)
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * per_class * max(1, len(counts))).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(-(a * margin + b))), by Newton steps with Platt's smoothed targets."""
    n1, n0 = float(y.sum()), float((1 - y).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def probability(margin: np.ndarray, calibration: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(calibration[0] * margin + calibration[1], -40, 40)))
