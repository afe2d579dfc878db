"""Labelled rows to learn from, and small numeric helpers of the trained operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5, fold: int = 0) -> pa.Table:
    """(text, label, weight) of at most ``per_class`` labelled rows of each class, for fitting.

    Rows outside the held-out fold only, chosen by a hash of their id, so the same rows on
    every run. ``weight`` gives the classes back the shares they have among all labelled
    rows. A row labelled twice counts once, with its higher label; null labels and null
    texts don't count. ``per_class`` bounds what is fetched, whatever the tables hold.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(17))
    picked = None
    for value in (0, 1):
        rows = known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        picked = rows if picked is None else picked.unionByName(rows)
    # At most 2 * per_class rows of two numbers: small enough to broadcast at any size.
    rows = (
        docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(order, "doc_id").toArrow()
    )
    y = rows["label"].to_numpy().astype(np.float64)
    share = {v: totals.get(v, 0) / max(1, (y == v).sum()) for v in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    weight = weight / weight.mean() if len(weight) else weight
    return pa.table({"text": rows["text"], "label": pa.array(y), "weight": pa.array(weight)})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.clip(x, -60, 60)))


class Adam:
    """One array's step sizes."""

    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.99**self.t)
        return self.rate * m / (np.sqrt(v) + 1e-8)
