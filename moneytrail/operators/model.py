"""The logistic score over rule features: sequential gradient steps on a bounded sample, AUC by ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 20_000  # examples that the driver trains on


def train(x: np.ndarray, y: np.ndarray, epochs: int = 200, rate: float = 0.05) -> np.ndarray:
    """Weights (the constant last) by one gradient step per example, from zero."""
    w = np.zeros(x.shape[1] + 1)
    z = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(epochs):
        for row, label in zip(z, y):
            w += rate * (label - 1 / (1 + np.exp(-(row @ w)))) * row
    return w


def predict(w: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Probabilities; NaN without a model or for another width."""
    if w is None or x.shape[1] + 1 != len(w):
        return np.full(len(x), np.nan)
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve of (score, label) by average ranks (ties count half), 0.5 for one class.

    Ranks come from counts per distinct score, so only distinct scores are ordered together."""
    g = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("p")).over(w), F.lit(0)))
    t = g.agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2)).alias("wins"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return t.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("wins") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auc"))
