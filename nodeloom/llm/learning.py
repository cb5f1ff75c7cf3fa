"""What the classifiers share: the bounded sample of labelled rows, and small numpy training parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm._common import held_out, quoted


def labelled(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(__id, label) of the rows that labels may be learned from: known id and label, not held out.

    An id with several rows has its largest label.
    """
    known = labels.where(F.col(quoted(id_col)).isNotNull() & F.col(quoted(label_col)).isNotNull() & ~held_out(id_col))
    return known.groupBy(F.col(quoted(id_col)).alias("__id")).agg(F.max(quoted(label_col)).cast("int").alias("label"))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of their id and so the same on every run."""
    return rows.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(n)


def with_texts(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, label, __text) of sampled rows; the sample's size is bounded, so it is broadcast.

    Of several texts with one id the smallest is taken.
    """
    texts = docs.select(F.col(quoted(id_col)).alias("__id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("__text"))
    return texts.join(F.broadcast(rows), "__id").groupBy("__id").agg(F.max("label").alias("label"), F.min("__text").alias("__text"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Adam:
    """Adam steps on a list of arrays, in place; the rate falls to zero over ``steps``."""

    def __init__(self, params: list[np.ndarray], rate: float, steps: int):
        self.params, self.rate, self.steps, self.t = params, rate, steps, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * max(0, 1 - (self.t - 1) / self.steps) * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
