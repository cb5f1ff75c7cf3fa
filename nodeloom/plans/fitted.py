"""One estimator fitted on a matrix table, from sums where it can be, and applied to any by all workers."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.estimators import make


#: Features up to which an estimator that needs only sums of products is fitted from them.
SUMMED = 512


def sums_by(rows: DataFrame, by: str, width: int, weight: Column | None = None) -> dict[object, np.ndarray]:
    """For each ``by``, what linear models need of (__x, __y): sums about common means, as tasks and then the driver add them up.

    The sums are rows, weights, weighted x, weighted y, y squared and, from place ``width`` + 4, the products of x
    and y with x. Only sums leave a task, whatever the number of rows.
    """
    kind = dict(rows.dtypes)[by]
    flat = rows.select(F.col(by).alias("__by"), "__x", F.col("__y").cast("double").alias("__y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("__w"))

    def added(reduce, parts: int) -> dict:
        def run(batches):
            total = {}
            for pdf in batches:
                for name, part in pdf.groupby("__by", sort=False):
                    found = reduce(np.stack(part["__x"].to_numpy()).astype(float), part["__y"].to_numpy(), part["__w"].to_numpy())
                    total[name] = total[name] + found if name in total else found
            if total:
                yield pd.DataFrame({"__by": list(total), "sums": list(total.values())})

        each = flat.mapInPandas(run, f"__by {kind}, sums array<double>")
        got = each.select("__by", F.posexplode("sums").alias("i", "s")).groupBy("__by", "i").agg(F.sum("s").alias("s")).toPandas()
        out = {name: np.zeros(parts) for name in got["__by"].unique()}
        for name, part in got.groupby("__by"):
            out[name][part["i"].to_numpy(int)] = part["s"].to_numpy(float)
        return out

    one = sum(added(lambda x, y, w: np.concatenate(([len(x)], x.sum(0), [y.sum()])), width + 2).values())
    center = one[1:] / one[0]

    def about(x, y, w):
        d = np.column_stack((x, y)) - center
        return np.concatenate(([len(x), w.sum()], w @ d, [w @ d[:, -1] ** 2], (d.T @ (d[:, :-1] * w[:, None])).reshape(-1)))

    return {None: center} | added(about, width + 4 + width * (width + 1))


def fit_from(model, sums: np.ndarray, center: np.ndarray, columns: np.ndarray | None = None):
    """A model with ``fit_sums`` fitted from sums of ``sums_by``, on some of the features."""
    width = len(center) - 1
    columns = np.arange(width) if columns is None else columns
    w, by = sums[1], sums[2 : width + 3]
    products = sums[width + 4 :].reshape(width + 1, width) - np.outer(by, by[:-1]) / w
    means = center + by / w
    return model.fit_sums(w, means[columns], means[-1], products[np.ix_(columns, columns)], products[-1, columns])


class Fitted:
    """fit, predict and score of an estimator of ``estimators`` on (key, x, y) tables.

    An estimator with ``fit_sums`` (ridge, lasso, sparse group) is fitted from sums of products that batches
    are reduced to, so any number of rows will do; the sums are a matrix of features by features, and for
    more than ``SUMMED`` of these the rows are the smaller thing. Then, and for other estimators, the rows
    must fit one task.
    """

    def __init__(self, estimator="ridge", **params):
        self.estimator, self.params = estimator, params
        self.kind = make(estimator, **params).kind

    def fit(self, matrix: DataFrame, x: str, y: str, key: str) -> Fitted:
        rows = matrix.select(F.col(key).alias("__key"), F.col(x).alias("__x"), F.col(y).alias("__y"))
        width = rows.agg(F.max(F.size("__x"))).first()[0] or 0
        model = make(self.estimator, **self.params)
        if hasattr(model, "fit_sums") and 0 < width <= SUMMED:
            self.model_ = model.fit_sums(*self._sums(rows, width))
            return self

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__key")
            model = make(self.estimator, **self.params).fit(np.stack(pdf["__x"].to_numpy()).astype(float), pdf["__y"].to_numpy())
            return pd.DataFrame({"model": [pickle.dumps(model)]})

        self.model_ = pickle.loads(rows.groupBy(F.lit(0).alias("all")).applyInPandas(one, "model binary").first()[0])
        return self

    @staticmethod
    def _sums(rows: DataFrame, width: int) -> tuple:
        """(rows, means of x, mean of y, products of x, products of x and y, both about the means)."""

        def added(reduce, parts: int):
            """The sum of one array per batch, as tasks and then the driver add them up."""

            def run(batches):
                total = None
                for pdf in batches:
                    if len(pdf):
                        part = reduce(np.stack(pdf["__x"].to_numpy()).astype(float), pdf["__y"].to_numpy(float))
                        total = part if total is None else total + part
                if total is not None:
                    yield pd.DataFrame({"sums": [total]})

            each = rows.select("__x", F.col("__y").cast("double").alias("__y")).mapInPandas(run, "sums array<double>")
            whole = each.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
            found = np.zeros(parts)
            got = whole.toPandas()  # as many numbers as the model is made from
            found[got["i"].to_numpy(int)] = got["s"].to_numpy(float)
            return found

        first = added(lambda x, y: np.concatenate(([len(x)], x.sum(0), [y.sum()])), width + 2)
        n, mx, my = first[0], first[1:-1] / first[0], first[-1] / first[0]
        second = added(lambda x, y: ((x - mx).T @ np.column_stack((x - mx, y - my))).reshape(-1), width * (width + 1)).reshape(width, width + 1)
        return int(n), mx, my, second[:, :-1], second[:, -1]

    def predict(self, matrix: DataFrame, x: str, key: str) -> DataFrame:
        """(sample, prediction)"""
        model, kinds = matrix.sparkSession.sparkContext.broadcast(self.model_), dict(matrix.dtypes)

        def run(batches):
            for pdf in batches:
                values = np.stack(pdf["__x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))
                yield pd.DataFrame({"sample": pdf["sample"], "prediction": np.asarray(model.value.predict(values), float) if len(pdf) else []})

        return matrix.select(F.col(key).alias("sample"), F.col(x).alias("__x")).mapInPandas(run, f"sample {kinds[key]}, prediction double")

    def score(self, matrix: DataFrame, x: str, y: str, key: str) -> float:
        both = self.predict(matrix, x, key).join(matrix.select(F.col(key).alias("sample"), F.col(y).cast("double").alias("y")), "sample")
        if self.kind == "classifier":
            return float(both.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])
        row = both.agg(F.sum(F.pow(F.col("y") - F.col("prediction"), 2)), F.var_pop("y") * F.count("y")).first()
        return float(1 - row[0] / row[1]) if row[1] else 0.0
