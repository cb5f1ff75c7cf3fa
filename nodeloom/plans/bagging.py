"""Bagging: bootstrap draws as a table, members fitted side by side in groups, results averaged."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions import hashrand
from nodeloom.operators.ranks import numbered
from nodeloom.plans.estimators import make
from nodeloom.plans.fitted import SUMMED, fit_from, sums_by
from nodeloom.plans.spilled import Spilled


def draws(rows: DataFrame, n_estimators: int, share: float = 1.0, stratify: str | None = None, replace: bool = True, seed: int = 0, key: str = "subjectID", first: int = 0) -> DataFrame:
    """The rows each estimator is given, with ``weight``, how often; exact in number within each stratum.

    A draw depends on the seed, the estimator and the row only, so members fitted later are the same
    as if all had been fitted at once.
    """
    if not 0 < share <= 1:
        raise ValueError("the share of rows must be in (0, 1]")
    strata, every = [stratify] if stratify else [], F.explode(F.sequence(F.lit(first), F.lit(first + n_estimators - 1)))
    if not replace:
        members = rows.withColumn("estimator", every)
        ranked = numbered(members.withColumn("__u", hashrand.uniform("bag", seed, F.col("estimator"), F.col(key))), ["__u", key], ["estimator", *strata])
        return ranked.where(F.col("__i") < F.floor(F.col("__n") * share)).select(*members.columns, F.lit(1).cast("long").alias("weight"))
    ranked = numbered(rows, [key], strata)  # places are the same for all estimators
    slots = ranked.select(*strata, "__n", (F.col("__i") + 1).alias("__slot")).where(F.col("__slot") <= F.greatest(F.floor(F.col("__n") * share), F.lit(1))).withColumn("estimator", every)
    drawn = slots.withColumn("__i", F.floor(hashrand.uniform("boot", seed, F.col("estimator"), F.col("__slot"), *(F.col(s) for s in strata)) * F.col("__n")).cast("long"))
    counts = drawn.groupBy("estimator", *strata, "__i").agg(F.count("*").alias("weight"))
    # merged, as the planner takes the draws of many estimators for as small as the table they are drawn from, and would broadcast them
    return ranked.join(counts.hint("merge"), [*strata, "__i"]).select(*rows.columns, "estimator", "weight")


def mean_of(members: DataFrame, column: str, keys=("sample", "class")) -> DataFrame:
    return members.groupBy(*keys).agg(F.avg(column).alias(column))


def log_mean_of(members: DataFrame, column: str, keys=("sample", "class")) -> DataFrame:
    """The logarithm of the mean of what the column holds logarithms of, without overflow."""
    top = members.join(members.groupBy(*keys).agg(F.max(column).alias("__top")), list(keys))
    return top.groupBy(*keys).agg((F.max("__top") + F.log(F.sum(F.exp(F.col(column) - F.col("__top")))) - F.log(F.count("*"))).alias(column))


class Bagging:
    """An ensemble of one kind of estimator on bootstrap draws of rows and features.

    Classifiers are drawn within classes, regressors are not. Members with ``fit_sums`` on up to ``SUMMED``
    features are fitted from sums that batches are reduced to. Others are fitted by one task each, which
    has its draw in a file beside it if it is large; estimators that are not ``in_blocks`` read it whole.
    The fitted members, few and small, are held by the driver and broadcast.
    """

    def __init__(self, estimator="ridge", n_estimators: int = 10, max_samples: float = 1.0, max_features: float = 1.0, bootstrap: bool = True, bootstrap_features: bool = False, oob_score: bool = False, warm_start: bool = False, seed: int = 0, **params):
        if oob_score and not bootstrap:
            raise ValueError("out-of-bag scores need a bootstrap")
        if oob_score and warm_start:
            raise ValueError("out-of-bag scores are not kept over a warm start")
        if not 0 < max_features <= 1:
            raise ValueError("the share of features must be in (0, 1]")
        self.estimator, self.n_estimators, self.max_samples, self.max_features = estimator, n_estimators, max_samples, max_features
        self.bootstrap, self.bootstrap_features, self.oob, self.warm_start, self.seed, self.params = bootstrap, bootstrap_features, oob_score, warm_start, seed, params
        self.members: list[tuple[np.ndarray, object]] = []
        self.kind = make(estimator, **params).kind

    def columns_of(self, member: int, p: int) -> np.ndarray:
        """The features a member is given: drawn from its own seed, so that it can be told again."""
        random = np.random.default_rng([self.seed, member])
        n = max(1, int(self.max_features * p))
        return random.integers(0, p, n) if self.bootstrap_features else np.sort(random.choice(p, n, replace=False))

    def fit(self, matrix: DataFrame, x: str, y: str, key: str) -> Bagging:
        have = len(self.members) if self.warm_start else 0
        if self.n_estimators < have:
            raise ValueError(f"{have} members are fitted already, {self.n_estimators} are asked for")
        self.members = self.members[:have]
        if self.n_estimators == have:
            return self
        rows = matrix.select(F.col(key).alias("__key"), F.col(x).alias("__x"), F.col(y).alias("__y"))
        sample = draws(rows, self.n_estimators - have, self.max_samples, "__y" if self.kind == "classifier" else None, self.bootstrap, self.seed, "__key", have)

        if self.oob:
            sample = sample.persist()
        width = rows.agg(F.max(F.size("__x"))).first()[0] or 0
        numeric = dict(rows.dtypes)["__y"] in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
        if hasattr(make(self.estimator, **self.params), "fit_sums") and numeric and 0 < width <= SUMMED:
            sums = sums_by(sample, "estimator", width, F.col("weight"))
            for member in range(have, self.n_estimators):
                columns = self.columns_of(member, width)
                self.members.append((columns, fit_from(make(self.estimator, **self.params), sums[member], sums[None], columns)))
        else:
            self.members += self._fitted(sample, self.n_estimators - have)
        if self.oob:
            self.oob_score_ = self._oob(matrix, sample, x, y, key)
            sample.unpersist()
        return self

    def _fitted(self, sample: DataFrame, n: int) -> list:
        """Members fitted on their rows, which come to a task in batches, in the order of their keys."""

        def model_of(member, columns, values, truth, weight) -> bytes:
            found = make(self.estimator, **self.params)
            return pickle.dumps((columns, found.fit(values if getattr(found, "in_blocks", False) else np.asarray(values), np.concatenate(truth), np.concatenate(weight))))

        def run(batches):
            member, held = None, None
            for pdf in batches:
                for name, part in pdf.groupby("estimator", sort=True):
                    values = np.stack(part["__x"].to_numpy()).astype(float)
                    if name != member:
                        if held is not None:
                            yield pd.DataFrame({"estimator": [member], "model": [model_of(member, *held)]})
                        columns = self.columns_of(int(name), values.shape[1])
                        member, held = int(name), (columns, Spilled(len(columns)), [], [])
                    held[1].append(values[:, held[0]])
                    held[2].append(part["__y"].to_numpy())
                    held[3].append(part["weight"].to_numpy(float))
            if held is not None:
                yield pd.DataFrame({"estimator": [member], "model": [model_of(member, *held)]})

        dealt = sample.select("estimator", "__key", "__x", "__y", "weight").repartition(4 * n, "estimator").sortWithinPartitions("estimator", "__key")
        fitted = dealt.mapInPandas(run, "estimator int, model binary").orderBy("estimator").collect()
        return [pickle.loads(r["model"]) for r in fitted]

    def _oob(self, matrix, sample, x, y, key) -> float:
        out = self._each(matrix, x, key, y).join(sample.select(F.col("__key").alias("sample"), "estimator").hint("merge"), ["sample", "estimator"], "left_anti")
        if self.kind == "classifier":
            best = mean_of(out, "value", ("sample", "class", "y")).groupBy("sample", "y").agg(F.max_by("class", "value").alias("class"))
            return float(best.agg(F.avg((F.col("class") == F.col("y").cast("string")).cast("double"))).first()[0])
        row = mean_of(out, "value", ("sample", "y")).agg(F.sum(F.pow(F.col("y") - F.col("value"), 2)), F.var_pop("y") * F.count("y")).first()
        return float(1 - row[0] / row[1]) if row[1] else 0.0

    def _each(self, matrix: DataFrame, x: str, key: str, y: str | None = None, what: str = "predict") -> DataFrame:
        """(sample, estimator, class, value[, y]) for every row and member."""
        members, classifier = matrix.sparkSession.sparkContext.broadcast(self.members), self.kind == "classifier"
        kinds = dict(matrix.dtypes)
        width = max((int(c.max()) + 1 for c, _ in self.members), default=0)

        def run(batches):
            for pdf in batches:
                values = np.stack(pdf["__x"].to_numpy()).astype(float)
                if values.shape[1] < width:
                    raise ValueError(f"{values.shape[1]} features, the members were fitted on {width} or more")
                for i, (columns, model) in enumerate(members.value):
                    part = values[:, columns]
                    if classifier:
                        if what == "decision":
                            found = np.atleast_2d(model.decision_function(part).T).T
                        else:
                            found = model.predict_proba(part)
                        labels = model.classes_ if found.shape[1] == len(model.classes_) else model.classes_[1:]
                    else:
                        found = model.predict(part).reshape(len(pdf), -1)
                        labels = range(found.shape[1])
                    for label, column in zip(labels, found.T, strict=True):
                        yield pdf.drop(columns="__x").assign(estimator=i, value=column, **{"class": str(label)})

        extra = f", y {kinds[y]}" if y else ""
        rows = matrix.select(F.col(key).alias("sample"), F.col(x).alias("__x"), *([F.col(y).alias("y")] if y else []))
        return rows.mapInPandas(run, f"sample {kinds[key]}{extra}, estimator int, value double, `class` string")

    def predict_proba(self, matrix: DataFrame, x: str, key: str) -> DataFrame:
        """(sample, class, value): the members' mean; a class that a member has not seen counts as 0 there."""
        n = len(self.members)
        return self._each(matrix, x, key).groupBy("sample", "class").agg((F.sum("value") / n).alias("value"))

    def predict_log_proba(self, matrix: DataFrame, x: str, key: str) -> DataFrame:
        return self.predict_proba(matrix, x, key).withColumn("value", F.log("value"))

    def decision_function(self, matrix: DataFrame, x: str, key: str) -> DataFrame:
        if not hasattr(make(self.estimator, **self.params), "decision_function"):
            raise AttributeError("the members have no decision function")
        return mean_of(self._each(matrix, x, key, what="decision"), "value")

    def predict(self, matrix: DataFrame, x: str, key: str) -> DataFrame:
        """(sample, prediction)"""
        if self.kind == "classifier":
            best = self.predict_proba(matrix, x, key).groupBy("sample").agg(F.max_by("class", F.struct("value", "class")).alias("prediction"))
            return best
        return mean_of(self._each(matrix, x, key), "value", ("sample", "class")).groupBy("sample").agg(F.first("value").alias("prediction"))

    def score(self, matrix: DataFrame, x: str, y: str, key: str) -> float:
        both = self.predict(matrix, x, key).join(matrix.select(F.col(key).alias("sample"), F.col(y).alias("y")), "sample")
        if self.kind == "classifier":
            return float(both.agg(F.avg((F.col("prediction") == F.col("y").cast("string")).cast("double"))).first()[0])
        row = both.agg(F.sum(F.pow(F.col("y") - F.col("prediction"), 2)), F.var_pop("y") * F.count("y")).first()
        return 1 - row[0] / row[1] if row[1] and not math.isnan(row[1]) else 0.0
