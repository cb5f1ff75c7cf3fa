"""Choice of the sparse-group penalty by cross-validation, all settings and folds side by side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.estimators import SparseGroupClassifier, SparseGroupRegressor
from nodeloom.plans.fitted import SUMMED, Fitted, fit_from, sums_by
from nodeloom.plans.validation import with_folds


def path(matrix: DataFrame, x: str, y: str, key: str, groups: list[list[int]], alphas: Sequence[float], l1_ratios: Sequence[float] = (1.0,), folds: int = 3, classifier: bool = False) -> DataFrame:
    """(alpha, l1_ratio, fold, score, n_nonzero).

    Regressors on up to ``SUMMED`` features are fitted from the sums of the other folds and scored by another
    pass over the rows, so no task holds a fold. Otherwise a task has one setting and fold, whose rows must fit it.
    """
    kind = SparseGroupClassifier if classifier else SparseGroupRegressor
    rows = with_folds(matrix.select(F.col(key).alias("__key"), F.col(x).alias("__x"), F.col(y).alias("__y")), "__key", folds)
    if not classifier:
        width = rows.agg(F.max(F.size("__x"))).first()[0] or 0
        if 0 < width <= SUMMED:
            return _from_sums(rows, width, groups, [(float(a), float(r)) for a in alphas for r in l1_ratios], folds)
    settings = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(r)).alias("l1_ratio"), F.lit(k).alias("run")) for a in alphas for r in l1_ratios for k in range(folds)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__key")
        first, test = pdf.iloc[0], (pdf["fold"] == pdf["run"]).to_numpy()
        values, truth = np.stack(pdf["__x"].to_numpy()).astype(float), pdf["__y"].to_numpy()
        model = kind(float(first["alpha"]), float(first["l1_ratio"]), groups).fit(values[~test], truth[~test])
        return pd.DataFrame({"alpha": [first["alpha"]], "l1_ratio": [first["l1_ratio"]], "fold": [int(first["run"])], "score": [model.score(values[test], truth[test])], "n_nonzero": [int((model.coef_ != 0).sum())]})

    each = rows.withColumn("s", F.explode(settings)).select("__key", "__x", "__y", "fold", "s.*")
    return each.groupBy("alpha", "l1_ratio", "run").applyInPandas(one, "alpha double, l1_ratio double, fold int, score double, n_nonzero int")


def _from_sums(rows: DataFrame, width: int, groups: list[list[int]], settings: list[tuple[float, float]], folds: int) -> DataFrame:
    spark, rows = rows.sparkSession, rows.persist()
    sums = sums_by(rows, "fold", width)
    center, runs = sums.pop(None), [k for k in range(folds) if k in sums]
    fitted = [(k, a, ratio, fit_from(SparseGroupRegressor(a, ratio, groups), sum(s for fold, s in sums.items() if fold != k), center)) for a, ratio in settings for k in runs]
    models = spark.sparkContext.broadcast({k: (np.stack([m.coef_ for run, *_, m in fitted if run == k], 1), np.array([m.intercept_ for run, *_, m in fitted if run == k])) for k in runs})

    def errors(batches):
        total = {}
        for pdf in batches:
            for k, part in pdf.groupby("fold", sort=False):
                coef, intercept = models.value[k]
                left = part["__y"].to_numpy(float)[:, None] - (np.stack(part["__x"].to_numpy()).astype(float) @ coef + intercept)
                total[k] = total.get(k, 0.0) + (left**2).sum(0)
        if total:
            yield pd.DataFrame({"fold": list(total), "e": list(total.values())})

    parts = rows.select("fold", "__x", F.col("__y").cast("double").alias("__y")).mapInPandas(errors, "fold int, e array<double>")
    found = {(r["fold"], r["i"]): r["e"] for r in parts.select("fold", F.posexplode("e").alias("i", "e")).groupBy("fold", "i").agg(F.sum("e").alias("e")).collect()}
    rows.unpersist()
    out = []
    for i, (a, ratio) in enumerate(settings):
        for k in runs:
            n, y, yy = sums[k][0], sums[k][width + 2], sums[k][width + 3]
            spread = yy - y * y / n
            model = next(m for run, alpha, share, m in fitted if (run, alpha, share) == (k, a, ratio))
            out.append((a, ratio, int(k), float(1 - found[k, i] / spread) if spread > 0 else 0.0, int((model.coef_ != 0).sum())))
    return spark.createDataFrame(out, "alpha double, l1_ratio double, fold int, score double, n_nonzero int")


class SparseGroupCV:
    """The sparse-group estimator with the setting of the best mean score, fitted on all rows."""

    def __init__(self, groups: list[list[int]], alphas: Sequence[float], l1_ratios: Sequence[float] = (1.0,), folds: int = 3, classifier: bool = False):
        self.groups, self.alphas, self.l1_ratios, self.folds, self.classifier = groups, alphas, l1_ratios, folds, classifier

    def fit(self, matrix: DataFrame, x: str, y: str, key: str) -> SparseGroupCV:
        scores = path(matrix, x, y, key, self.groups, self.alphas, self.l1_ratios, self.folds, self.classifier)
        best = scores.groupBy("alpha", "l1_ratio").agg(F.avg("score").alias("score")).orderBy(F.desc("score"), F.desc("alpha"), "l1_ratio").first()
        self.alpha_, self.l1_ratio_, self.score_ = best["alpha"], best["l1_ratio"], best["score"]
        kind = SparseGroupClassifier if self.classifier else SparseGroupRegressor
        self.fitted_ = Fitted(kind(self.alpha_, self.l1_ratio_, self.groups)).fit(matrix, x, y, key)
        return self

    def predict(self, matrix: DataFrame, x: str, key: str) -> DataFrame:
        return self.fitted_.predict(matrix, x, key)

    def score(self, matrix: DataFrame, x: str, y: str, key: str) -> float:
        return self.fitted_.score(matrix, x, y, key)
