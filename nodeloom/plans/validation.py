"""Cross-validation with results kept in a folder, so that a run taken up again skips what is done."""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.ranks import numbered
from nodeloom.plans.estimators import make, r2

SCORERS: dict[str, Callable] = {
    "r2": lambda model, x, y: r2(np.asarray(y, float), model.predict(x)),
    "neg_mean_squared_error": lambda model, x, y: -float(((np.asarray(y, float) - model.predict(x)) ** 2).mean()),
    "neg_mean_absolute_error": lambda model, x, y: -float(np.abs(np.asarray(y, float) - model.predict(x)).mean()),
    "accuracy": lambda model, x, y: float((model.predict(x) == np.asarray(y)).mean()),
    "score": lambda model, x, y: float(model.score(x, y)),
}


def scorers(scoring) -> dict[str, Callable]:
    """Scorers by name from a name, a function, a list or a dict of these; nothing is the model's own score."""
    if scoring is None:
        return {"score": SCORERS["score"]}
    if isinstance(scoring, str):
        return {"score": SCORERS[scoring]}
    if callable(scoring):
        return {"score": scoring}
    if isinstance(scoring, dict):
        return {k: SCORERS[v] if isinstance(v, str) else v for k, v in scoring.items()}
    return {s: SCORERS[s] for s in scoring}


def with_folds(rows: DataFrame, key: str, folds: int, stratify: str | None = None) -> DataFrame:
    """Adds ``fold``: parts of the rows in the order of their key, whose sizes differ by one at most; within classes if stratified."""
    placed = numbered(rows, [key], [stratify] if stratify else [], "__place", "__rows")
    place, n = F.col("__place"), F.col("__rows")
    if stratify:
        fold = place % folds
    else:
        size, longer = F.floor(n / folds), n % folds
        border = longer * (size + 1)
        fold = F.when(place < border, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - border) / F.greatest(size, F.lit(1))))
    return placed.withColumn("fold", fold.cast("int")).drop("__place", "__rows")


def fingerprint(rows: DataFrame) -> str:
    """A hash of the content of all rows, whatever their order."""
    one = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    return "|".join(str(v) for v in rows.agg(F.count("*"), F.sum(one), F.sum(one * (F.xxhash64(*rows.columns, F.lit(1)) % 1009))).first())


def cross_validate(matrix: DataFrame, x: str, y: str, key: str, estimator="ridge", folds: int = 5, scoring=None, params: dict | None = None, stratify: bool = False, return_train_score: bool = False, workdir: str | None = None, checkpoint: bool = False, return_estimator: bool = False) -> DataFrame:
    """(fold, metric, split, value, fit_time, score_time): each fold is fitted and scored by one task.

    With ``checkpoint`` the result is kept under ``workdir`` by a hash of the estimator, its parameters,
    the scoring and the content of the rows, and read from there the next time. ``return_estimator``
    adds the pickled model. A fold's rows must fit one task.
    """
    if checkpoint and not workdir:
        raise ValueError("a checkpoint needs a folder")
    spark, found = matrix.sparkSession, scorers(scoring)
    rows = matrix.select(F.col(key).alias("__key"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    path = None
    if checkpoint:
        import hashlib

        name = estimator if isinstance(estimator, str) else getattr(estimator, "__name__", type(estimator).__name__)
        said = json.dumps([name, params or {}, folds, sorted(found), stratify, return_train_score, return_estimator, fingerprint(rows)], sort_keys=True, default=repr)
        path = f"{workdir.rstrip('/')}/cv-{hashlib.sha256(said.encode()).hexdigest()}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            return spark.read.parquet(path)
    placed = with_folds(rows, "__key", folds, "__y" if stratify else None)
    each = placed.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__key")
        test = (pdf["fold"] == pdf["run"]).to_numpy()
        values, truth = np.stack(pdf["__x"].to_numpy()).astype(float), pdf["__y"].to_numpy()
        began = time.perf_counter()
        model = make(estimator, **(params or {})).fit(values[~test], truth[~test])
        fitted = time.perf_counter()
        out = [(m, "test", f(model, values[test], truth[test])) for m, f in found.items()]
        scored = time.perf_counter()
        if return_train_score:
            out += [(m, "train", f(model, values[~test], truth[~test])) for m, f in found.items()]
        result = pd.DataFrame(out, columns=["metric", "split", "value"]).assign(fold=int(pdf["run"].iloc[0]), fit_time=fitted - began, score_time=scored - fitted)
        if return_estimator:
            result["model"] = pickle.dumps(model)
        return result[["fold", "metric", "split", "value", "fit_time", "score_time", *["model"] * return_estimator]]

    schema = "fold int, metric string, split string, value double, fit_time double, score_time double" + ", model binary" * return_estimator
    scores = each.groupBy("run").applyInPandas(one, schema)
    if path is None:
        return scores
    scores.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _measures(kind: str):
    """Scores of (truth, prediction) rows as aggregates, by name."""
    error, truth = F.col("prediction") - F.col("truth"), F.col("truth")
    squares = F.sum(error * error)
    found = {
        "r2": F.when(F.var_pop(truth) > 0, 1 - squares / (F.var_pop(truth) * F.count(truth))).otherwise(0.0),
        "neg_mean_squared_error": -F.avg(error * error),
        "neg_mean_absolute_error": -F.avg(F.abs(error)),
        "accuracy": F.avg((F.col("prediction") == truth).cast("double")),
    }
    return found | {"score": found["accuracy" if kind == "classifier" else "r2"]}


def cross_validate_pipeline(pipeline, data, folds: int = 5, scoring=None, return_train_score: bool = False) -> DataFrame:
    """(fold, metric, split, value) of a pipeline on a dataset with one target.

    Its steps and its estimator are fitted on each fold's training subjects alone; the subjects left out
    are transformed by what was learned there. Folds are consecutive parts of the subjects in their order.
    """
    names = [scoring] if isinstance(scoring, str) else list(scoring or ["score"])
    placed, target, out = with_folds(data.subjects, "row_idx", folds), data._target(), None
    for k in range(folds):
        train, test = data.only(placed.where(F.col("fold") != k)), data.only(placed.where(F.col("fold") == k))
        fitted = pipeline.unfitted().fit(train)
        measures = _measures(getattr(fitted.estimate, "kind", "regressor"))
        for split, part in (("test", test), ("train", train))[: 1 + return_train_score]:
            truth = part.targets.select(F.col("subjectID").alias("sample"), F.col(target).cast("double").alias("truth"))
            both = fitted.predict(part).withColumn("prediction", F.col("prediction").cast("double")).join(truth, "sample")
            row = both.agg(*(measures[n].alias(n) for n in names))
            long = row.select(F.lit(k).alias("fold"), F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.lit(split).alias("split"), F.col(n).alias("value")) for n in names))).alias("s")).select("fold", "s.*")
            out = long if out is None else out.unionByName(long)
    return out


def summary(scores: DataFrame) -> DataFrame:
    """(metric, split, mean, std) over folds."""
    return scores.groupBy("metric", "split").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
