"""A chain of steps on a dataset: impute, scale, transform features, estimate."""

from __future__ import annotations

import copy
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame

from nodeloom.operators import scale as scaling
from nodeloom.plans.bagging import Bagging
from nodeloom.plans.dataset import ProfileDataset
from nodeloom.plans.estimators import AdaBoost, Transformed, make
from nodeloom.plans.fitted import Fitted
from nodeloom.plans.sgl import SparseGroupCV

IMPUTERS = ("simple", "knn")
SCALERS = ("standard", "minmax", "maxabs", "robust")
ENSEMBLES = ("bagging", "serial-bagging", "adaboost")


class Stateless:
    """A step that learns nothing: a function of features."""

    def __init__(self, change: Callable[[DataFrame], DataFrame], params: dict | None = None):
        self.change, self.params = change, params or {}

    def fit(self, features: DataFrame) -> Stateless:
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        return self.change(features, **self.params)


def _step(what: str, value, known: dict[str, Callable], optional: bool, params: dict):
    """An object with ``fit(features)`` and ``transform(features)`` from a name, a function, a class or such an object."""
    if value is None and optional:
        return Stateless(lambda features: features)
    if isinstance(value, str):
        if value.lower() not in known:
            raise ValueError(f"{what} must be one of {sorted(known)}, a function or a class; got {value!r}")
        return known[value.lower()](**params)
    if inspect.isclass(value):
        if not hasattr(value, "transform"):
            raise ValueError(f"{what} class {value.__name__} has no transform")
        made = value(**params)
        return made if hasattr(made, "fit") else Stateless(made.transform)
    if hasattr(value, "fit") and hasattr(value, "transform"):
        return value
    if callable(value):
        return Stateless(value, params)
    raise ValueError(f"{what} must be one of {sorted(known)}, a function or a class; got {value!r}")


@dataclass
class ProfilePipeline:
    """Steps by name, run in order on a dataset's features; the last estimates.

    ``fit`` fits each step on the features as the steps before leave them, and the estimator on what the
    last leaves. ``predict`` and ``score`` apply what was fitted, so a row's prediction does not depend on
    the rows beside it. ``persist`` keeps the features that the estimator sees, for models that read them
    more than once.
    """

    impute: object
    scale: object
    transform: object
    estimate: object | None
    persist: bool = False
    named_steps: dict = field(default_factory=dict)
    fitted: bool = False

    @property
    def steps(self) -> list:
        return [self.impute, self.scale, self.transform]

    def fit_steps(self, data: ProfileDataset) -> ProfileDataset:
        """The dataset as the fitted steps leave it."""
        for step in self.steps:
            step.fit(data.features)
            data = data.transform(step.transform)
        self.fitted = True
        return self._kept(data)

    def prepare(self, data: ProfileDataset) -> ProfileDataset:
        """Another dataset as the steps leave it, fitted before on theirs."""
        if not self.fitted:
            raise ValueError("the pipeline is not fitted")
        for step in self.steps:
            data = data.transform(step.transform)
        return self._kept(data)

    def _kept(self, data: ProfileDataset) -> ProfileDataset:
        return replace(data, features=data.features.persist()) if self.persist else data

    def fit(self, data: ProfileDataset) -> ProfilePipeline:
        if self.estimate is None:
            raise ValueError("the pipeline has no estimator")
        self.fit_steps(data).fit(self.estimate)
        return self

    def predict(self, data: ProfileDataset) -> DataFrame:
        return self.prepare(data).predict(self.estimate)

    def score(self, data: ProfileDataset) -> float:
        return self.prepare(data).score(self.estimate)

    def unfitted(self) -> ProfilePipeline:
        """A copy whose steps and estimator share nothing with this one's; of one that was not fitted yet."""
        if self.fitted:
            raise ValueError("the pipeline is fitted already")
        return copy.deepcopy(self)


def make_pipeline(
    imputer="simple",
    scaler="standard",
    feature_transformer=False,
    estimator=None,
    ensemble=None,
    imputer_kwargs: dict | None = None,
    scaler_kwargs: dict | None = None,
    transformer_kwargs: dict | None = None,
    estimator_kwargs: dict | None = None,
    ensemble_kwargs: dict | None = None,
    target_func: Callable | None = None,
    target_inverse: Callable | None = None,
    persist: bool = False,
) -> ProfilePipeline:
    """A pipeline from names, functions or classes.

    imputer: simple, knn. scaler: standard, minmax, maxabs, robust or None. feature_transformer: True
    for the power transform. ensemble: bagging, serial-bagging, adaboost, or a class that takes the
    estimator. target_func and target_inverse wrap a regressor.
    """
    impute = _step("imputer", imputer, {"simple": scaling.Imputer, "knn": scaling.NearestImputer}, False, imputer_kwargs or {})
    scale = _step("scaler", scaler, {s: partial(scaling.Scaler, s) for s in SCALERS}, True, scaler_kwargs or {})
    if feature_transformer is True:
        feature_transformer = "power"
    transform = _step("feature_transformer", feature_transformer or None, {"power": scaling.PowerTransformer}, True, transformer_kwargs or {})
    model = _estimate(estimator, ensemble, estimator_kwargs or {}, ensemble_kwargs or {}, target_func, target_inverse)
    steps = {"impute": imputer, "scale": scaler, "feature_transform": feature_transformer, "estimate": model}
    return ProfilePipeline(impute, scale, transform, model, persist, steps)


def _estimate(estimator, ensemble, params: dict, more: dict, func, inverse):
    if estimator is None:
        if ensemble is not None:
            raise ValueError("an ensemble needs an estimator")
        return None
    if isinstance(estimator, SparseGroupCV) or (not isinstance(estimator, (str, type)) and hasattr(estimator, "score") and "key" in inspect.signature(estimator.fit).parameters):
        return estimator
    base = make(estimator, **params)
    if (func is None) != (inverse is None):
        raise ValueError("a target function needs its inverse")
    if func is not None:
        if base.kind != "regressor":
            raise ValueError("only regressors' targets are transformed")
        return Fitted(Transformed(base, func, inverse))
    if ensemble is None:
        return Fitted(base)
    if isinstance(ensemble, str):
        if ensemble.lower() not in ENSEMBLES:
            raise ValueError(f"ensemble must be one of {ENSEMBLES} or a class; got {ensemble!r}")
        if ensemble.lower() == "adaboost":
            return Fitted(AdaBoost, base=type(base), **{**params, **more})
        return Bagging(estimator, **{**params, **more})
    if inspect.isclass(ensemble):
        return Fitted(ensemble(base, **more)) if not issubclass(ensemble, Bagging) else ensemble(estimator, **{**params, **more})
    raise ValueError("ensemble must be a name or a class")


def make_classifier_pipeline(groups, use_cv: bool = True, alphas=(0.1, 0.03, 0.01), l1_ratios=(1.0,), folds: int = 3, estimator_kwargs: dict | None = None, **steps) -> ProfilePipeline:
    """A pipeline that ends in a sparse-group logistic regression, its penalty chosen by cross-validation if ``use_cv``."""
    return _sparse(True, groups, use_cv, alphas, l1_ratios, folds, estimator_kwargs, steps)


def make_regressor_pipeline(groups, use_cv: bool = True, alphas=(0.1, 0.03, 0.01), l1_ratios=(1.0,), folds: int = 3, estimator_kwargs: dict | None = None, **steps) -> ProfilePipeline:
    """A pipeline that ends in a sparse-group regression, its penalty chosen by cross-validation if ``use_cv``."""
    return _sparse(False, groups, use_cv, alphas, l1_ratios, folds, estimator_kwargs, steps)


def _sparse(classifier: bool, groups, use_cv: bool, alphas, l1_ratios, folds: int, params: dict | None, steps: dict) -> ProfilePipeline:
    if "estimator" in steps:
        raise ValueError("the estimator of this pipeline is given")
    if use_cv and steps.get("ensemble") is None:
        return make_pipeline(estimator=SparseGroupCV(groups, alphas, l1_ratios, folds, classifier), **steps)
    name = "sgl_logistic" if classifier else "sgl"
    return make_pipeline(estimator=name, estimator_kwargs={"groups": groups, **(params or {})}, **steps)
