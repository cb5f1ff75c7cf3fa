"""Small estimators in numpy: fitted on one worker's rows, pickled to the others.

Each has ``fit(x, y, weights)``, ``predict(x)`` and ``score(x, y)``; classifiers also ``predict_proba``
in the order of ``classes_`` and, if they have one, ``decision_function``.
"""

from __future__ import annotations

import numpy as np

from nodeloom.plans.spilled import blocks


def largest(x, share: np.ndarray) -> float:
    """The square of the largest singular value of the rows of x and one, each times the root of its share."""
    total = 0.0
    for at, part in blocks(x):
        z = np.hstack([part, np.ones((len(part), 1))])
        total = total + z.T @ (z * share[at, None])
    return float(np.linalg.eigvalsh(total)[-1])


def r2(y: np.ndarray, p: np.ndarray) -> float:
    spread = ((y - y.mean(0)) ** 2).sum()
    return float(1 - ((y - p) ** 2).sum() / spread) if spread > 0 else 0.0


def soft(x: np.ndarray, by) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


class Regressor:
    kind = "regressor"

    def score(self, x, y) -> float:
        return r2(np.asarray(y, float), self.predict(x))


class Classifier:
    kind = "classifier"

    def predict(self, x) -> np.ndarray:
        return self.classes_[self.predict_proba(x).argmax(1)]

    def score(self, x, y) -> float:
        return float((self.predict(x) == np.asarray(y)).mean())


class Ridge(Regressor):
    """Least squares with a squared penalty on the coefficients."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, x, y, weights=None):
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        y = np.asarray(y, float)
        mx, my = np.average(x, 0, w), np.average(y, 0, w)
        z = (x - mx) * np.sqrt(w)[:, None]
        t = (y - my) * (np.sqrt(w) if y.ndim == 1 else np.sqrt(w)[:, None])
        return self.fit_sums(len(x), mx, my, z.T @ z, z.T @ t)

    def fit_sums(self, n: int, mx, my, xx, xy):
        """From the means of x and y, and the sums of products of what is left without them."""
        self.coef_ = np.linalg.solve(xx + self.alpha * np.eye(len(xx)), xy)
        self.intercept_ = my - mx @ self.coef_
        return self

    def predict(self, x) -> np.ndarray:
        return x @ self.coef_ + self.intercept_


class SparseGroup:
    """Loss plus alpha times (l1_ratio |b|_1 + (1 - l1_ratio) sum sqrt(size) |b_group|_2), by accelerated proximal steps."""

    def __init__(self, alpha: float = 0.1, l1_ratio: float = 1.0, groups: list[list[int]] | None = None, max_iter: int = 2_000, tol: float = 1e-7):
        self.alpha, self.l1_ratio, self.groups, self.max_iter, self.tol = alpha, l1_ratio, groups, max_iter, tol

    def shrink(self, b: np.ndarray, step: float) -> np.ndarray:
        b = soft(b, step * self.alpha * self.l1_ratio)
        for g in self.groups or ():
            size = np.linalg.norm(b[g])
            cut = step * self.alpha * (1 - self.l1_ratio) * np.sqrt(len(g))
            b[g] = b[g] * max(0.0, 1 - cut / size) if size > 0 else 0.0
        return b

    def descend(self, x: np.ndarray, y: np.ndarray, slope, curvature: float, w: np.ndarray) -> None:
        """Fits coef_ and intercept_ on rows, a matrix or spilled; ``slope(z, y)`` is the loss's derivative by the linear output."""
        share = w / w.sum()
        step = 1 / max(curvature * largest(x, share), 1e-12)
        b, ahead, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 1.0
        for _ in range(self.max_iter):
            down = np.zeros(len(b))
            for at, part in blocks(x):
                pull = share[at] * slope(part @ ahead[:-1] + ahead[-1], y[at])
                down += np.append(part.T @ pull, pull.sum())
            new = ahead - step * down
            new[:-1] = self.shrink(new[:-1], step)
            turn = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / turn * (new - b)
            moved = np.abs(new - b).max()
            b, t = new, turn
            if moved < self.tol:
                break
        self.coef_, self.intercept_ = b[:-1], float(b[-1])


class SparseGroupRegressor(SparseGroup, Regressor):
    """Half the mean squared error with the sparse-group penalty (Simon et al., 2013)."""

    def fit(self, x, y, weights=None):
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        y = np.asarray(y, float)
        mx, my = np.average(x, 0, w), np.average(y, weights=w)
        z, share = x - mx, w / w.sum()
        return self.fit_sums(1, mx, my, z.T @ (share[:, None] * z), z.T @ (share * (y - my)))

    def fit_sums(self, n: int, mx, my, xx, xy):
        """From the means of x and y, and the sums of products of what is left without them: all that the loss depends on."""
        xx, xy = xx / n, xy / n
        step = 1 / max(np.linalg.norm(xx, 2), 1e-12)
        b, ahead, t = np.zeros(len(xx)), np.zeros(len(xx)), 1.0
        for _ in range(self.max_iter):
            new = self.shrink(ahead - step * (xx @ ahead - xy), step)
            turn = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / turn * (new - b)
            moved = np.abs(new - b).max(initial=0)
            b, t = new, turn
            if moved < self.tol:
                break
        self.coef_, self.intercept_ = b, float(my - mx @ b)
        return self

    def predict(self, x) -> np.ndarray:
        return x @ self.coef_ + self.intercept_


class SparseGroupClassifier(SparseGroup, Classifier):
    """Logistic loss on two classes with the sparse-group penalty."""

    in_blocks = True  # x may be spilled rows

    def fit(self, x, y, weights=None):
        self.classes_ = np.unique(y)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed")
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        self.descend(x, (np.asarray(y) == self.classes_[1]).astype(float), lambda z, t: 1 / (1 + np.exp(-np.clip(z, -60, 60))) - t, 0.25, w)
        return self

    def decision_function(self, x) -> np.ndarray:
        return x @ self.coef_ + self.intercept_

    def predict_proba(self, x) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.decision_function(x), -60, 60)))
        return np.stack([1 - p, p], 1)


class Logistic(Classifier):
    """Multinomial logistic regression with a squared penalty, by accelerated gradient steps."""

    in_blocks = True  # x may be spilled rows

    def __init__(self, alpha: float = 1e-2, max_iter: int = 300):
        self.alpha, self.max_iter = alpha, max_iter

    def fit(self, x, y, weights=None):
        self.classes_, code = np.unique(y, return_inverse=True)
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        share, eye = w / w.sum(), np.eye(len(self.classes_))
        step = 1 / (0.5 * largest(x, share) + self.alpha)
        b = before = np.zeros((x.shape[1] + 1, len(self.classes_)))
        for k in range(self.max_iter):
            ahead = b + k / (k + 3) * (b - before)
            slope = np.zeros_like(ahead)
            for at, part in blocks(x):
                pull = (self._share(part @ ahead[:-1] + ahead[-1]) - eye[code[at]]) * share[at, None]
                slope[:-1] += part.T @ pull
                slope[-1] += pull.sum(0)
            slope[:-1] += self.alpha * ahead[:-1]
            before, b = b, ahead - step * slope
        self.coef_, self.intercept_ = b[:-1], b[-1]
        return self

    @staticmethod
    def _share(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def decision_function(self, x) -> np.ndarray:
        return x @ self.coef_ + self.intercept_

    def predict_proba(self, x) -> np.ndarray:
        return self._share(self.decision_function(x))


class Stump(Classifier):
    """One threshold on one feature, the best by weighted Gini impurity."""

    def fit(self, x, y, weights=None):
        self.classes_, code = np.unique(y, return_inverse=True)
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        hot = np.eye(len(self.classes_))[code] * w[:, None]
        total, best = hot.sum(0), -np.inf
        self.feature_, self.cut_, self.low_, self.high_ = 0, np.inf, total, total
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, under = x[order, j], np.cumsum(hot[order], 0)[:-1]
            over = total - under
            gain = (under**2).sum(1) / np.maximum(under.sum(1), 1e-300) + (over**2).sum(1) / np.maximum(over.sum(1), 1e-300)
            gain[v[1:] == v[:-1]] = -np.inf
            if len(gain) and gain.max() > best:
                i = int(gain.argmax())
                best, self.feature_, self.cut_, self.low_, self.high_ = gain[i], j, (v[i] + v[i + 1]) / 2, under[i], over[i]
        return self

    def predict_proba(self, x) -> np.ndarray:
        low, high = (c / max(c.sum(), 1e-300) for c in (self.low_, self.high_))
        return np.where((x[:, self.feature_] <= self.cut_)[:, None], low, high)


class AdaBoost(Classifier):
    """SAMME boosting of a base classifier."""

    def __init__(self, base=Stump, n_estimators: int = 50, learning_rate: float = 1.0, **params):
        self.base, self.n_estimators, self.learning_rate, self.params = base, n_estimators, learning_rate, params

    def fit(self, x, y, weights=None):
        y = np.asarray(y)
        self.classes_ = np.unique(y)
        w = np.ones(len(x)) / len(x) if weights is None else np.asarray(weights, float) / np.sum(weights)
        self.members_ = []
        for _ in range(self.n_estimators):
            member = self.base(**self.params).fit(x, y, w)
            wrong = member.predict(x) != y
            error = float(w[wrong].sum())
            if error >= 1 - 1 / len(self.classes_):
                break
            say = self.learning_rate * (np.log((1 - error) / max(error, 1e-10)) + np.log(max(len(self.classes_) - 1, 1)))
            self.members_.append((say, member))
            if error <= 0:
                break
            w = w * np.exp(say * wrong)
            w /= w.sum()
        return self

    def predict_proba(self, x) -> np.ndarray:
        votes = sum(((member.predict(x)[:, None] == self.classes_) * say for say, member in self.members_), np.full((len(x), len(self.classes_)), 1e-12))
        return votes / votes.sum(1, keepdims=True)


class Transformed(Regressor):
    """A regressor on a transformed target, its predictions transformed back."""

    def __init__(self, base, func, inverse):
        self.base, self.func, self.inverse = base, func, inverse

    def fit(self, x, y, weights=None):
        self.base.fit(x, self.func(np.asarray(y, float)), weights)
        return self

    def predict(self, x) -> np.ndarray:
        return self.inverse(self.base.predict(x))


ESTIMATORS = {"ridge": Ridge, "lasso": SparseGroupRegressor, "sgl": SparseGroupRegressor, "sgl_logistic": SparseGroupClassifier, "logistic": Logistic, "stump": Stump, "adaboost": AdaBoost}


def make(estimator, **params):
    """An estimator by name or class; a ready one as it is."""
    if isinstance(estimator, str):
        if estimator.lower() not in ESTIMATORS:
            raise ValueError(f"unknown estimator {estimator}")
        return ESTIMATORS[estimator.lower()](**params)
    if isinstance(estimator, type):
        if not hasattr(estimator, "fit"):
            raise ValueError(f"{estimator.__name__} is no estimator")
        return estimator(**params)
    if not hasattr(estimator, "fit"):
        raise ValueError("an estimator is a name, a class or an object with fit")
    return estimator
