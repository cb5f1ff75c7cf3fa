"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of labelled rows whose labels are then ignored is
the unlabelled set, an unbiased draw of all texts. With the class prior p, estimated from the labels
of all training rows, the risk of a scorer g under the logistic loss is

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

(Kiryo et al., 2017). Each of a few linear numpy classifiers descends it by mini-batches; where the
second term falls below zero the step goes the other way, so the positives are not memorised. The
inputs are the words of a text and their first letters, present or not, each weighted by the log
ratio of its rates among positives and unlabelled. The score is the sigmoid of the mean output less
the cut that has the least risk of the same kind with decisions in the place of losses.

At most ``positives`` and ``unlabelled`` labelled rows are fitted on, chosen by a hash of their id;
every text is scored whole.

Defined cases: null and empty texts get the score of a text without known words; without positives
or without unlabelled rows every score is the prior; repeated rows each get a row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm._common import append_columns, held_out
from nodeloom.llm.learning import Adam, first_rows, labelled, sigmoid, softplus, with_texts

#: Labelled rows that the classifiers are fitted on, at most.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Features kept, the smallest number of sampled texts that must have one, and letters of a word's start.
FEATURES, LEAST, START = 8_000, 4, 4
MEMBERS, STEPS, BATCH, RATE, DECAY = 3, 400, 1_024, 0.05, 5e-4

_WORDS = re.compile(r"[^\W\d_]+").findall


def features(text: str) -> set[str]:
    """The words of a text in lower case, and the starts of the longer ones, marked by a hyphen."""
    words = set(_WORDS(text.lower()))
    return words | {w[:START] + "-" for w in words if len(w) > START}


class Rows:
    """Sampled texts as arrays of feature numbers, with the features' names."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.ids: list[np.ndarray] = []

    def add(self, words) -> None:
        number = self.names
        self.ids.append(np.array([number.setdefault(w, len(number)) for w in sorted(words)], np.int32))

    def counts(self, pick: np.ndarray) -> np.ndarray:
        """In how many of these texts each feature occurs."""
        total = np.zeros(len(self.names), np.int64)
        for i in pick:
            total[self.ids[i]] += 1
        return total


def gather(sample: DataFrame, rows: Rows) -> int:
    """Adds the texts of a bounded sample to ``rows``, and how many; only distinct words leave the executors."""

    def run(batches):
        for batch in batches:
            words = [" ".join(sorted(set(_WORDS(t.lower())))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["words"])

    found = sample.orderBy("__id").select("__text").mapInArrow(run, "words string").collect()
    for r in found:
        words = r["words"].split()
        rows.add({*words, *(x[:START] + "-" for x in words if len(x) > START)})
    return len(found)


class Sparse:
    """Rows of weighted features, for products with a weight vector."""

    def __init__(self, rows: list[np.ndarray], values: np.ndarray):
        self.col = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
        self.values = values
        self.starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def scores(self, pick: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = self.starts[pick + 1] - self.starts[pick]
        at = np.repeat(self.starts[pick] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        cols, rows = self.col[at], np.repeat(np.arange(len(pick)), lengths)
        return np.bincount(rows, weights[cols] * self.values[cols], len(pick)), rows, cols


def fit_member(x: Sparse, positive: np.ndarray, unlabelled: np.ndarray, prior: float, n_features: int, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier."""
    random = np.random.default_rng(seed)
    weights, bias = np.zeros(n_features), np.array([np.log(prior / (1 - prior))])
    adam = Adam([weights, bias], RATE, steps)
    for _ in range(steps):
        p = random.choice(positive, min(len(positive), BATCH), replace=False)
        u = random.choice(unlabelled, min(len(unlabelled), BATCH), replace=False)
        gp, rp, cp = x.scores(p, weights)
        gu, ru, cu = x.scores(u, weights)
        gp, gu = gp + bias, gu + bias
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        if negative >= 0:
            dp = (-prior * sigmoid(-gp) - prior * sigmoid(gp)) / len(p)
            du = sigmoid(gu) / len(u)
        else:  # the corrected risk of the negatives has gone below zero: step back
            dp = prior * sigmoid(gp) / len(p)
            du = -sigmoid(gu) / len(u)
        grad = np.bincount(cp, dp[rp] * x.values[cp], n_features) + np.bincount(cu, du[ru] * x.values[cu], n_features)
        adam.step([grad + DECAY * weights * (negative >= 0), np.array([dp.sum() + du.sum()])])
    return weights, float(bias[0])


def fit(rows: Rows, is_positive: list[bool], prior: float, members: int = MEMBERS, steps: int = STEPS) -> tuple[dict[str, float], float]:
    """Weight of each feature and bias of the mean of the classifiers."""
    positive = np.flatnonzero(is_positive)
    unlabelled = np.flatnonzero(~np.array(is_positive, bool))
    if not len(positive) or not len(unlabelled) or not 0 < prior < 1:
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return {}, float(np.log(prior / (1 - prior)))
    p, u = rows.counts(positive) + 1.0, rows.counts(unlabelled) + 1.0
    ratio = np.log(p / (len(positive) + 2)) - np.log(u / (len(unlabelled) + 2))
    telling = np.abs(ratio) * np.sqrt(p + u)  # rare words need a larger ratio
    names = list(rows.names)
    known = np.flatnonzero(p + u >= LEAST + 2).tolist()
    kept = sorted(known, key=lambda i: (-telling[i], names[i]))[:FEATURES]
    to = np.full(len(names), -1, np.int32)
    to[kept] = np.arange(len(kept))
    x = Sparse([(t := to[ids])[t >= 0] for ids in rows.ids], ratio[kept])
    found = [fit_member(x, positive, unlabelled, prior, len(kept), seed, steps) for seed in range(members)]
    weights = np.mean([w for w, _ in found], 0)
    output = x.scores(np.arange(len(rows.ids)), weights)[0]
    bias = -best_cut(output[positive], output[unlabelled], prior)
    return {names[i]: float(w) for i, w in zip(kept, weights * x.values, strict=True)}, bias


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The output to cut at: least corrected risk of wrong decisions, of such cuts the one in the widest gap."""
    values = np.unique(np.concatenate((positive, unlabelled)))
    if len(values) < 2:
        return float(values[0])
    cuts = (values[1:] + values[:-1]) / 2
    missed = np.searchsorted(np.sort(positive), cuts) / len(positive)
    taken = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    risk = prior * missed + np.maximum(0, taken - prior * (1 - missed))
    least = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[least[np.argmax(np.diff(values)[least])]])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    threshold: float = 0.5,
) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    spark = docs.sparkSession
    known = labelled(labels, label_col, id_col)
    rate = known.agg(F.avg("label")).first()[0]
    toxic = first_rows(known.where("label = 1"), positives)
    anyone = first_rows(known, unlabelled).select("__id", F.lit(0).alias("label"))
    rows = Rows()
    n = gather(with_texts(docs, toxic, id_col, text_col), rows)
    m = gather(with_texts(docs, anyone, id_col, text_col), rows)
    weights, bias = fit(rows, [True] * n + [False] * m, 0.5 if rate is None else float(rate))
    model = spark.sparkContext.broadcast((weights, bias))

    def make():
        weights, bias = model.value
        keys = frozenset(weights)

        def columns(texts):
            scores = sigmoid(np.array([bias + sum(map(weights.__getitem__, sorted(features(t) & keys))) for t in texts], float))
            return [scores, (scores >= threshold).astype(np.int32)]

        return columns

    return append_columns(docs.withColumn("held_out", held_out(id_col)), text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)
