"""Statistics of profiles by group: bins, mean profiles with intervals, and tests at each node."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions import hashrand
from nodeloom.functions.stats import f_tail, t_quantile
from nodeloom.sources.tables import NODE, SUBJECT, TRACT


def quantile_edges(df: DataFrame, column: str, q: int | Sequence[float]) -> list[float]:
    """Exact quantiles of a column; an int asks for that many equal parts."""
    at = list(np.linspace(0, 1, q + 1)) if isinstance(q, int) else list(q)
    return [float(x) for x in df.agg(F.percentile(F.col(f"`{column}`").cast("double"), F.array(*map(F.lit, map(float, at))))).first()[0]]


def width_edges(df: DataFrame, column: str, bins: int | Sequence[float]) -> list[float]:
    """Edges of equally wide bins, the first a thousandth of the range lower, or those given."""
    if not isinstance(bins, int):
        return [float(x) for x in bins]
    low, high = df.agg(F.min(f"`{column}`").cast("double"), F.max(f"`{column}`").cast("double")).first()
    if low == high:
        low, high = low - 0.001 * (abs(low) or 1), high + 0.001 * (abs(high) or 1)
        return [float(x) for x in np.linspace(low, high, bins + 1)]
    edges = np.linspace(low, high, bins + 1)
    edges[0] -= 0.001 * (high - low)
    return [float(x) for x in edges]


def bin_index(column: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """The right-closed bin, from 0; null outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (column > a) & (column <= b)
        if include_lowest and i == 0:
            inside |= column == a
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def bin_label(column: Column, edges: Sequence[float], name: str) -> Column:
    """The bin as text, with its edges."""
    labels = F.array(*(F.lit(f"{name} {a:.2f}-{b:.2f}") for a, b in zip(edges, edges[1:], strict=False)))
    return F.get(labels, column)


def hue(subjects: DataFrame, column: str | None, quantiles=None, bins=None, name: str | None = None) -> DataFrame:
    """(subjectID, hue): the group of each subject, one of quantiles, bins, values, or one for all."""
    if quantiles is not None and bins is not None:
        raise ValueError("ask for quantiles or for bins, not for both")
    if column is None:
        if name is not None or quantiles is not None or bins is not None:
            raise ValueError("a name or bins need a column to group by")
        return subjects.select(SUBJECT, F.lit("all").alias("hue"))
    value = F.col(f"`{column}`")
    if quantiles is None and bins is None:
        return subjects.select(SUBJECT, value.cast("string").alias("hue"))
    if name is None:
        raise ValueError("bins need a name")
    edges = quantile_edges(subjects, column, quantiles) if quantiles is not None else width_edges(subjects, column, bins)
    return subjects.select(SUBJECT, bin_label(bin_index(value, edges, quantiles is not None), edges, name).alias("hue"))


def mean_profiles(features: DataFrame, hues: DataFrame) -> DataFrame:
    """(metric, tractID, hue, nodeID, mean, n) over subjects with a value."""
    keys = ["metric", TRACT, "hue", NODE]
    return features.join(hues, SUBJECT).where("value is not null and hue is not null").groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


#: Bundles that displays leave out, and metrics that they show in other units.
HIDDEN, UNITS = ("HCC_", "Cingulum Hippocampus"), {"dki_md": 1000.0}


def displayed(table: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    """A table of (metric, tractID, ...) without the bundles that displays leave out, ``columns`` in display units."""
    shown = table.where(~reduce(lambda a, b: a | b, (F.col(TRACT).contains(h) for h in HIDDEN)))
    unit = reduce(lambda c, m: F.when(F.col("metric") == m, F.lit(UNITS[m])).otherwise(c), UNITS, F.lit(1.0))
    return shown.withColumns({c: F.col(c) * unit for c in columns})


#: The chances of at most 0, 1, 2, ... under a Poisson distribution with mean one.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]
#: Parts whose sums are added by themselves before the parts are.
SALTS = 32
#: Profile nodes times subjects in one product, subjects whose weights and nodes whose sums a task keeps.
CELLS, KEPT_SUBJECTS, HELD_GROUPS = 1_000_000, 4_096, 4_096


def replicate_weights(subject, n_boot: int, seed: int = 0) -> np.ndarray:
    """A subject's weight in every replicate, from the 32-bit words of hashes that name it."""
    words = b"".join(hashlib.md5(f"boot|{seed}|{subject}|{q}".encode()).digest() for q in range(-(-n_boot // 4)))
    return np.searchsorted(POISSON, (np.frombuffer(words, ">u4")[:n_boot] + 0.5) / 2**32).astype(float)


def profiles_with_intervals(features: DataFrame, hues: DataFrame, n_boot: int = 500, level: float = 95, seed: int = 0) -> DataFrame:
    """Mean profiles with bootstrap percentile intervals ``low`` and ``high``.

    Each value has a Poisson(1) weight per replicate, drawn from the hash of its subject, so replicates
    are sums that add up over any parts of the rows: each Arrow batch is reduced to ``n_boot`` pairs of
    sums per profile node, and these are added as arrays, in ``SALTS`` parts of a node and then over
    the parts. No group has to meet in one task, and no replicate is a row of its own.
    """
    keys = ["metric", TRACT, "hue", NODE]
    rows = features.join(hues, SUBJECT).where("value is not null and hue is not null").select(*keys, SUBJECT, "value")

    def sums(batches):
        held, subjects, first = {}, {}, None

        def add(pdf: pd.DataFrame) -> None:
            subject, names = pd.factorize(pdf[SUBJECT])
            grouped = pdf.groupby(keys, sort=False)
            if len(pdf) > 1 and len(names) * grouped.ngroups > CELLS:
                add(pdf.iloc[: len(pdf) // 2])
                add(pdf.iloc[len(pdf) // 2 :])
                return
            for name in names:
                if name not in subjects:
                    if len(subjects) >= KEPT_SUBJECTS:
                        subjects.clear()
                    subjects[name] = replicate_weights(name, n_boot, seed)
            weights = np.stack([subjects[name] if name in subjects else replicate_weights(name, n_boot, seed) for name in names], 1)
            group, value, shape = grouped.ngroup().to_numpy(), pdf["value"].to_numpy(), (grouped.ngroups, len(names))
            at = group * len(names) + subject
            here, total = (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (None, value))
            w, wv = (weights @ m.T for m in (here.astype(float), total))  # replicates by groups
            places = pdf[keys].to_numpy()[np.unique(group, return_index=True)[1]]
            for i, key in enumerate(map(tuple, places)):
                mine = held.setdefault(key, [0, 0.0, 0.0, 0.0])
                for j, x in enumerate((int(here[i].sum()), float(total[i].sum()), w[:, i], wv[:, i])):
                    mine[j] = mine[j] + x

        def given() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=keys)
            for j, c in enumerate(("n", "total", "w", "wv")):
                out[c] = [x[j] for x in held.values()]
            out.insert(len(keys), "salt", zlib.crc32(str(first).encode()) % SALTS)
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            first = pdf[SUBJECT].iloc[0] if first is None else first
            add(pdf)
            if len(held) > HELD_GROUPS:
                yield given()
        if held:
            yield given()

    def added(names: list[str], finish):
        """Sums of consecutive rows that agree in ``names``; of each only the running sums are held."""

        def run(batches):
            key, held = None, None
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    mine = tuple(getattr(row, k) for k in names)
                    if mine != key and held is not None:
                        out.append(finish(key, held))
                    if mine != key:
                        key, held = mine, [0, 0.0, np.zeros(n_boot), np.zeros(n_boot)]
                    for i, x in enumerate((row.n, row.total, row.w, row.wv)):
                        held[i] = held[i] + x
                if out:
                    yield pd.concat(out)
            if held is not None:
                yield finish(key, held)

        return run

    def whole(key, held) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip([*keys, "salt"], ([k] for k in key), strict=True)), "n": [held[0]], "total": [held[1]], "w": [held[2]], "wv": [held[3]]})

    def interval(key, held) -> pd.DataFrame:
        n, total, w, wv = held
        means = wv[w > 0] / w[w > 0]
        low, high = np.percentile(means, [(100 - level) / 2, (100 + level) / 2]) if len(means) else (None, None)
        return pd.DataFrame({**dict(zip(keys, ([k] for k in key), strict=True)), "n": [n], "mean": [total / n], "low": [low], "high": [high]})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.mapInPandas(sums, f"{kinds}, salt int, n long, total double, w array<double>, wv array<double>")
    salted = parts.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt").mapInPandas(added([*keys, "salt"], whole), parts.schema)
    return salted.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(added(keys, interval), f"{kinds}, n long, mean double, low double, high double")


def group_tests(features: DataFrame, groups: DataFrame, reference: str, level: float = 0.95) -> DataFrame:
    """At each (metric, tract, node): least squares on a group with two values, and its F test.

    ``groups`` has (subjectID, hue); ``coef`` is the other group's mean less that of ``reference``, with
    its interval and p value. Sums per node are grouped natively; only the tails of the distributions,
    one row per node, are Python.
    """
    keys = ["metric", TRACT, NODE]
    other = F.when(F.col("hue") != reference, F.col("value"))
    base = F.when(F.col("hue") == reference, F.col("value"))
    stats = features.join(groups, SUBJECT).where("value is not null and hue is not null").groupBy(*keys).agg(
        F.count(other).alias("n1"), F.avg(other).alias("m1"), F.var_pop(other).alias("v1"), F.count(base).alias("n0"), F.avg(base).alias("m0"), F.var_pop(base).alias("v0")
    )
    stats = stats.where("n0 > 0 and n1 > 0 and n0 + n1 > 2")
    df = F.col("n0") + F.col("n1") - 2
    spread = (F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1")) / df
    stats = stats.select(*keys, (F.col("m1") - F.col("m0")).alias("coef"), F.sqrt(spread * (1 / F.col("n0") + 1 / F.col("n1"))).alias("se"), df.alias("df"))

    @F.pandas_udf("p double, t double")
    def tails(coef: pd.Series, se: pd.Series, df: pd.Series) -> pd.DataFrame:
        f = np.divide(coef**2, se**2, out=np.full(len(coef), np.inf), where=se.to_numpy() > 0)
        return pd.DataFrame({"p": [f_tail(x, 1, d) for x, d in zip(f, df, strict=True)], "t": [t_quantile((1 + level) / 2, d) for d in df]})

    return stats.withColumn("x", tails("coef", "se", "df")).select(*keys, "coef", (F.col("coef") - F.col("x.t") * F.col("se")).alias("low"), (F.col("coef") + F.col("x.t") * F.col("se")).alias("high"), F.col("x.p").alias("p"))


def false_discovery(tests: DataFrame, p: str = "p", by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Adds ``q``, the p value corrected by Benjamini and Hochberg's step-up rule, within ``by``.

    Ties share their rank's value whatever their order. The rows are tests, one per node, not subjects.
    """
    every = Window.partitionBy(*by)
    up = every.orderBy(F.col(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # from the largest on: a frame that ends with the last row is computed anew for each row, one that grows is not
    down = every.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tests.withColumn("__raw", F.col(p) * F.count(p).over(every) / F.count(p).over(up))
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__raw")


def split(subjects: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Adds ``test``: true for about ``share`` of the subjects, by a hash of their id."""
    return subjects.withColumn("test", hashrand.uniform(seed, F.col(SUBJECT)) < share)
