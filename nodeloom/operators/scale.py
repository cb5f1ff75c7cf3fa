"""Imputers, scalers and the Yeo-Johnson transform, on long tables of (key, feature, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.operators import nearest

FEATURE = "feature_idx"


def fills(df: DataFrame, strategy: str = "mean", by: str = FEATURE) -> DataFrame:
    """(by, __fill): the mean, exact median or commonest value (smallest of equals) of each feature that has any."""
    if strategy == "most_frequent":
        counts = df.where("value is not null").groupBy(by, "value").agg(F.count("*").alias("n"))
        return counts.groupBy(by).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("__fill"))
    if strategy not in ("mean", "median"):
        raise ValueError(f"unknown strategy {strategy}")
    how = F.avg("value") if strategy == "mean" else F.median("value")
    return df.groupBy(by).agg(how.alias("__fill")).where("__fill is not null")


def filled(df: DataFrame, found: DataFrame, by: str = FEATURE) -> DataFrame:
    """Nulls replaced by what ``fills`` found; features it has nothing for are dropped."""
    return df.join(found, by).withColumn("value", F.coalesce("value", "__fill")).drop("__fill")


def impute(df: DataFrame, strategy: str = "mean", fill: float = 0.0, by: str = FEATURE) -> DataFrame:
    """Nulls replaced by the mean, exact median, commonest (smallest of equals) or a constant of their feature.

    Features without any value are dropped, except for a constant.
    """
    if strategy == "constant":
        return df.withColumn("value", F.coalesce("value", F.lit(float(fill))))
    return filled(df, fills(df, strategy, by), by)


#: Rows in one box or block that neighbours are sought in.
NEAREST_ROWS = 2_048


def impute_nearest(df: DataFrame, key: str, k: int = 5, by: str = FEATURE, rows: int = NEAREST_ROWS, among: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by the mean over the ``k`` nearest rows that have the feature, of ``among`` or of all rows.

    Distances are Euclidean over shared features, scaled up for those not shared; rows that share none
    are no neighbours, and a feature without neighbours gets its mean. Only rows with a null look for
    neighbours. Over few features they are sought in boxes of space (``nearest``), so that the work grows
    with the rows; over many, where space has no boxes to leave out, rows look at all rows, in blocks of
    about ``rows`` that meet two by two; a pair of blocks gives its ``k`` nearest, never its pairs.
    """
    means = (df if among is None else among).groupBy(by).agg(F.avg("value").alias("__mean")).where("__mean is not null").persist()
    names = sorted(r[0] for r in means.select(by).collect())
    df = df.join(F.broadcast(means), by)
    found = _in_boxes(df, among, key, k, by, names, rows) if 0 < len(names) <= nearest.FEW_FEATURES else None
    if found is None:
        found = _in_blocks(df, among, means, key, k, by, names, rows)
    filled = df.join(found, [key, by], "left")
    return filled.withColumn("value", F.coalesce("value", "__fill", "__mean")).drop("__fill", "__mean")


def _in_boxes(df: DataFrame, among: DataFrame | None, key: str, k: int, by: str, names: list, rows: int) -> DataFrame | None:
    """(key, by, __fill) of what rows lack; None if rows know too many different sets of features."""
    number = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    cells = [F.max(F.when(F.col(by) == n, number)).alias(f"x{j}") for j, n in enumerate(names)]
    known = reduce(lambda a, b: a + b, (F.when(F.col(f"x{j}").isNotNull(), 1 << j).otherwise(0) for j in range(len(names)))).cast("int")
    wide = lambda t: t.groupBy(key).agg(*cells, F.max(F.col("value").isNull()).alias("seeks")).withColumn("known", known).persist()
    packed = wide(df)
    offered = packed if among is None else wide(among)
    sets = lambda t: {r["known"]: r["n"] for r in t.groupBy("known").agg(F.count("*").alias("n")).collect()}
    pairs = nearest.searches(sets(packed.where("seeks")), sets(offered))
    if len(pairs) > nearest.FEW_SEARCHES:
        return None
    place = df.sparkSession.createDataFrame(list(enumerate(names)), f"place int, `{by}` {dict(df.dtypes)[by]}")
    found = nearest.found_in_boxes(packed.where("seeks"), offered, key, k, len(names), pairs, rows) if pairs else packed.where("false").select(key, F.lit(0).alias("place"), F.lit(0.0).alias("fill"))
    return found.join(F.broadcast(place), "place").select(key, by, F.col("fill").alias("__fill"))


def _in_blocks(df: DataFrame, among: DataFrame | None, means: DataFrame, key: str, k: int, by: str, names: list, rows: int) -> DataFrame:
    """(key, by, __fill) of what rows lack, by comparing all rows in blocks."""
    kinds = dict(df.dtypes)
    cells = F.collect_list(F.struct(F.col(by).alias("f"), F.col("value").cast("double").alias("v")))
    packed = df.groupBy(key).agg(cells.alias("x"), F.max(F.col("value").isNull()).alias("seeks"))
    offered = packed if among is None else among.join(means.select(by), by, "left_semi").groupBy(key).agg(cells.alias("x"))
    n, m = offered.count(), packed.where("seeks").count()
    pieces = lambda count: max(1, -(-count // rows))
    of = lambda count: F.pmod(F.xxhash64(key), F.lit(pieces(count))).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(pieces(count) - 1)))
    seekers = packed.where("seeks").select(F.col(key).alias("__a"), F.col("x").alias("x"), of(m).alias("i"), every(n).alias("j"))
    looked_at = offered.select(F.col(key).alias("__b"), F.col("x").alias("x"), of(n).alias("j"), every(m).alias("i"))
    place = {name: c for c, name in enumerate(names)}

    def dense(cells: pd.Series) -> np.ndarray:
        out = np.full((len(cells), len(names)), np.nan)
        for r, found in enumerate(cells):
            for cell in found:
                if cell["v"] is not None:
                    out[r, place[cell["f"]]] = cell["v"]
        return out

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("__b")  # of equal distances the smallest key
        x, y, mine, theirs = dense(a["x"]), dense(b["x"]), a["__a"].to_numpy(), b["__b"].to_numpy()
        out = []
        for r in range(len(x)):
            square = (y - x[r]) ** 2
            shared = (~np.isnan(square)).sum(1)
            usable = (shared > 0) & (theirs != mine[r])
            distance = np.full(len(y), np.inf)
            distance[usable] = np.nansum(square[usable], 1) * len(names) / shared[usable]
            order = np.argsort(distance, kind="stable")
            for c in np.flatnonzero(np.isnan(x[r])):
                best = order[usable[order] & ~np.isnan(y[order, c])][:k]
                out += [(mine[r], names[c], distance[o], theirs[o], y[o, c]) for o in best]
        return pd.DataFrame(out, columns=["__a", by, "__d", "__b", "__y"])

    schema = f"__a {kinds[key]}, `{by}` {kinds[by]}, __d double, __b {kinds[key]}, __y double"
    offers = seekers.groupBy("i", "j").cogroup(looked_at.groupBy("i", "j")).applyInPandas(lambda a, b: compared(a, b), schema)
    first = Window.partitionBy("__a", by).orderBy("__d", "__b")
    found = offers.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).groupBy("__a", by).agg(F.avg("__y").alias("__fill"))
    return found.withColumnRenamed("__a", key)


def spreads(df: DataFrame, how: str = "standard", by: str = FEATURE) -> DataFrame:
    """(by, __shift, __spread): what scaling takes off each feature's values and divides them by."""
    stats = {
        "standard": (F.avg("value"), F.stddev_pop("value")),
        "minmax": (F.min("value"), F.max("value") - F.min("value")),
        "maxabs": (F.lit(0.0), F.max(F.abs("value"))),
        "robust": (F.percentile("value", 0.5), F.percentile("value", 0.75) - F.percentile("value", 0.25)),
    }
    if how.lower() not in stats:
        raise ValueError(f"unknown scaler {how}")
    shift, spread = stats[how.lower()]
    found = df.groupBy(by).agg(shift.alias("__shift"), spread.alias("__spread"))
    return found.withColumn("__spread", F.when(F.col("__spread") == 0, 1.0).otherwise(F.col("__spread")))


def rescale(df: DataFrame, found: DataFrame, by: str = FEATURE) -> DataFrame:
    """Values shifted and divided by what ``spreads`` found."""
    return df.join(found, by).withColumn("value", (F.col("value") - F.col("__shift")) / F.col("__spread")).drop("__shift", "__spread")


def scale(df: DataFrame, how: str | None = "standard", by: str = FEATURE) -> DataFrame:
    """Values scaled within their feature: standard (population spread), minmax, maxabs, robust, or as they are.

    A feature without spread is only shifted.
    """
    return df if how is None else rescale(df, spreads(df, how, by), by)


def yeo_johnson(value: Column, power: Column) -> Column:
    """The transform of a value by a power."""
    up = F.when(F.abs(power) < 1e-12, F.log1p(value)).otherwise((F.pow(value + 1, power) - 1) / power)
    down = F.when(F.abs(power - 2) < 1e-12, -F.log1p(-value)).otherwise(-(F.pow(1 - value, 2 - power) - 1) / (2 - power))
    return F.when(value >= 0, up).otherwise(down)


def _bend(x: np.ndarray, power: float) -> np.ndarray:
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(power) < 1e-12 else (np.power(x[up] + 1, power) - 1) / power
    out[~up] = -np.log1p(-x[~up]) if abs(power - 2) < 1e-12 else -(np.power(1 - x[~up], 2 - power) - 1) / (2 - power)
    return out


#: Powers tried at a time, and how often the range around the best is tried again; each round is an eighth as wide.
POWERS, ROUNDS = 17, 4
#: How often a range is doubled at most.
WIDENED = 24


def best_powers(df: DataFrame, by: str = FEATURE, low: float = -4.0, high: float = 4.0) -> DataFrame:
    """(by, power): the power under which each feature's transformed values are likeliest normal.

    A range whose best power lies at its edge is doubled for that feature until it lies inside, ``WIDENED``
    times at most; powers under which values overflow or lose their spread are never the best. The
    likelihood needs sums only, so batches are reduced to them and features never meet in one task.
    """
    kind = dict(df.dtypes)[by]
    known = df.where("value is not null").select(F.col(by).alias("__by"), F.col("value").cast("double").alias("__x"))
    ranges = known.select("__by").distinct().select("__by", F.lit(low).alias("low"), F.lit(high).alias("high"))

    def sums(batches):
        for pdf in batches:
            for name, part in pdf.groupby("__by", sort=False):
                x, grid = part["__x"].to_numpy(), np.linspace(part["low"].iloc[0], part["high"].iloc[0], POWERS)
                with np.errstate(all="ignore"):  # what overflows is never the best
                    bent = [_bend(x, p) for p in grid]
                yield pd.DataFrame({"__by": name, "power": grid, "n": len(x), "s1": [y.sum() for y in bent], "s2": [(y * y).sum() for y in bent], "logs": (np.sign(x) * np.log1p(np.abs(x))).sum()})

    def losses(known, ranges):
        parts = known.join(ranges, "__by").mapInPandas(sums, f"__by {kind}, power double, n long, s1 double, s2 double, logs double")
        whole = parts.groupBy("__by", "power").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("logs").alias("logs"))
        spread = F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), F.lit(2.0))
        loss = F.when(spread > F.greatest(F.lit(1e-300), 1e-13 * F.col("s2") / F.col("n")), F.col("n") / 2 * F.log(spread) - (F.col("power") - 1) * F.col("logs"))
        best = whole.withColumn("loss", F.when(~F.isnan(loss), loss)).groupBy("__by").agg(F.min_by("power", "loss").alias("best"), F.min("power").alias("a"), F.max("power").alias("b"))
        return best.withColumn("step", (F.col("b") - F.col("a")) / (POWERS - 1))

    settled = None
    for widened in range(WIDENED):  # ranges of features whose best power is at the edge
        found = losses(known, ranges).persist()
        edge = F.coalesce((F.col("best") == F.col("a")) | (F.col("best") == F.col("b")), F.lit(False))
        inside = found.where(~edge)
        settled = inside if settled is None else settled.unionByName(inside)
        ranges = found.where(edge).select("__by", (F.col("a") * 2).alias("low"), (F.col("b") * 2).alias("high"))
        if ranges.isEmpty():
            break
    else:
        settled = settled.unionByName(found.where(edge))
    for _ in range(ROUNDS - 1 + -(-widened // 3)):  # as fine in the end, whatever the range
        near = settled.select("__by", F.coalesce(F.col("best") - F.col("step"), F.lit(1.0)).alias("low"), F.coalesce(F.col("best") + F.col("step"), F.lit(1.0)).alias("high"))
        settled = losses(known, near)
    ranges = settled.select("__by", F.coalesce("best", F.lit(1.0)).alias("__power"))
    return ranges.withColumnRenamed("__by", by)


def power_transform(df: DataFrame, by: str = FEATURE, standardize: bool = True) -> DataFrame:
    """Yeo-Johnson with each feature's best power, then standard scaling; a feature without spread stays as it is."""
    bent = bend(df, best_powers(df, by), by)
    return scale(bent, "standard", by) if standardize else bent


def bend(df: DataFrame, powers: DataFrame, by: str = FEATURE) -> DataFrame:
    """Yeo-Johnson with each feature's given power."""
    return df.join(powers, by).withColumn("value", yeo_johnson(F.col("value"), F.col("__power"))).drop("__power")


class Imputer:
    """Fills nulls with the statistics of the table it was fitted on: mean, median, most_frequent or constant."""

    def __init__(self, strategy: str = "mean", fill: float = 0.0):
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise ValueError(f"unknown strategy {strategy}")
        self.strategy, self.fill = strategy, fill

    def fit(self, features: DataFrame) -> Imputer:
        self.found_ = None if self.strategy == "constant" else fills(features, self.strategy).persist()
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        return impute(features, "constant", self.fill) if self.found_ is None else filled(features, self.found_)


class NearestImputer:
    """Fills nulls with the mean over the nearest rows of the table it was fitted on."""

    def __init__(self, k: int = 5, key: str = "subjectID"):
        self.k, self.key = k, key

    def fit(self, features: DataFrame) -> NearestImputer:
        self.among_ = features
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        return impute_nearest(features, self.key, self.k, among=self.among_)


class Scaler:
    """Scales with the statistics of the table it was fitted on: standard, minmax, maxabs or robust."""

    def __init__(self, how: str = "standard"):
        self.how = how

    def fit(self, features: DataFrame) -> Scaler:
        self.found_ = spreads(features, self.how).persist()
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        return rescale(features, self.found_)


class PowerTransformer:
    """Yeo-Johnson with the powers, and then standard scaling with the statistics, of the table it was fitted on."""

    def __init__(self, standardize: bool = True):
        self.standardize = standardize

    def fit(self, features: DataFrame) -> PowerTransformer:
        self.powers_ = best_powers(features).persist()
        self.scaler_ = Scaler().fit(bend(features, self.powers_)) if self.standardize else None
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        bent = bend(features, self.powers_)
        return self.scaler_.transform(bent) if self.scaler_ else bent


def group_components(df: DataFrame, key: str, n: int, group: str = "group_idx", by: str = FEATURE) -> DataFrame:
    """(key, group, component, value): the first ``n`` principal components of each group's features.

    Every row must have all features of a group. Batches are reduced to sums and cross products, which are
    added natively; only the covariance of a group meets in one task, never its rows.
    """
    kind = dict(df.dtypes)[group]
    values = F.transform(F.array_sort(F.collect_list(F.struct(by, F.col("value").cast("double").alias("value")))), lambda s: s["value"])
    packed = df.groupBy(key, group).agg(values.alias("x")).withColumnRenamed(group, "__g")

    def sums(batches):
        for pdf in batches:
            for g, part in pdf.groupby("__g", sort=False):
                x = np.stack(part["x"].to_numpy())
                yield pd.DataFrame({"__g": [g], "sums": [np.concatenate(([len(x)], x.sum(0), (x.T @ x).reshape(-1)))]})

    parts = packed.select("__g", "x").mapInPandas(sums, f"__g {kind}, sums array<double>")
    total = parts.select("__g", F.posexplode("sums").alias("i", "s")).groupBy("__g", "i").agg(F.sum("s").alias("s"))
    whole = total.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("sums"))

    @F.pandas_udf("mean array<double>, axes array<double>")
    def axes(found: pd.Series) -> pd.DataFrame:
        rows = []
        for s in found:
            s = np.asarray(s)
            p = int(round((np.sqrt(4 * len(s) - 3) - 1) / 2))
            mean = s[1 : p + 1] / s[0]
            _, vectors = np.linalg.eigh(s[p + 1 :].reshape(p, p) / s[0] - np.outer(mean, mean))
            top = vectors[:, ::-1][:, :n].T
            top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]
            rows.append((mean, top.reshape(-1)))
        return pd.DataFrame(rows, columns=["mean", "axes"])

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series, mean: pd.Series, axes: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(a).reshape(-1, len(v)) @ (np.asarray(v) - np.asarray(m)) for v, m, a in zip(x, mean, axes, strict=True)])

    fitted = whole.select("__g", axes("sums").alias("f")).select("__g", "f.mean", "f.axes")
    scored = packed.join(fitted, "__g").select(key, F.col("__g").alias(group), scores("x", "mean", "axes").alias("s"))
    return scored.select(key, group, F.posexplode("s").alias("component", "value"))


class Harmoniser:
    """Site effects of place and scale removed with empirical-Bayes shrinkage (Johnson et al., 2007).

    Features are standardised by the pooled fit of sites and covariates; each site's effects shrink towards
    their mean over features. ``fit`` needs sums per feature and site only, which are added natively, and
    then one row per site and feature; ``transform`` applies what was fitted to any rows of the same sites.
    Nulls are left out and stay null, as do the values of sites that were not fitted.
    """

    def __init__(self, site: str, covariates: Sequence[str] = (), by: str = FEATURE, key: str = "subjectID", rounds: int = 500):
        self.site, self.covariates, self.by, self.key, self.rounds = site, list(covariates), by, key, rounds

    def fit(self, df: DataFrame) -> Harmoniser:
        by, site, q = self.by, self.site, len(self.covariates)
        known = df.where(F.col("value").isNotNull()).select(F.col(by).alias("__f"), F.col(site).alias("__s"), F.col("value").cast("double").alias("y"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.covariates)))
        c = [f"c{i}" for i in range(q)]
        within = lambda a, b: F.covar_pop(a, b) * F.count("y")
        sums = known.groupBy("__f", "__s").agg(
            F.count("y").alias("n"), F.avg("y").alias("my"), within("y", "y").alias("wyy"), *(F.avg(x).alias(f"m{x}") for x in c), *(within(x, "y").alias(f"w{x}y") for x in c), *(within(a, b).alias(f"w{a}{b}") for a in c for b in c)
        )
        pooled = sums.groupBy("__f").agg(F.sum("n").alias("total"), F.sum("wyy").alias("pyy"), *(F.sum(f"w{x}y").alias(f"p{x}y") for x in c), *(F.sum(f"w{a}{b}").alias(f"p{a}{b}") for a in c for b in c))

        @F.pandas_udf("array<double>")
        def slopes(cc: pd.Series, cy: pd.Series) -> pd.Series:
            return pd.Series([np.linalg.lstsq(np.reshape(a, (q, q)), np.asarray(b, float), rcond=None)[0] for a, b in zip(cc, cy, strict=True)])

        empty = F.array().cast("array<double>")
        pooled = pooled.withColumn("beta", slopes(F.array(*(f"p{a}{b}" for a in c for b in c)), F.array(*(f"p{x}y" for x in c))) if c else empty)
        b = [F.col("beta")[i] for i in range(q)]
        left = F.col("pyy") - sum((b[i] * F.col(f"p{x}y") for i, x in enumerate(c)), F.lit(0.0))
        pooled = pooled.select("__f", "total", "beta", F.sqrt(F.greatest(left / F.col("total"), F.lit(1e-12))).alias("spread"))
        each = sums.join(pooled, "__f")
        each = each.withColumn("alpha", F.col("my") - sum((b[i] * F.col(f"m{x}") for i, x in enumerate(c)), F.lit(0.0)))
        base = each.groupBy("__f").agg((F.sum(F.col("alpha") * F.col("n")) / F.max("total")).alias("base"))
        own = F.col("wyy") - 2 * sum((b[i] * F.col(f"w{x}y") for i, x in enumerate(c)), F.lit(0.0)) + sum((b[i] * b[j] * F.col(f"w{x}{z}") for i, x in enumerate(c) for j, z in enumerate(c)), F.lit(0.0))
        each = each.join(base, "__f").withColumn("place", (F.col("alpha") - F.col("base")) / F.col("spread"))
        each = each.withColumn("width", F.when(F.col("n") > 1, F.greatest(own, F.lit(0.0)) / (F.col("n") - 1) / F.pow("spread", F.lit(2.0))).otherwise(1.0))
        spare = lambda x: F.when(F.count(x) > 1, F.var_samp(x)).otherwise(0.0)
        prior = each.groupBy("__s").agg(F.avg("place").alias("mean"), spare("place").alias("tau"), F.avg("width").alias("m"), spare("width").alias("v"))
        rounds = self.rounds

        @F.pandas_udf("gamma double, delta double")
        def shrunk(n: pd.Series, place: pd.Series, width: pd.Series, mean: pd.Series, tau: pd.Series, m: pd.Series, v: pd.Series) -> pd.DataFrame:
            n, place, width, mean, tau, m, v = (x.to_numpy(float) for x in (n, place, width, mean, tau, m, v))
            gamma, delta = place.copy(), width.copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (2 * v + m**2) / v, (m * v + m**3) / v
                for _ in range(rounds):
                    new = np.where(tau > 0, (tau * n * place + delta * mean) / (tau * n + delta), mean)
                    rest = 0.5 * ((n - 1) * width * (n > 1) + n * (place - new) ** 2)
                    var = np.where(v > 0, (rest + b) / (n / 2 + a - 1), m)
                    done = max(np.abs(new - gamma).max(initial=0), np.abs(var - delta).max(initial=0)) < 1e-12
                    gamma, delta = new, var
                    if done:
                        break
            return pd.DataFrame({"gamma": gamma, "delta": np.maximum(delta, 1e-12)})

        effects = each.join(prior, "__s").withColumn("e", shrunk("n", "place", "width", "mean", "tau", "m", "v"))
        self.effects_ = effects.select(F.col("__f").alias(by), F.col("__s").alias(site), "beta", "base", "spread", "e.gamma", "e.delta").persist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """(key, site, by, value)"""
        joined = df.join(self.effects_, [self.by, self.site], "left")
        plain = F.col("base") + sum((F.col("beta")[i] * F.col(f"`{c}`").cast("double") for i, c in enumerate(self.covariates)), F.lit(0.0))
        value = ((F.col("value") - plain) / F.col("spread") - F.col("gamma")) / F.sqrt("delta") * F.col("spread") + plain
        return joined.select(self.key, self.site, self.by, value.alias("value"))


def combat(df: DataFrame, site: str, covariates: Sequence[str] = (), by: str = FEATURE, key: str = "subjectID", rounds: int = 500) -> DataFrame:
    """``Harmoniser`` fitted on the rows that it is applied to: (key, site, by, value)."""
    return Harmoniser(site, covariates, by, key, rounds).fit(df).transform(df)
