"""Augmentation of sequences, reproducible: every draw is named by a seed, the operator and its keys.

Sequences are long tables (sample_id, label, channel, step, value). The first group of operators is
native. The second works on one row per sample, its values packed as steps by channels, in Arrow
batches; partners are found by rank within their label, so finding one is an equality join.
"""

from __future__ import annotations

import inspect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions import hashrand
from nodeloom.functions.series import resample, spline_basis, warps

KEYS = ("sample_id", "channel", "step")


def _draw(name: str, seed: int, *keys: str):
    return (name, seed, *(F.col(k) for k in keys))


def steps(x: DataFrame) -> DataFrame:
    """(sample_id, n_steps)"""
    return x.groupBy("sample_id").agg((F.max("step") + 1).cast("int").alias("n_steps"))


def jitter(x: DataFrame, sigma: float = 0.03, seed: int = 0) -> DataFrame:
    """Normal noise added to every value."""
    return x.withColumn("value", F.col("value") + hashrand.normal(*_draw("jitter", seed, *KEYS), sigma=sigma))


def scaling(x: DataFrame, sigma: float = 0.1, seed: int = 0) -> DataFrame:
    """Every channel of a sample times its own normal draw around one."""
    return x.withColumn("value", F.col("value") * hashrand.normal(*_draw("scaling", seed, "sample_id", "channel"), sigma=sigma, mean=1.0))


def permutation(x: DataFrame, max_segments: int = 5, equal: bool = True, seed: int = 0) -> DataFrame:
    """The steps of a sample cut into one to ``max_segments`` - 1 segments, which change places, alike in all channels.

    ``equal`` segments differ by one step at most, the longer first; others are cut at random steps.
    """
    cut = x.join(steps(x), "sample_id").withColumn("n", 1 + hashrand.below(max_segments - 1, *_draw("permutation", seed, "sample_id")))
    if equal:
        small, longer = F.expr("n_steps div n"), F.expr("n_steps % n")
        border = longer * (small + 1)
        segment = F.when(F.col("step") < border, F.expr("step div (n_steps div n + 1)")).otherwise(longer + F.expr("(step - (n_steps % n) * (n_steps div n + 1)) div greatest(n_steps div n, 1)"))
    else:
        place = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_steps") - 2, F.lit(1))), lambda s: F.struct(hashrand.uniform("cut", seed, F.col("sample_id"), s).alias("u"), s.alias("s")))
        cuts = F.transform(F.slice(F.array_sort(place), 1, F.greatest(F.col("n") - 1, F.lit(1))), lambda p: p["s"])
        segment = F.when(F.col("n") == 1, 0).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("step"))))
    cut = cut.withColumn("segment", segment.cast("int"))
    order = Window.partitionBy("sample_id", "channel").orderBy(hashrand.uniform("segment", seed, F.col("sample_id"), F.col("segment")), "segment", "step")
    return cut.withColumn("step", (F.row_number().over(order) - 1).cast("int")).select(*x.columns)


def _resampled(x: DataFrame, source, low, high) -> DataFrame:
    """Values at fractional steps: two steps looked up within the same series."""
    position = x.withColumn("__at", source).withColumn("__i", F.greatest(low, F.least(high, F.floor("__at").cast("int"))))
    series = x.select("sample_id", "channel", F.col("step").alias("__s"), F.col("value").alias("__v"))
    one = position.drop("value").join(series.withColumnRenamed("__s", "__i").withColumnRenamed("__v", "__v0"), ["sample_id", "channel", "__i"])
    one = one.withColumn("__j", F.least(F.col("__i") + 1, high))
    two = one.join(series.withColumnRenamed("__s", "__j").withColumnRenamed("__v", "__v1"), ["sample_id", "channel", "__j"])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__at") - F.col("__i")))
    return two.withColumn("value", F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share)


def window_slice(x: DataFrame, ratio: float = 0.9, by_channel: bool = False, seed: int = 0) -> DataFrame:
    """A random window of a share of the steps, stretched to all of them; the end repeats the last value."""
    names = ["sample_id", *["channel"] * by_channel]
    size = F.ceil(ratio * F.col("n_steps")).cast("int")
    cut = x.join(steps(x), "sample_id").withColumn("__len", size)
    whole = F.col("__len") >= F.col("n_steps")
    cut = cut.withColumn("__start", F.when(whole, 0).otherwise(hashrand.below(F.col("n_steps") - F.col("__len"), *_draw("slice", seed, *names))))
    at = F.when(whole, F.col("step").cast("double")).otherwise(F.col("__start") + F.col("step") * F.col("__len") / (F.col("n_steps") - 1))
    return _resampled(cut, at, F.col("__start"), F.least(F.col("__start") + F.col("__len"), F.col("n_steps")) - 1).select(*x.columns)


def pack(x: DataFrame) -> DataFrame:
    """(sample_id, label, n_channels, x): one row per sample, values by step, then channel."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("step", "channel", "value"))), lambda s: s["value"])
    return x.groupBy("sample_id", "label").agg((F.max("channel") + 1).cast("int").alias("n_channels"), values.alias("x"))


def unpack(packed: DataFrame) -> DataFrame:
    n = F.col("n_channels")
    return packed.select("sample_id", "label", "n_channels", F.posexplode("x").alias("i", "value")).select("sample_id", "label", (F.col("i") % n).cast("int").alias("channel"), F.expr("i div n_channels").cast("int").alias("step"), "value")


#: Samples whose alignments are made together.
TOGETHER = 1_024


def _aligned(changes: list, slope: str, shape: bool) -> list:
    """What each change returns. One that yields (pairs to align, whether their paths are wanted) is sent their warps, which are made for all at once."""
    out, waiting = list(changes), {}

    def go_on(i: int, sent) -> None:
        try:
            waiting[i] = changes[i].send(sent)
        except StopIteration as e:
            out[i] = e.value

    for i, c in enumerate(changes):
        if inspect.isgenerator(c):
            go_on(i, None)
    while waiting:
        asked, sent = dict(waiting), {}
        waiting.clear()
        for paths in (False, True):
            some = [i for i, (_, wanted) in asked.items() if wanted == paths]
            found = iter(warps([pair for i in some for pair in asked[i][0]], slope, shape, paths=paths))
            sent |= {i: [next(found) for _ in asked[i][0]] for i in some}
        for i, found in sent.items():
            go_on(i, found)
    return out


def _each(packed: DataFrame, name: str, seed: int, change, extra: tuple[str, ...] = (), slope: str = "symmetric", shape: bool = False, measured: str | None = None) -> DataFrame:
    """``change(steps by channels, random, row)`` for every sample; what it returns takes the place of its values.

    With ``measured`` it also returns a number, which becomes a column of that name.
    """
    columns = ["sample_id", "label", "n_channels", "x"]
    kinds = dict(packed.dtypes)

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), TOGETHER):
                pdf = whole.iloc[start : start + TOGETHER]
                changes = [change(np.asarray(row.x, float).reshape(-1, row.n_channels), hashrand.Draws(name, seed, row.sample_id), row) for row in pdf.itertuples(index=False)]
                found = _aligned(changes, slope, shape)
                values = [np.asarray(f[0] if measured else f, float).reshape(-1) for f in found]
                yield pdf[columns[:3]].assign(x=values, **({measured: [f[1] for f in found]} if measured else {}))

    return packed.select(*columns, *extra).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + (f", {measured} double" if measured else ""))


def _curve(own: np.ndarray, random: hashrand.Draws, sigma: float, knots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(own)
    at = np.linspace(0, n - 1, knots + 2)
    return at, 1 + sigma * random.normals(knots + 2, own.shape[1]), spline_basis(at, np.arange(n))


def magnitude_warp(packed: DataFrame, sigma: float = 0.2, knots: int = 4, seed: int = 0) -> DataFrame:
    """Every channel times a smooth random curve around one."""

    def change(own, random, row):
        _, values, basis = _curve(own, random, sigma, knots)
        return own * (basis @ values)

    return _each(packed, "magnitude", seed, change)


def time_warp(packed: DataFrame, sigma: float = 0.2, knots: int = 4, seed: int = 0) -> DataFrame:
    """Every channel along a smooth random clock that ends with the last step."""

    def change(own, random, row):
        at, values, basis = _curve(own, random, sigma, knots)
        clock = basis @ (at[:, None] * values)
        last = len(own) - 1
        clock = np.clip(clock * last / np.where(clock[-1] == 0, 1, clock[-1]), 0, last)
        return np.stack([np.interp(np.arange(len(own)), clock[:, c], own[:, c]) for c in range(own.shape[1])], 1)

    return _each(packed, "time", seed, change)


def window_warp(packed: DataFrame, ratio: float = 0.1, scales: tuple[float, ...] = (0.5, 2.0), by_channel: bool = False, seed: int = 0) -> DataFrame:
    """A random window stretched or shrunk in place, and the whole brought back to its length."""

    def one(own, random, *channel):
        n = len(own)
        size = math.ceil(ratio * n)
        start = 1 + random.below(max(1, n - size - 2), "start", *channel)
        part = resample(own[start : start + size], max(1, int(size * scales[random.below(len(scales), "scale", *channel)])))
        return resample(np.concatenate((own[:start], part, own[start + size :])), n)

    def change(own, random, row):
        if not by_channel:
            return one(own, random)
        return np.concatenate([one(own[:, c : c + 1], random, c) for c in range(own.shape[1])], 1)

    return _each(packed, "window", seed, change)


def ranked(packed: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """Adds each sample's rank within its label, the label's size and where its ranks begin among all.

    Only ids are ranked, in buckets of a label, so neither values nor a large label meet in one task.
    """
    ids = packed.select("sample_id", "label")
    sizes = ids.groupBy("label").agg(F.count("*").alias("size"))
    begin = sizes.withColumn("begin", F.sum("size").over(Window.orderBy("label")) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy()))
    placed = ids.join(begin, "label").withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.ceil(F.col("size") / per_bucket)))
    counts = placed.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("label").orderBy("bucket")) - F.col("n")).drop("n")
    inner = Window.partitionBy("label", "bucket").orderBy("sample_id")
    ranks = placed.join(before, ["label", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inner) - 1)
    return packed.join(ranks.select("sample_id", "label", "size", "begin", "total", "rank"), ["sample_id", "label"])


def with_partner(packed: DataFrame, name: str, seed: int) -> DataFrame:
    """Adds ``partner``: the values of another sample of the same label, drawn at random; null if there is none."""
    known = ranked(packed)
    other = (F.col("rank") + 1 + hashrand.below(F.greatest(F.col("size") - 1, F.lit(1)), name, seed, F.col("sample_id"))) % F.col("size")
    asked = known.withColumn("__other", F.when(F.col("size") > 1, other))
    offers = known.select("label", F.col("rank").alias("__other"), F.col("x").alias("partner"))
    return asked.join(offers, ["label", "__other"], "left")


def with_draws(packed: DataFrame, same: int, different: int, name: str, seed: int, own: bool) -> DataFrame:
    """Adds ``same`` and ``different``: values of samples with the sample's label and with others, without repeats.

    ``own``: the sample itself may be drawn.
    """
    known = ranked(packed).withColumn("at", F.col("begin") + F.col("rank"))
    offers = known.select(F.col("at").alias("__at"), F.col("x").alias("__x"))
    skip, pool = (0, F.col("size")) if own else (1, F.col("size") - 1)
    start = hashrand.below(F.greatest(pool, F.lit(1)), name, seed, F.col("sample_id"))
    first = F.transform(F.sequence(F.lit(0), F.lit(max(same - 1, 0))), lambda t: F.when((t < pool) & (t < same), F.col("begin") + (F.col("rank") + skip + (start + t) % F.greatest(pool, F.lit(1))) % F.col("size")))
    rest = F.col("total") - F.col("size")
    begin = hashrand.below(F.greatest(rest, F.lit(1)), name, seed, "others", F.col("sample_id"))
    second = F.transform(F.sequence(F.lit(0), F.lit(max(different - 1, 0))), lambda t: F.when((t < rest) & (t < different), (F.col("begin") + F.col("size") + (begin + t) % F.greatest(rest, F.lit(1))) % F.col("total")))
    asked = known.withColumn("start", start).withColumn("begin2", begin)
    picks = asked.select("sample_id", F.explode(F.concat(F.transform(first, lambda a: F.struct(F.lit(True).alias("same"), a.alias("__at"))), F.transform(second, lambda a: F.struct(F.lit(False).alias("same"), a.alias("__at"))))).alias("p")).select("sample_id", "p.same", "p.__at").where("__at is not null")
    lists = picks.join(offers, "__at").groupBy("sample_id").agg(F.collect_list(F.when(F.col("same"), F.struct("__at", "__x"))).alias("s"), F.collect_list(F.when(~F.col("same"), F.struct("__at", "__x"))).alias("d"))
    values = lambda c: F.transform(F.array_sort(F.col(c)), lambda p: p["__x"])
    return packed.join(lists, "sample_id", "left").withColumn("same", values("s")).withColumn("different", values("d")).drop("s", "d")


def _band(own: np.ndarray, use_window: bool) -> int | None:
    return math.ceil(len(own) / 10) if use_window else None


def spawner(packed: DataFrame, sigma: float = 0.05, seed: int = 0) -> DataFrame:
    """The mean of a sample and a partner aligned in two parts around a random step, with noise."""

    def change(own, random, row):
        split = random.uniform("split")
        noise = sigma * random.normals(*own.shape)
        if row.partner is None:
            return own + noise
        other = np.asarray(row.partner, float).reshape(-1, row.n_channels)
        a, b = (min(len(z) - 1, 1 + int(split * max(1, len(z) - 2))) for z in (own, other))
        band = _band(own, True)
        (_, p1, q1), (_, p2, q2) = yield [(own[:a], other[:b], max(band, abs(a - b))), (own[a:], other[b:], max(band, abs(len(own) - a - len(other) + b)))], True
        p, q = np.concatenate((p1, p2 + a)), np.concatenate((q1, q2 + b))
        return resample((own[p] + other[q]) / 2, len(own)) + noise

    return _each(with_partner(packed, "spawner", seed), "spawner", seed, change, ("partner",))


def barycenter(packed: DataFrame, batch: int = 6, slope: str = "symmetric", use_window: bool = True, seed: int = 0) -> DataFrame:
    """A weighted mean of draws of the sample's label, aligned with the draw nearest to all others."""

    def change(own, random, row):
        draws = [np.asarray(d, float).reshape(-1, row.n_channels) for d in (row.same if row.same is not None else [])]
        if not draws:
            return own
        k, band = len(draws), _band(own, use_window)
        apart = np.zeros((k, k))
        apart[~np.eye(k, dtype=bool)] = [w[0] for w in (yield [(draws[i], draws[j], band) for i in range(k) for j in range(k) if i != j], False)]
        center = int(np.argsort(apart.sum(1), kind="stable")[0])
        order = np.argsort(apart[center], kind="stable")
        nearest = apart[center, order[1]] if k > 1 else 0.0
        total, weights = np.zeros_like(draws[center]), np.zeros(len(draws[center]))
        others = [i for i in order if i != center and nearest != 0]
        along = dict(zip(others, (yield [(draws[center], draws[i], band) for i in others], True), strict=True))
        for i in order:
            if i == center or nearest == 0:
                total, weights = total + draws[center], weights + 1
                continue
            _, p, q = along[i]
            weight = math.exp(math.log(0.5) * apart[center, i] / nearest) if len(p) else 0.0
            if weight:
                last = {int(a): int(b) for a, b in zip(p, q, strict=True)}  # of several partners of a step the last counts
                at = np.array(list(last))
                total[at] += weight * draws[i][list(last.values())]
                weights[at] += weight
        return total / weights[:, None]

    return _each(with_draws(packed, batch, 0, "barycenter", seed, True), "barycenter", seed, change, ("same",), slope)


def guided_warp(packed: DataFrame, slope: str = "symmetric", use_window: bool = True, shape: bool = False, seed: int = 0) -> DataFrame:
    """A sample along the time of a random partner."""

    def change(own, random, row):
        if row.partner is None:
            return own
        ((_, _, q),) = yield [(np.asarray(row.partner, float).reshape(-1, row.n_channels), own, _band(own, use_window))], True
        return resample(own[q], len(own)) if len(q) else own

    return _each(with_partner(packed, "guided", seed), "guided", seed, change, ("partner",), slope, shape)


def discriminative_warp(packed: DataFrame, batch: int = 6, slope: str = "symmetric", use_window: bool = True, shape: bool = False, variable_slice: bool = True, seed: int = 0) -> DataFrame:
    """A sample along the time of the draw of its label that tells labels apart best, then a window of it.

    The draw with the largest mean distance to draws of other labels less that to its own is taken. The
    window shrinks from all to nine tenths the less a sample was warped, against the most warped of all.
    """
    drawn = with_draws(packed, math.ceil(batch / 2), batch // 2, "discriminative", seed, False)

    def warped_by_draws(own, random, row):
        as_rows = lambda lists: [np.asarray(d, float).reshape(-1, row.n_channels) for d in (lists if lists is not None else [])]
        same, other = as_rows(row.same), as_rows(row.different)
        if not same:
            return own, 0.0
        band = _band(own, use_window)
        apart = iter((yield [(a, b, band) for a in same for b in (*other, *(c for c in same if c is not a))], False))
        far = lambda n: [next(apart)[0] for _ in range(n)]
        mean = lambda v: sum(v) / len(v) if v else 0.0
        gain = [mean(far(len(other))) - mean(far(len(same) - 1)) for _ in same]
        ((_, _, q),) = yield [(same[int(np.argmax(gain))], own, band)], True
        if not len(q):
            return own, 0.0
        amount = float(np.abs(np.arange(len(own)) - np.interp(np.linspace(0, len(q) - 1, len(own)), np.arange(len(q)), q)).sum())
        return resample(own[q], len(own)), amount

    warped = _each(drawn, "discriminative", seed, warped_by_draws, ("same", "different"), slope, shape, "amount")
    if not variable_slice:
        return warped.drop("amount")
    warped = warped.persist()  # read for the largest amount, and again
    most = warped.agg(F.max("amount").alias("most"))
    sliced = warped.join(F.broadcast(most)).withColumn("ratio", F.when(F.col("most") > 0, 0.9 + 0.1 * F.col("amount") / F.col("most")).otherwise(0.9))

    def change(own, random, row):
        n = len(own)
        size = math.ceil(row.ratio * n)
        if size >= n:
            return own
        start = random.below(n - size, "slice")
        at = np.linspace(0, size, n)
        return np.stack([np.interp(at, np.arange(size), own[start : start + size, c]) for c in range(own.shape[1])], 1)

    return _each(sliced, "discriminative", seed, change, ("ratio",))


def warp_distances(pairs: DataFrame, slope: str = "asymmetric", window: int | None = None, shape: bool = False) -> DataFrame:
    """Adds distance and path of dynamic time warping to rows (n_channels, prototype, sample)."""

    @F.pandas_udf("distance double, path array<struct<i:int,j:int>>")
    def run(n: pd.Series, prototype: pd.Series, sample: pd.Series) -> pd.DataFrame:
        pairs = [(np.asarray(a, float).reshape(-1, c), np.asarray(b, float).reshape(-1, c), window) for c, a, b in zip(n, prototype, sample, strict=True)]
        rows = [(distance, [{"i": int(i), "j": int(j)} for i, j in zip(p, q, strict=True)]) for distance, p, q in warps(pairs, slope, shape)]
        return pd.DataFrame(rows, columns=["distance", "path"])

    return pairs.withColumn("__w", run("n_channels", "prototype", "sample")).select(*pairs.columns, "__w.distance", "__w.path")
