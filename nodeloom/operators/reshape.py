"""Node tables to gap-filled features, staying long throughout.

A feature is a (metric, tract, node); a wide matrix appears only as one array per subject, at the
border to a model. Gaps inside a profile are filled along the order of its nodes, not their numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.series import fill_smooth
from nodeloom.sources.tables import KEYS, NODE, SESSION, SUBJECT, TRACT

SERIES = (SUBJECT, TRACT, "metric")
#: Features up to which the dimensions are held as literals and a subject's values as one map.
DIMENSION_LIMIT = 100_000


def standard_id(column) -> F.Column:
    """The id with the prefix ``sub-``, unless it has it."""
    return F.when(column.startswith("sub-"), column).otherwise(F.concat(F.lit("sub-"), column))


def metrics_of(nodes: DataFrame) -> list[str]:
    return [c for c in nodes.columns if c not in (*KEYS, SESSION)]


def with_sessions(nodes: DataFrame, concat: bool) -> DataFrame:
    """Subjects named with their session if asked for; the session column goes."""
    if concat:
        if SESSION not in nodes.columns:
            raise ValueError("the node table has no sessions to join to its subjects")
        nodes = nodes.withColumn(SUBJECT, F.concat(F.col(SUBJECT), F.col(SESSION).cast("string")))
    return nodes.drop(SESSION)


def melt(nodes: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """(subject, tract, node, metric, value); NaN becomes null."""
    metrics = list(metrics or metrics_of(nodes))
    long = nodes.unpivot(list(KEYS), [F.col(f"`{m}`").cast("double").alias(m) for m in metrics], "metric", "value")
    return long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def collapse(long: DataFrame) -> DataFrame:
    """One value per cell, the mean of those there; cells without any are left out."""
    return long.groupBy(*SERIES, NODE).agg(F.avg("value").alias("value")).where("value is not null")


def node_positions(cells: DataFrame) -> DataFrame:
    """(nodeID, pos): the rank of each node that has a value anywhere."""
    return cells.select(NODE).distinct().withColumn("pos", F.row_number().over(Window.orderBy(NODE)) - 1)


def feature_dim(cells: DataFrame) -> DataFrame:
    """(metric, tractID, nodeID, pos, group_idx, feature_idx) for the whole grid, in that sorting order."""
    groups = cells.select("metric").distinct().join(cells.select(TRACT).distinct())
    groups = groups.withColumn("group_idx", F.row_number().over(Window.orderBy("metric", TRACT)) - 1)
    nodes = node_positions(cells)
    n = nodes.select(F.count("*").alias("__n"))
    return groups.join(nodes).join(n).select("metric", TRACT, NODE, "pos", "group_idx", (F.col("group_idx") * F.col("__n") + F.col("pos")).cast("int").alias("feature_idx"))


def dimensions(long: DataFrame) -> tuple[list[str], list[str], list[int]] | None:
    """Sorted metrics, tracts and nodes with a value, from one pass; None if their product is over the limit."""
    known = long.where("value is not null")
    sizes = known.agg(F.approx_count_distinct("metric"), F.approx_count_distinct(TRACT), F.approx_count_distinct(NODE)).first()
    if np.prod([float(x) for x in sizes]) > DIMENSION_LIMIT:
        return None
    return tuple(sorted(x) for x in known.agg(F.collect_set("metric"), F.collect_set(TRACT), F.collect_set(NODE)).first())


def grid(cells: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Every subject with a value times every feature, with the value or null.

    The values of a subject are gathered in one map and spread over the features, so that rows are
    partitioned by subject, as gap filling and matrices need them, and the grid itself is never shuffled.
    Dimensions too large for that are joined instead. ``long`` is what the cells were collapsed from.
    """
    found = dimensions(cells if long is None else long)
    if found is None:
        return cells.select(SUBJECT).distinct().join(feature_dim(cells)).join(cells, [SUBJECT, "metric", TRACT, NODE], "left")
    metrics, tracts, nodes = found
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    numbers = F.array(*map(F.lit, nodes)).cast("array<int>")
    place = lambda values, column: F.array_position(values, column).cast("int") - 1
    n, size = len(nodes), len(metrics) * len(tracts) * len(nodes)
    index = (place(texts(metrics), F.col("metric")) * len(tracts) + place(texts(tracts), F.col(TRACT))) * n + place(numbers, F.col(NODE))
    own = cells.groupBy(SUBJECT).agg(F.map_from_entries(F.collect_list(F.struct(index, "value"))).alias("__own"))
    spread = own.select(SUBJECT, "__own", F.explode(F.sequence(F.lit(0), F.lit(max(size - 1, 0)))).alias("feature_idx"))
    group, pos = F.expr(f"feature_idx div {max(n, 1)}").cast("int"), (F.col("feature_idx") % max(n, 1)).cast("int")
    return spread.select(
        SUBJECT,
        F.get(texts(metrics), F.expr(f"feature_idx div {max(n * len(tracts), 1)}").cast("int")).alias("metric"),
        F.get(texts(tracts), (group % max(len(tracts), 1)).cast("int")).alias(TRACT),
        F.get(numbers, pos).alias(NODE),
        pos.alias("pos"),
        group.alias("group_idx"),
        "feature_idx",
        F.try_element_at("__own", F.col("feature_idx")).alias("value"),
    )


#: Curves that are computed in Python, a series at a time.
SMOOTH = ("cubic", "quadratic", "polynomial", "pchip", "akima")


def interpolate(full: DataFrame, method: str = "linear", by: Sequence[str] = SERIES, order: int = 3, limit: int | None = None) -> DataFrame:
    """``value`` with the gaps inside each series filled along ``pos``; gaps at its ends stay.

    linear (slinear), nearest (the earlier of two equally near), ffill (pad, zero), bfill (backfill),
    index (values): a line by the node's number in place of its position; and the curves cubic,
    quadratic, polynomial of an ``order``, pchip and akima, which take a line where a series has too few
    values. ``limit`` leaves what is further than that many places from the value before unfilled.
    """
    if limit is not None:
        full = full.withColumn("__far", since(by))
    found = _smooth(full, by, method, order) if method in SMOOTH else _along(full, by, method)
    if limit is None:
        return found
    return found.withColumn("value", F.when(F.col("__far") <= limit, F.col("value"))).drop("__far")


def since(by: Sequence[str] = SERIES) -> Column:
    """How many places the last value of the series lies before a place, 0 at a value."""
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.col("pos") - F.last(F.when(F.col("value").isNotNull(), F.col("pos")), True).over(before)


def _along(full: DataFrame, by: Sequence[str], method: str) -> DataFrame:
    series = Window.partitionBy(*by)
    # both frames grow: one that runs to the series' end would be computed anew at each place
    left, right = (series.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("pos"), F.col("pos").desc()))
    known = F.when(F.col("value").isNotNull(), F.col("pos"))
    p0, v0 = F.last(known, True).over(left), F.last("value", True).over(left)
    p1, v1 = F.last(known, True).over(right), F.last("value", True).over(right)
    inside = p0.isNotNull() & p1.isNotNull()
    n0, n1 = F.last(F.when(F.col("value").isNotNull(), F.col(NODE)), True).over(left), F.last(F.when(F.col("value").isNotNull(), F.col(NODE)), True).over(right)
    filled = {
        "index": v0 + (v1 - v0) * F.try_divide(F.col(NODE) - n0, n1 - n0),
        "linear": v0 + (v1 - v0) * F.try_divide(F.col("pos") - p0, p1 - p0),
        "nearest": F.when(F.col("pos") - p0 <= p1 - F.col("pos"), v0).otherwise(v1),
        "ffill": v0,
        "bfill": v1,
    }
    method = {"slinear": "linear", "pad": "ffill", "zero": "ffill", "backfill": "bfill", "values": "index"}.get(method, method)
    if method not in filled:
        raise ValueError(f"unknown method {method}")
    return full.withColumn("value", F.coalesce("value", F.when(inside, filled[method])))


def _smooth(full: DataFrame, by: Sequence[str], method: str, order: int) -> DataFrame:
    """Filling by a curve: a series is one row while Python has it, so that a batch holds many series."""

    @F.pandas_udf("array<double>")
    def fill(pos: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([[None if np.isnan(x) else x for x in fill_smooth(np.asarray(p, float), np.array(v, float), method, order)] for p, v in zip(pos, value, strict=True)])

    rest = [c for c in full.columns if c not in (*by, "pos")]
    packed = full.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("__rows"))
    filled = packed.withColumn("__filled", fill(F.transform("__rows", lambda x: x["pos"]), F.transform("__rows", lambda x: x["value"])))
    each = filled.select(*by, F.explode(F.arrays_zip("__rows", "__filled")).alias("__x"))
    return each.select(*(F.col("__x.__filled").alias("value") if c == "value" else F.col(c) if c in by else F.col(f"__x.__rows.{c}") for c in full.columns))


def features_long(nodes: DataFrame, metrics: Sequence[str] | None = None, concat_sessions: bool = False, method: str = "linear", **options) -> DataFrame:
    """The gap-filled grid of a node table: one row per subject and feature."""
    long = melt(with_sessions(nodes, concat_sessions), metrics)
    return interpolate(grid(collapse(long), long), method, **options)


#: Aggregates that bundle_aggregate takes by name; medians are exact.
AGGREGATES: dict[str, Callable] = {
    "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
}


def bundle_aggregate(nodes: DataFrame, how="mean", metrics: Sequence[str] | None = None, concat_sessions: bool = False) -> DataFrame:
    """One value per (subject, tract, metric) over the raw nodes, without filling gaps.

    ``how``: a name of AGGREGATES, a function of a pandas series (run grouped, by Arrow), or a list of
    these, which adds a column ``agg``. Subjects without any value stay, with nulls.
    """
    long = melt(with_sessions(nodes, concat_sessions), metrics)
    if isinstance(how, (list, tuple)):
        parts = [bundle_aggregate(nodes, h, metrics, concat_sessions).withColumn("agg", F.lit(h if isinstance(h, str) else h.__name__)) for h in how]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if callable(how):

        @F.pandas_udf("double")
        def run(s: pd.Series) -> float:
            return float(how(s.dropna())) if s.notna().any() else float("nan")

        column = run(F.col("value"))
        return long.groupBy(*SERIES).agg(column.alias("value")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return long.groupBy(*SERIES).agg(AGGREGATES[how]("value").cast("double").alias("value"))


def bundle_table(nodes: DataFrame, hows: Sequence[str], metrics: Sequence[str] | None = None, concat_sessions: bool = False) -> DataFrame:
    """(subject, tract, metric) with a column for each named aggregate, in one pass over the raw nodes."""
    long = melt(with_sessions(nodes, concat_sessions), metrics)
    return long.groupBy(*SERIES).agg(*(AGGREGATES[h]("value").cast("double").alias(h) for h in hows))


def bundle_dim(aggregated: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, tractID, feature_idx) of aggregated bundles: metrics in the order given, tracts sorted."""
    order = F.array_position(F.array(*map(F.lit, metrics)), F.col("metric"))
    return aggregated.select("metric", TRACT).distinct().withColumn("feature_idx", F.row_number().over(Window.orderBy(order, TRACT)) - 1)


def bundle_means(features: DataFrame) -> DataFrame:
    """The mean of each subject's (metric, tract) over filled features; missing ones are skipped."""
    return features.groupBy(SUBJECT, "group_idx", "metric", TRACT).agg(F.avg("value").alias("value"))


def matrix(features: DataFrame, key: str = SUBJECT) -> DataFrame:
    """(subject, x): one array per subject, by feature index."""
    ordered = F.array_sort(F.collect_list(F.struct("feature_idx", "value")))
    return features.groupBy(key).agg(F.transform(ordered, lambda s: s["value"]).alias("x"))


def channels(features: DataFrame, n_nodes: int, n_channels: int, key: str = SUBJECT) -> DataFrame:
    """(key, channel, step, value): the flat feature index cut into channels of ``n_nodes`` steps."""
    top = features.agg(F.max("feature_idx")).first()[0]
    if top is not None and top + 1 != n_nodes * n_channels:
        raise ValueError(f"{top + 1} features are not {n_nodes} nodes times {n_channels} channels")
    return features.select(key, F.expr(f"feature_idx div {n_nodes}").cast("int").alias("channel"), (F.col("feature_idx") % n_nodes).cast("int").alias("step"), "value")


def tensors(matrices: DataFrame, n_nodes: int, n_channels: int, channels_last: bool = True, key: str = SUBJECT) -> DataFrame:
    """(key, x): nested arrays, steps by channels if ``channels_last``, else channels by steps."""
    if channels_last:
        rows = F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), lambda c: F.element_at("x", c * n_nodes + s + 1)))
    else:
        rows = F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), lambda c: F.slice("x", c * n_nodes + 1, n_nodes))
    return matrices.select(key, F.when(F.size("x") == n_nodes * n_channels, rows).otherwise(F.raise_error(F.lit("the arrays are not nodes times channels long"))).alias("x"))
