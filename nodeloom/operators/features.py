"""Names, order and grouping of features and of coefficients that belong to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.sources.tables import NODE, TRACT

# The usual order of tracts, with their short codes.
TRACT_CODES = {
    "Left Arcuate": "ARC_L",
    "Left SLF": "SLF_L",
    "Left Uncinate": "UNC_L",
    "Left ILF": "ILF_L",
    "Left IFOF": "IFO_L",
    "Left Cingulum Hippocampus": "HCC_L",
    "Left Thalamic Radiation": "ATR_L",
    "Left Corticospinal": "CST_L",
    "Left Cingulum Cingulate": "CGC_L",
    "Callosum Forceps Minor": "FA",
    "Callosum Forceps Major": "FP",
    "Right Cingulum Cingulate": "CGC_R",
    "Right Corticospinal": "CST_R",
    "Right Thalamic Radiation": "ATR_R",
    "Right Cingulum Hippocampus": "HCC_R",
    "Right IFOF": "IFO_R",
    "Right ILF": "ILF_R",
    "Right Uncinate": "UNC_R",
    "Right SLF": "SLF_R",
    "Right Arcuate": "ARC_R",
}
TRACTS = tuple(TRACT_CODES)


def short_names(df: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """Tracts by their short code, whether their names are written with blanks or without; unknown ones stay."""
    codes = TRACT_CODES if codes is None else codes
    known = F.create_map(*(F.lit(x) for name, code in codes.items() for x in (name.replace(" ", ""), code)))
    return df.withColumn(TRACT, F.coalesce(F.try_element_at(known, F.replace(F.col(TRACT), F.lit(" "), F.lit(""))), F.col(TRACT)))


def without_side(tract: Column) -> Column:
    """The tract's name without Left or Right."""
    return F.trim(F.replace(F.replace(tract, F.lit("Left"), F.lit("")), F.lit("Right"), F.lit("")))


def label_sets(features: DataFrame, symmetric: bool = True) -> DataFrame:
    """Adds ``labels``: metric, tract, node as text and, if ``symmetric``, the tract without its side, each once."""
    parts = [F.col("metric"), F.col(TRACT), F.col(NODE).cast("string")]
    return features.withColumn("labels", F.array_distinct(F.array(*parts, *[without_side(F.col(TRACT))] * symmetric)))


def label_records(features: DataFrame, symmetric: bool = True) -> DataFrame:
    """Adds ``record``: the same as a struct of texts by name."""
    extra = [without_side(F.col(TRACT)).alias("symmetrized_tractID")] * symmetric
    return features.withColumn("record", F.struct("metric", TRACT, F.col(NODE).cast("string").alias(NODE), *extra))


def select_groups(features: DataFrame, *labels: str) -> DataFrame:
    """Features whose (metric, tract) has all of ``labels``."""
    keep = F.lit(True)
    for label in labels:
        keep &= (F.col("metric") == label) | (F.col(TRACT) == label)
    return features.where(keep)


def select_like(features: DataFrame, *parts: str) -> DataFrame:
    """Features whose names contain all of ``parts``."""
    name = F.concat_ws("|", "metric", TRACT, F.col(NODE).cast("string"))
    keep = F.lit(True)
    for part in parts:
        keep &= name.contains(part)
    return features.where(keep)


def group_names(features: DataFrame) -> DataFrame:
    """(group_idx, metric, tractID): each group once, in the order of its first feature."""
    return features.groupBy("metric", TRACT).agg(F.min("feature_idx").alias("first")).select(F.expr("row_number() over (order by first) - 1").alias("group_idx"), "metric", TRACT)


def sort_features(features: DataFrame, score: str = "score", index: str = "feature_idx") -> DataFrame:
    """Adds ``place`` from 0: by falling size of the score, of equals the earlier feature first."""
    return features.withColumn("place", F.expr(f"row_number() over (order by abs({score}) desc, {index}) - 1"))


def coefficients_by_group(coefficients: DataFrame, drop_zeros: bool = False) -> DataFrame:
    """(tractID, metric, beta): the coefficients of each tract and metric as an array along its nodes.

    ``drop_zeros`` leaves out tracts all of whose coefficients are zero, and then such metrics of the others.
    """
    blocks = coefficients.groupBy(TRACT, "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "beta"))), lambda s: s["beta"]).alias("beta"), F.max(F.abs("beta")).alias("top"))
    return (blocks.where("top > 0") if drop_zeros else blocks).drop("top")


def coefficients_by_metric(coefficients: DataFrame, tracts: Sequence[str] | None = None) -> DataFrame:
    """(metric, beta): the coefficients of each metric over all tracts, in the order given, else the usual one, then by name."""
    order = list(tracts) if tracts is not None else list(TRACTS)
    place = F.array_position(F.array(*map(F.lit, order)), F.col(TRACT))
    known = coefficients.withColumn("__at", F.when(place > 0, place).otherwise(len(order) + 1))
    if tracts is not None:
        known = known.where(F.col("__at") <= len(order))
    return known.groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", TRACT, "pos", "beta"))), lambda s: s["beta"]).alias("beta"))


def mean_size(coefficients: DataFrame) -> DataFrame:
    """(feature_idx, score): the mean size of a feature's coefficient over folds."""
    return coefficients.groupBy("feature_idx").agg(F.avg(F.abs("beta")).alias("score"))
