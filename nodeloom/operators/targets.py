"""Subject attributes: joined to the subjects of a feature table, and labels to codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.sources.tables import SUBJECT

#: The label of a missing label.
MISSING_LABEL = "NaN"


def check_targets(target_cols: Sequence[str] | None, encode_cols: Sequence[str] | None, unsupervised: bool) -> None:
    if unsupervised:
        return
    if not target_cols:
        raise ValueError("name the target columns, or ask for an unsupervised table")
    if extra := set(encode_cols or ()) - set(target_cols):
        raise ValueError(f"columns to encode that are no targets: {sorted(extra)}")


def join_targets(subjects: DataFrame, attributes: DataFrame, target_cols: Sequence[str], index_col: str = SUBJECT) -> DataFrame:
    """Every subject with its targets, null where the attributes lack it; attributes of other subjects go.

    Repeated ids among the attributes are an error, for they would repeat subjects.
    """
    wanted = attributes.select(F.col(index_col).alias(SUBJECT), *(F.col(f"`{c}`") for c in target_cols))
    twice = wanted.groupBy(SUBJECT).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} has several rows of attributes")
    return subjects.select(SUBJECT).distinct().join(wanted, SUBJECT, "left")


def classes(targets: DataFrame, column: str) -> DataFrame:
    """(label, code): the labels sorted as text, a missing one as ``NaN``; codes from 0."""
    label = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING_LABEL))
    return targets.select(label.alias("label")).distinct().withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)


def encode(targets: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``targets`` with a column ``<name>_code`` for each of ``columns``, and the classes of each."""
    found = {}
    for c in columns:
        found[c] = classes(targets, c)
        of = found[c].select(F.col("label").alias("__label"), F.col("code").alias(f"{c}_code"))
        label = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING_LABEL))
        targets = targets.withColumn("__label", label).join(of, "__label").drop("__label")
    return targets, found


def drop_missing(targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have all of ``columns``: not null, not NaN, and no label that stands for missing."""
    kinds = dict(targets.dtypes)
    keep = F.lit(True)
    for c in columns:
        column = F.col(f"`{c}`")
        keep &= column.isNotNull()
        if kinds[c] in ("double", "float"):
            keep &= ~F.isnan(column)
        if kinds[c] == "string":
            keep &= column != MISSING_LABEL
    return targets.where(keep)
