"""Readers for node tables (long) and subject tables, with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBJECT, TRACT, NODE, SESSION = "subjectID", "tractID", "nodeID", "sessionID"
KEYS = (SUBJECT, TRACT, NODE)

#: What counts as a missing number or label in text files.
MISSING = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def header(spark: SparkSession, path: str) -> str:
    """The first line of a text file, or of the first of the files of a folder."""
    rows = spark.read.text(path).limit(1).collect()
    if not rows:
        raise ValueError(f"{path} is empty")
    return rows[0][0].lstrip("﻿")


def sniff(line: str) -> str:
    """The delimiter of a header line: the commonest of tab, comma, semicolon and bar outside quotes."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max("\t,;|", key=lambda d: (bare.count(d), d == ","))


def _names(line: str, sep: str) -> list[str]:
    return [n.strip().strip('"') for n in line.split(sep)]


def _index_like(name: str) -> bool:
    return name == "" or name.startswith("Unnamed:")


def _read(spark: SparkSession, path: str, sep: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=True, mode="PERMISSIVE")
    return raw.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names) if not _index_like(n)))


def number(column) -> F.Column:
    """A text column as doubles; missing tokens and NaN become null."""
    value = F.when(~F.trim(column).isin(*MISSING), F.trim(column)).try_cast("double")
    return F.when(~F.isnan(value), value)


def read_nodes(spark: SparkSession, path: str, metrics: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A node table: subject and tract ids as text, node as int, session as text if there, metrics as doubles.

    Columns without a name are dropped. ``metrics`` limits the metrics to those named; the others are
    pruned in the scan.
    """
    names = _names(header(spark, path), sep)
    if missing := [k for k in KEYS if k not in names]:
        raise ValueError(f"the node table lacks {missing}")
    raw = _read(spark, path, sep, names)
    found = [n for n in raw.columns if n not in (*KEYS, SESSION)]
    if metrics is not None and (unknown := set(metrics) - set(found)):
        raise ValueError(f"the node table lacks the metrics {sorted(unknown)}")
    keys = [F.coalesce(F.col(SUBJECT), F.lit("")).alias(SUBJECT), F.coalesce(F.col(TRACT), F.lit("")).alias(TRACT), F.col(NODE).cast("int").alias(NODE)]
    session = [F.col(SESSION)] if SESSION in raw.columns else []
    return raw.select(*keys, *session, *(number(F.col(f"`{m}`")).alias(m) for m in (metrics or found)))


def read_subjects(spark: SparkSession, path: str, index_col: str = SUBJECT, sep: str | None = None) -> DataFrame:
    """A subject table: the delimiter is found in the header, the id is text, a column of numbers is double.

    A column is one of numbers if every value that is not missing reads as a number; that is decided
    over the whole table.
    """
    line = header(spark, path)
    sep = sep or sniff(line)
    raw = _read(spark, path, sep, _names(line, sep))
    if index_col not in raw.columns:
        raise ValueError(f"the subject table lacks {index_col}")
    others = [c for c in raw.columns if c != index_col]
    text = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")) for c in others}
    odd = raw.agg(*(F.sum((text[c].isNotNull() & text[c].try_cast("double").isNull()).cast("int")).alias(f"o{i}") for i, c in enumerate(others))).first() if others else ()
    return raw.select(F.col(index_col), *((number(F.col(f"`{c}`")) if not odd[i] else text[c]).alias(c) for i, c in enumerate(others)))
