"""Folders for what a query writes on its way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is already gone; the folder is the cluster's scratch space
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors can both write: under ``spark.checkpoint.dir``, or, on one machine, a temporary one.

    It is deleted when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(named or tempfile.gettempdir()).rstrip('/')}/nodeloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path
