"""Running means of bundles over a stream of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.sources.tables import SUBJECT, TRACT


def running_means(nodes: DataFrame, metric: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, subjectID, tractID, mean, n) by tumbling window; rows later than ``late`` behind the newest are dropped."""
    timed = nodes.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    grouped = timed.where(F.col(metric).isNotNull()).groupBy(F.window("__t", window), SUBJECT, TRACT)
    return grouped.agg(F.avg(metric).alias("mean"), F.count(metric).alias("n")).select(F.col("window.start").alias("start"), SUBJECT, TRACT, "mean", "n")
