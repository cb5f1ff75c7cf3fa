"""Places of rows in an order, counted by all workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket, the rows that one task sorts, and how many buckets there are at most.
BUCKET_ROWS, BUCKETS = 50_000, 512
#: Keys that are looked at to place the border of one bucket; every row is counted, whatever the borders.
SAMPLED = 64


def _between(column: Column, borders: list, first: int = 0) -> Column:
    """How many of the sorted ``borders`` lie at or below a value, by halving."""
    if not borders:
        return F.lit(first)
    middle = len(borders) // 2
    return F.when(column < F.lit(borders[middle]), _between(column, borders[:middle], first)).otherwise(_between(column, borders[middle + 1 :], first + middle + 1))


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), place: str = "__i", total: str = "__n", rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``place``, from 0, of each row by ``order`` within ``by``, and the ``total`` of rows there.

    Rows are dealt into buckets by borders of the first column of ``order``, ranked there, and what
    stands in the buckets before is added. Rows with a null there come first, as in any ascending order.
    """
    first = F.col(order[0])
    n = df.count()
    buckets, borders = min(BUCKETS, -(-n // rows)), []
    if buckets > 1:
        share = min(1.0, buckets * SAMPLED / n)
        keys = df.select(first.alias("k")).where(F.col("k").isNotNull() & (F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < share * 1_000_003)).orderBy("k")
        seen = [r[0] for r in keys.collect()]
        borders = sorted({seen[len(seen) * i // buckets] for i in range(1, buckets)}) if seen else []
    placed = df.withColumn("__bucket", F.when(first.isNull(), 0).otherwise(_between(first, borders)).cast("int"))
    counts = placed.groupBy(*by, "__bucket").agg(F.count("*").alias("__here"))
    within = Window.partitionBy(*by)
    counts = counts.withColumn("__before", F.sum("__here").over(within.orderBy("__bucket")) - F.col("__here")).withColumn(total, F.sum("__here").over(within)).drop("__here")
    keys = [*by, "__bucket"]
    ranked = placed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = F.lit(True)
    for c in keys:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = ranked.alias("a").join(F.broadcast(counts).alias("b"), same)
    return both.select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("__r") + F.col("__before")).cast("long").alias(place), F.col(f"b.{total}").alias(total))
