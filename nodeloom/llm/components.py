"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step lets every node point its neighbours at the smallest node it knows; the links become
stars within a number of rounds logarithmic in the size of the largest component. Minima are
pre-aggregated before the shuffle, links never reach the driver, and each round is written to
the shared folder, so a lost executor costs no more than the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm._common import Stored


def _sign(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another one; ``root`` is the smallest node of its component.

    Null ends and self-links are ignored; repeated links count once; no links give an empty table.
    """
    u, v = F.col("u"), F.col("v")
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    links = links.where("x is not null and y is not null and u <> v").select("u", "v").distinct()
    at = Stored(links, "links")
    sign = _sign(at.read())
    while sign[0]:
        links = at.read()
        both = links.unionByName(links.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        following = Stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        at.drop()
        at, before = following, sign
        if (sign := _sign(at.read())) == before:
            break
    stars = at.read()
    return stars.select(u.alias("node"), v.alias("root")).unionByName(stars.select(v.alias("node"), v.alias("root")).distinct())
