"""The nearest rows of each row that lacks values, over few features: an exact search in boxes of space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Features, and pairs of known features of two sides, up to which rows are sought in boxes.
FEW_FEATURES, FEW_SEARCHES = 8, 64
#: Offers that are looked at to place the borders of one box, and in all; every offer is searched, whatever the borders.
SAMPLED, SAMPLED_IN_ALL = 16, 200_000
#: Distances in memory at once, and askers of one box in one task.
AT_ONCE, ASKERS = 2_000_000, 50_000


@dataclass
class Tree:
    """Space halved again and again; an inner node has a feature and a cut, a leaf the number of its box."""

    feature: np.ndarray
    cut: np.ndarray
    after: np.ndarray  # the node for values up to the cut; the next one is for those above
    box: np.ndarray

    @classmethod
    def grown(cls, x: np.ndarray, boxes: int) -> Tree:
        """About ``boxes`` leaves with equal shares of the rows of ``x``."""
        nodes, waiting, boxed = [[-1, 0.0, -1, -1]], [(0, np.arange(len(x)), boxes)], 0
        while waiting:
            at, rows, share = waiting.pop()
            part = x[rows]
            wide = np.ptp(part, axis=0) if len(rows) else np.zeros(x.shape[1])
            f = int(wide.argmax())
            if share <= 1 or wide[f] <= 0:
                nodes[at][3], boxed = boxed, boxed + 1
                continue
            values = np.sort(part[:, f])
            cut = values[(len(values) - 1) // 2]
            cut = cut if cut < values[-1] else values[values < values[-1]][-1]
            low = part[:, f] <= cut
            nodes[at][:3] = f, cut, len(nodes)
            waiting += [(len(nodes), rows[low], share / 2), (len(nodes) + 1, rows[~low], share / 2)]
            nodes += [[-1, 0.0, -1, -1], [-1, 0.0, -1, -1]]
        feature, cut, after, box = zip(*nodes, strict=True)
        return cls(np.array(feature), np.array(cut, float), np.array(after), np.array(box))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The box of each row."""
        node = np.zeros(len(x), int)
        while len(inner := np.flatnonzero(self.feature[node] >= 0)):
            at = node[inner]
            node[inner] = self.after[at] + (x[inner, self.feature[at]] > self.cut[at])
        return self.box[node]


def closest(z: np.ndarray, y: np.ndarray, scale: float, shared: int, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of z, row of y, distance): the ``k`` rows of y nearest to each of z and within its limit; of equal distances the first."""
    found = []
    for start in range(0, len(z), step := max(1, AT_ONCE // max(1, len(y)))):
        part = z[start : start + step]
        square = np.zeros((len(part), len(y)))
        for j in range(z.shape[1]):
            square += (y[None, :, j] - part[:, None, j]) ** 2
        distance = square * scale / shared
        near = distance <= limit[start : start + step, None]
        if len(y) > k:
            near &= distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
        a, b = np.nonzero(near)
        d = distance[a, b]
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        found.append((a[rank < k] + start, b[rank < k], d[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def searches(asking: dict[int, int], offering: dict[int, int]) -> list[tuple[int, int]]:
    """(features known to the offer, those it shares with the asker), as bits, wherever it has one the asker lacks."""
    return sorted({(o, s & o) for s in asking for o in offering if s & o and o & ~s})


def found_in_boxes(seekers: DataFrame, offered: DataFrame, key: str, k: int, p: int, pairs: list[tuple[int, int]], rows: int) -> DataFrame:
    """(key, place, fill) for each seeker and feature that it lacks: the mean over the ``k`` nearest offers that have it.

    Both tables have (key, known, x0, x1, ...), the features as columns and as bits which are known. For each
    of ``pairs`` offers are points in the space of what is shared. Equal points are one, with its ``k`` + 1
    smallest keys (one of which may be the seeker itself). Space is cut into boxes of about ``rows`` offers.
    A point first looks into the box that surely is near; the distance found there bounds which others can
    hold nearer offers, and only these are looked at. The borders of boxes come from a part of the offers;
    what is found does not depend on them.
    """
    kind = dict(seekers.dtypes)[key]
    xs, zs = [f"x{j}" for j in range(p)], [f"z{j}" for j in range(p)]
    shared = [bin(d).count("1") for _, d in pairs]
    spark = seekers.sparkSession

    def into(df: DataFrame, which) -> DataFrame:
        """Rows once for each search they take part in, their place in its space in z."""
        parts = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(o).alias("o"), F.lit(d).alias("d")) for s, (o, d) in enumerate(pairs)))
        each = df.withColumn("__p", F.explode(F.filter(parts, which)))
        return each.select("*", F.col("__p.s").alias("s"), *(F.when(F.col("__p.d").bitwiseAND(1 << j) != 0, F.col(f"x{j}")).otherwise(0.0).alias(f"z{j}") for j in range(p))).drop("__p")

    asks = into(seekers.select(key, "known", *xs), lambda t: (F.col("known").bitwiseAND(t["o"]) == t["d"]) & (t["o"].bitwiseAND(F.bitwise_not(F.col("known"))) != 0))
    equal = Window.partitionBy("s", *zs).orderBy(key)
    offers = into(offered.select(key, "known", *xs), lambda t: F.col("known") == t["o"]).withColumn("__r", F.row_number().over(equal)).where(F.col("__r") <= k + 1).drop("__r", "known").persist()
    counts = {r["s"]: r["n"] for r in offers.groupBy("s").agg(F.count("*").alias("n")).collect()}
    share = min(1.0, SAMPLED_IN_ALL / max(1, sum(counts.values())), max(SAMPLED / rows, 4_096 / max(1, max(counts.values(), default=1))))
    seen = offers.select("s", *zs).where(F.pmod(F.xxhash64("s", *zs), F.lit(1_000_003)) < share * 1_000_003).toPandas()
    trees = spark.sparkContext.broadcast({s: Tree.grown(seen.loc[seen["s"] == s, zs].to_numpy(float), -(-counts[s] // rows)) for s in counts})

    @F.pandas_udf("int")
    def placed(s: pd.Series, *z: pd.Series) -> pd.Series:
        points, out = np.column_stack([c.to_numpy(float) for c in z]), np.zeros(len(s), np.int32)
        for one in s.unique():
            mine = (s == one).to_numpy()
            out[mine] = trees.value[one].place(points[mine])
        return pd.Series(out)

    offers = offers.withColumn("box", placed("s", *zs)).persist()
    bounds = offers.groupBy("s", "box").agg(F.count("*").alias("n"), *(F.min(c).alias(f"low_{c}") for c in zs), *(F.max(c).alias(f"high_{c}") for c in zs)).toPandas().sort_values(["s", "box"])
    boxes = spark.sparkContext.broadcast({s: (b["box"].to_numpy(), b["n"].to_numpy(), b[[f"low_{c}" for c in zs]].to_numpy(float), b[[f"high_{c}" for c in zs]].to_numpy(float)) for s, b in bounds.groupby("s")})

    def first_boxes(batches):
        for pdf in batches:
            out = np.zeros(len(pdf), np.int32)
            for s, mine in pdf.groupby("s").indices.items():
                z, (names, n, low, high) = pdf[zs].to_numpy(float)[mine], boxes.value[s]
                for start in range(0, len(z), step := max(1, AT_ONCE // len(names))):
                    part, far = z[start : start + step], 0.0
                    for j in range(p):
                        far = far + np.maximum(np.abs(part[:, None, j] - low[None, :, j]), np.abs(part[:, None, j] - high[None, :, j])) ** 2
                    out[mine[start : start + step]] = names[np.where(n > k, far, far + far.max() + 1).argmin(1)]
            yield pdf.assign(box=out, reach=np.inf)

    def other_boxes(batches):
        for pdf in batches:
            for s, mine in pdf.groupby("s").indices.items():
                part = pdf.iloc[mine]
                z, (names, _, low, high), reach, own = part[zs].to_numpy(float), boxes.value[s], part["reach"].to_numpy(), part["box"].to_numpy()
                for start in range(0, len(z), step := max(1, AT_ONCE // len(names))):
                    here, gap = z[start : start + step], 0.0
                    for j in range(p):
                        gap = gap + np.maximum(0.0, np.maximum(low[None, :, j] - here[:, None, j], here[:, None, j] - high[None, :, j])) ** 2
                    a, b = np.nonzero((gap * p / shared[s] * (1 - 1e-9) <= reach[start : start + step, None]) & (names[None, :] != own[start : start + step, None]))
                    yield part.iloc[a + start].assign(box=names[b])[["s", *zs, "box", "reach"]]

    points = f"s int, {', '.join(f'{z} double' for z in zs)}"

    def looked_into(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(key)
        s = int(a["s"].iloc[0]) if len(a) else 0
        q, o, d = closest(a[zs].to_numpy(float), b[zs].to_numpy(float), p, shared[s], a["reach"].to_numpy(float), k + 1)
        ends, keys, values = np.searchsorted(q, np.arange(len(a) + 1)), b[key].to_numpy()[o], b[xs].to_numpy(float)[o]
        pieces = list(zip(ends, ends[1:], strict=False))
        lists = {"ds": [d[i:j] for i, j in pieces], "bs": [keys[i:j] for i, j in pieces], "ys": [values[i:j].reshape(-1) for i, j in pieces]}
        return a[["s", *zs, "box"]].assign(reach=[d[j - 1] if j - i > k else np.inf for i, j in pieces], **lists)

    def visited(asked: DataFrame) -> DataFrame:
        asked = asked.persist()
        many = F.broadcast(asked.groupBy("s", "box").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("parts")))
        a = asked.join(many, ["s", "box"]).withColumn("part", F.pmod(F.xxhash64(*zs), F.col("parts")).cast("int")).drop("parts")
        b = offers.join(many, ["s", "box"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        group = ["s", "box", "part"]
        return a.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(lambda a, b: looked_into(a, b), f"{points}, box int, reach double, ds array<double>, bs array<{kind}>, ys array<double>")

    known = spark.createDataFrame([(s,) for s in counts], "s int")
    first = visited(asks.join(F.broadcast(known), "s").select("s", *zs).distinct().mapInPandas(first_boxes, f"{points}, box int, reach double")).persist()
    more = visited(first.select("s", *zs, "box", "reach").mapInPandas(other_boxes, f"{points}, box int, reach double"))
    value = lambda i: F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.get("ys", i * p + j))
    listed = first.unionByName(more).where(F.size("ds") > 0).select("s", *zs, F.transform("ds", lambda d, i: F.struct(d.alias("d"), F.get("bs", i).alias("b"), value(i).alias("y"))).alias("o"))
    answers = listed.groupBy("s", *zs).agg(F.slice(F.array_sort(F.flatten(F.collect_list("o"))), 1, k + 1).alias("o"))
    whole = asks.join(answers.hint("merge"), ["s", *zs]).groupBy(key).agg(F.first("known").alias("known"), F.array_sort(F.flatten(F.collect_list("o"))).alias("o"))

    def mean(j: int):
        best = F.slice(F.filter("o", lambda t: F.get(t["y"], F.lit(j)).isNotNull() & ~F.isnan(F.get(t["y"], F.lit(j))) & (t["b"] != F.col(key))), 1, k)
        total = F.aggregate(best, F.lit(0.0), lambda a, t: a + F.get(t["y"], F.lit(j)))
        return F.when((F.col("known").bitwiseAND(1 << j) == 0) & (F.size(best) > 0), total / F.size(best))

    fills = F.array(*(F.struct(F.lit(j).alias("place"), mean(j).alias("fill")) for j in range(p)))
    return whole.select(key, F.explode(fills).alias("f")).select(key, "f.*").where("fill is not null")
