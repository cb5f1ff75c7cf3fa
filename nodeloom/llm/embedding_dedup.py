"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors a cosine of at least c means a squared distance of at most 2 (1 - c). Vectors are
rotated by a fixed random orthogonal matrix, which spreads every difference over all coordinates,
and cut into blocks of ``BLOCK`` of them. The squared distance is the sum over the blocks, so in at
least one block it is within that block's proportional share of the budget. Each block is joined
by range: cells as wide as the share's root along the block's first coordinate, each vector
compared with its own cell and the one before. Pairs within the share of a block, and of no earlier
one, are verified with the cosine of the original vectors in double precision, so every link is
found once and none is missed.

Equal vectors of a label are one node with a multiplicity. Cells with over ``CHUNK`` vectors are cut
into pieces that meet two by two in tasks of their own. A task returns, for its pairs, a sum of links
per vector and a spanning forest, never the pairs.

Defined cases: null labels, null, empty or zero vectors and vectors with null or non-finite components
link with nothing and are their own component; vectors of different lengths never link; a row is a
vector, so repeated rows link with each other; a null id is never the smallest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm._common import quoted, stored
from nodeloom.llm.components import connected_components
from nodeloom.llm.simhash import Labels

BLOCK, CHUNK = 8, 4_096
#: Room for rounding when a block's distance is compared with its share; verification is exact.
SLACK = 1e-9
_ROWS, _PAIRS = 1_024, 200_000


@lru_cache(maxsize=64)
def rotation(dimensions: int) -> np.ndarray:
    """The fixed random orthogonal matrix for vectors of this length."""
    q, r = np.linalg.qr(np.random.default_rng(dimensions).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def edges_of(dimensions: int) -> list[int]:
    """Where the blocks begin, with the end of the last."""
    return [*range(0, dimensions, BLOCK), dimensions]


def rotated(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    return unit @ rotation(vectors.shape[1])


def shares(dimensions: int, cosine: float) -> np.ndarray:
    """Each block's part of the squared-distance budget, by its number of coordinates."""
    return 2 * (1 - cosine) * np.diff(edges_of(dimensions)) / dimensions


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def links(vectors: np.ndarray, block: int, cosine: float, left: np.ndarray, right: np.ndarray, triangle: bool):
    """Batches of (a, b): pairs of rows that link, and whose first block within its share is this one.

    ``triangle``: left and right are the same rows, and each pair is wanted once.
    """
    turned = rotated(vectors)
    edges, share = edges_of(vectors.shape[1]), shares(vectors.shape[1], cosine)
    norms = [(turned[:, a:b] ** 2).sum(1) for a, b in zip(edges, edges[1:], strict=False)]

    def distances(k: int, rows: np.ndarray) -> np.ndarray:
        a, b = edges[k], edges[k + 1]
        return norms[k][rows][:, None] + norms[k][right][None, :] - 2 * (turned[rows, a:b] @ turned[right, a:b].T)

    for i in range(0, len(left), _ROWS):
        rows = left[i : i + _ROWS]
        near = distances(block, rows) <= share[block] + SLACK
        if triangle:
            near &= np.arange(len(right))[None, :] > np.arange(i, i + len(rows))[:, None]
        for k in range(block):
            if near.any():  # pairs surely within an earlier share were found there
                near &= distances(k, rows) > share[k] - SLACK
        x, y = np.nonzero(near)
        for j in range(0, len(x), _PAIRS):
            a, b = rows[x[j : j + _PAIRS]], right[y[j : j + _PAIRS]]
            good = cosines(vectors[a], vectors[b]) >= cosine
            a, b = a[good], b[good]
            apart = np.stack([((turned[a, s:e] - turned[b, s:e]) ** 2).sum(1) for s, e in zip(edges, edges[1:], strict=False)], 1)
            within = apart <= share * (1 + SLACK) + 1e-14
            within[~within.any(1), apart.shape[1] - 1] = True  # rounding at the very edge of the budget
            first = within.argmax(1) == block
            yield a[first], b[first]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``."""
    vector = F.col(quoted(vector_col))
    single = df.schema[vector_col].dataType.elementType == T.FloatType()
    vector = vector if single else vector.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label"), vector.alias("v"))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fit, F.col("v"))).withColumn("hash", F.xxhash64("label", "v"))
    grouped = rows.where("v is not null").groupBy("hash", "label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")
    dtype = "<f4" if single else "<f8"

    def cells(batches):
        for batch in batches:
            arrays = [np.asarray(x.values, dtype) for x in batch.column(2)]
            found = []
            for x in arrays:
                turned = rotated(x[None, :].astype(float))[0]
                found.append(np.floor(turned[edges_of(len(x))[:-1]] / (np.sqrt(shares(len(x), cosine)) + 1e-6)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([x.tobytes() for x in arrays], pa.binary()), pa.array([len(x) for x in arrays], pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["node", "label", "n", "v", "dims", "cells"])

    schema = T.StructType([nodes.schema["node"], nodes.schema["label"], nodes.schema["n"], T.StructField("v", T.BinaryType()), T.StructField("dims", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    celled = nodes.select("node", "label", "v", "n").mapInArrow(cells, schema)
    spread = celled.select("node", "n", "v", "label", "dims", F.posexplode("cells").alias("block", "own"))
    spread = spread.select("*", F.explode(F.array(F.struct(F.col("own").alias("cell"), F.lit(False).alias("guest")), F.struct((F.col("own") + 1).alias("cell"), F.lit(True).alias("guest")))).alias("x"))
    spread = spread.select("node", "n", "v", "label", "dims", "block", "x.cell", "x.guest")
    key = ["label", "dims", "block", "cell"]
    pieces = lambda guest: F.ceil(F.count(F.when(F.col("guest") == guest, 1)) / chunk).cast("int")
    sizes = spread.groupBy(key).agg(pieces(False).alias("homes"), pieces(True).alias("guests")).where("homes > 0")
    task = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    me = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    whole = (F.col("homes") == 1) & (F.col("guests") <= 1)
    home = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda x: task(F.least(x, F.col("me")), F.greatest(x, F.col("me")), F.when(x == F.col("me"), 0).when(F.col("me") < x, 1).otherwise(2)))
    to_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("guests") - 1, F.lit(0))), lambda g: task(F.col("me"), -1 - g, F.lit(2)))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
    to_homes = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda x: task(x, -1 - F.col("me"), F.lit(1)))
    tasks = F.when(whole, F.array(task(F.lit(0), F.lit(0), F.col("guest").cast("int")))).when(F.col("guest"), to_homes).otherwise(F.concat(home, to_guests))
    dealt = spread.join(sizes, key).withColumn("me", me).select(*key, "node", "n", "v", F.explode(tasks).alias("t")).select(*key, "t.i", "t.j", "t.role", "node", "n", "v")
    group = [*key, "i", "j"]
    ordered = dealt.repartition(*group).sortWithinPartitions(*group, "role", "node")
    width = len(group)

    def compare(batches):
        for table in groups(batches, width):
            role, node = table.column("role").to_numpy(), table.column("node").to_numpy()
            many = table.column("n").to_numpy().astype(float)
            vectors = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype).astype(float).reshape(len(node), -1)
            block = table.column("block")[0].as_py()
            zero, one, homes = np.flatnonzero(role == 0), np.flatnonzero(role == 1), np.flatnonzero(role != 1)
            labels, linked = Labels(len(node)), np.zeros(len(node))
            for left, right, triangle in ((zero, zero, True), (one, homes, False)):
                if len(left) and len(right):
                    for a, b in links(vectors, block, cosine, left, right, triangle):
                        linked += np.bincount(a, many[b], len(node)) + np.bincount(b, many[a], len(node))
                        labels.join(a, b)
            hit = np.flatnonzero(linked)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[labels.of[hit]]), pa.array(linked[hit].astype(np.int64))], names=["node", "other", "links"])

    found = stored(ordered.mapInArrow(compare, "node long, other long, links long"), "vector-links")
    links_of = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> other"), "node", "other")
    of = nodes.select("hash", "label", "v", "node", "n", "first").join(links_of, "node", "left").join(roots, "node", "left")
    of = of.withColumn("root", F.coalesce("root", "node"))
    smallest = of.groupBy("root").agg(F.min("first").alias("component"))
    of = of.join(smallest, "root").select("hash", F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    out = rows.join(of.withColumnRenamed("hash", "h"), (F.col("hash") == F.col("h")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("w").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def groups(batches, width: int):
    """Tables of rows that agree in the first ``width`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for i in range(width):
            column = batch.column(i)
            new[1:] |= ~np.asarray(pa.compute.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False), bool)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            mine = tuple(batch.column(i)[a].as_py() for i in range(width))
            if held and mine != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
