"""SimHash near-duplicates, compared in bit slices.

Fingerprint: words of the ASCII-lower-cased text, shingles of ``width`` words with repeats, XXH64
(seed 42) of each; a bit is set if over half of the hashes have it. Equal fingerprints are one node,
so copies never meet again.

Candidates: with 64 bits cut into radius + 2 bands, fingerprints that differ in at most ``radius``
bits agree in two bands at least, so they share one of the (radius + 2 choose 2) keys made of two
bands. A key held by over ``SPLIT`` fingerprints is refined by the same rule on its remaining bits;
for radius 2 what is then equal leaves 16 free bits, so a group never exceeds 65,536 fingerprints
however many documents there are.

Comparison: within a group bits are stored in vertical planes, one word holding one bit of 64
distances; carry-save counters add the differing bits plane by plane, and a block of comparisons is
abandoned once all its counters exceed the radius. A group yields a spanning forest of its links,
not its pairs; components are then found on the forests.

Defined cases: texts without words, null ones included, have fingerprint zero and link like any
other; a text with fewer words than a shingle is one shingle; repeated rows and equal doc_ids each
get a row; a null doc_id is never the smallest.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm._common import append_columns, fresh, quoted, stored
from nodeloom.llm.components import connected_components

SEED = 42
#: A key with more fingerprints than this is refined by its remaining bits.
SPLIT = 4_096
#: Groups up to this size are compared many at a time; larger ones by blocks of queries.
SMALL, QUERIES = 64, 128
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str, width: int) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(text: str, width: int) -> int:
    """The 64-bit fingerprint, unsigned."""
    from xxhash import xxh64_intdigest

    found = shingles(text, width)
    if not found:
        return 0
    hashes = np.fromiter(map(xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found)).view(np.uint8).reshape(-1, 8)
    bits = [np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)]
    return int.from_bytes(np.packbits(np.concatenate(bits) * 2 > len(found), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text_col: str = "text", width: int = 3, name: str = "fingerprint", keep=None) -> DataFrame:
    """``df`` with the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return append_columns(df, text_col, [(name, T.LongType())], make, keep)


def planes(values: np.ndarray, bits: int = 64) -> np.ndarray:
    """Bit planes of 64-bit values: row j holds bit j of all values, 64 to a word, zero-filled."""
    filled = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    filled[: len(values)] = values
    flat = np.unpackbits(filled.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little").view(np.uint64)[:bits]


def within(differ, shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Mask of the positions that differ in at most ``radius`` planes.

    ``differ(j)`` gives plane j of the differences. Counters are carry-save: digit k of all counts is
    one array of words. Every eighth plane the block is abandoned if no count is within the radius.
    """
    digits = [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(shape, np.uint64)
    for j in range(64):
        carry = differ(j)
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        reached = carry
        full = None
        for k, digit in enumerate(digits):
            part = digit if (radius + 1) >> k & 1 else ~digit
            full = part if full is None else full & part
        over |= reached | full
        if j % 8 == 7 and not (~over).any():
            break
    return ~over


def bit_positions(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Indices of the set bits of words, the last axis running over bits."""
    return np.nonzero(np.unpackbits(mask.view(np.uint8), axis=-1, bitorder="little"))


class Labels:
    """Component labels of n items, joined by batches of links."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.of[a], self.of[b]
        new = a != b
        if not new.any():
            return
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1)[new], axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            to = np.arange(len(self.of))
            for x in parent:
                to[x] = root(x)
            self.of = to[self.of]


def every_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.ones(len(a), bool)


def link_small(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: Labels, radius: int, accept=every_pair) -> None:
    """Links within many groups at once: all distances of items d apart, for each d."""
    end = np.repeat(starts + sizes, sizes)
    place = np.repeat(starts, sizes) + np.arange(len(end)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for d in range(1, int(sizes.max())):
        place, end = place[place + d < end], end[place + d < end]
        for i in range(0, len(place), 1 << 18):
            first = place[i : i + (1 << 18)]
            differ = planes(values[first] ^ values[first + d])
            (hit,) = bit_positions(within(differ.__getitem__, differ.shape[1:], radius))
            a = first[hit[hit < len(first)]]
            a = a[accept(a, a + d)]
            labels.join(a, a + d)


def link_large(values: np.ndarray, start: int, size: int, labels: Labels, radius: int, accept=every_pair) -> None:
    """Links within one group: blocks of queries against vertical planes of the items from there on."""
    group = values[start : start + size]
    for i in range(0, size, QUERIES):
        queries = group[i : i + QUERIES]
        for k in range(i // 64 * 64, size, 1 << 14):
            stored_planes = planes(group[k : k + (1 << 14)])
            signs = np.uint64(0) - ((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1))
            mask = within(lambda j: stored_planes[j][None, :] ^ signs[j][:, None], (len(queries), stored_planes.shape[1]), radius)
            a, b = bit_positions(mask)
            real = (k + b < size) & (k + b > i + a)
            a, b = start + i + a[real], start + k + b[real]
            for j in range(0, len(a), 1 << 17):
                x, y = a[j : j + (1 << 17)], b[j : j + (1 << 17)]
                good = accept(x, y)
                labels.join(x[good], y[good])


def forest(values: np.ndarray, group: np.ndarray, radius: int, accept=every_pair) -> tuple[np.ndarray, np.ndarray]:
    """Places (item, root) that connect the items of each group as their distances do; rows sorted by group.

    Of the pairs within the radius those count that ``accept`` takes, given their places.
    """
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, int)
    sizes = np.diff(np.append(cuts, len(group)))
    labels = Labels(len(values))
    few = (sizes > 1) & (sizes <= SMALL)
    if few.any():
        link_small(values, cuts[few], sizes[few], labels, radius, accept)
    for start, size in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        link_large(values, start, size, labels, radius, accept)
    linked = np.flatnonzero(labels.of != np.arange(len(values)))
    return linked, labels.of[linked]


def _bands(bits: int, n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of n bands that cover ``bits`` bits."""
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _take(value: Column, band: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(value, band[0]).bitwiseAND(F.lit((1 << band[1]) - 1))


def _pack(value: Column, bands: list[tuple[int, int]]) -> Column:
    packed = F.lit(0).cast("long")
    for band in bands:
        packed = F.shiftleft(packed, band[1]).bitwiseOR(_take(value, band))
    return packed


def keys(value: Column, bits: int, radius: int) -> Column:
    """Array of (which, key, rest): all ways to take two of radius + 2 bands, and the bits of the others."""
    bands = _bands(bits, radius + 2)
    return F.array(
        *(
            F.struct(
                F.lit(n).alias("which"),
                _pack(value, list(two)).alias("key"),
                _pack(value, [b for b in bands if b not in two]).alias("rest"),
            )
            for n, two in enumerate(combinations(bands, 2))
        )
    )


def whole_groups(batches, width: int, rows: int = 1 << 18):
    """(table, group number of each row) of many whole groups at a time, from batches sorted by their first ``width`` columns."""

    def changes(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for i in range(width):
            c = table.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return new

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            new = changes(table)
            cut = np.flatnonzero(new)
            if len(cut):
                yield table.slice(0, cut[-1]).combine_chunks(), np.cumsum(new[: cut[-1]])
                table = table.slice(cut[-1])
            held, n = table.to_batches(), table.num_rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.cumsum(changes(table))


def near_links(distinct: DataFrame, radius: int = 2, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that connect the distinct 64-bit values of column ``fingerprint`` as all pairs within the radius do."""
    bits_left = 64 - min(a + b for (_, a), (_, b) in combinations(_bands(64, radius + 2), 2))
    keyed = distinct.select("fingerprint", F.explode(keys(F.col("fingerprint"), 64, radius)).alias("k")).select("fingerprint", "k.*")
    hot = keyed.groupBy("which", "key").agg(F.count("*").alias("__n")).where(F.col("__n") > split).select("which", "key", F.lit(True).alias("__hot"))
    whole = F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey"))
    if hot.isEmpty():
        groups = keyed.withColumn("s", whole)
    else:
        finer = F.transform(keys(F.col("rest"), bits_left, radius), lambda k: F.struct(k["which"].alias("sub"), k["key"].alias("subkey")))
        groups = keyed.join(hot, ["which", "key"], "left").withColumn("s", F.explode(F.when(F.col("__hot"), finer).otherwise(F.array(whole))))
    groups = groups.select("which", "key", "s.sub", "s.subkey", "fingerprint")
    ordered = groups.repartition("which", "key", "sub", "subkey").sortWithinPartitions("which", "key", "sub", "subkey", "fingerprint")

    def compare(batches):
        for table, group in whole_groups(batches, 4):
            values = table.column(4).to_numpy()
            a, b = forest(values.view(np.uint64), group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], names=["a", "b"])

    return ordered.mapInArrow(fresh(compare), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id) for every row of ``df``."""
    rows = stored(fingerprints(df.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text")), "__text", width, "fingerprint", ["__id"]), "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(F.min("__id").alias("first"))
    roots = connected_components(near_links(nodes.select("fingerprint"), radius), "a", "b").withColumnRenamed("node", "fingerprint")
    placed = nodes.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = placed.join(smallest, "root").select("fingerprint", "component_id")
    return rows.join(of, "fingerprint").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
