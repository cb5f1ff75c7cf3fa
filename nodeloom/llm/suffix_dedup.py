"""Removal of repeated byte strings by a sparse suffix array, merged from front-coded runs.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes. A start is
judged by its window of ``length`` bytes; equal windows have equal anchors (see ``anchors``), so
suffixes are taken at anchors only, about one place in a hundred:

1. All windows of an anchor share its *core*. Each task sends one row for each distinct core of a
   batch; a core that occurs once in the corpus has no repeated window, whatever surrounds it, and
   its suffix is not exchanged. Hashes of cores only rule suffixes out, they never decide a repeat.
   Of suffixes with the same bytes around them in a batch, compared as bytes, one goes on.
2. Each task sorts the suffixes at its other cores, with the reversed bytes to the left, and sends
   them as front-coded runs. A loser tree that never compares a known prefix again merges the runs. With the common
   prefixes of neighbours to the right, and of the sorted reversed contexts to the left, windows
   fall into classes, and a window is repeated if its class has another member.
3. A core with over ``HOT`` different contexts is too much for one task. Its starts are cut into
   fewer to a core, so that the cores are longer, and these go through the same two steps; with
   one start to a core the core is the window, and a batch sends equal windows once. So no merge
   has a hot key, and none is decided in another way.

Texts are identified by 128 bits of hash; copies have the same result, so ids play no part.

Passages of so many words, whatever their bytes, go the same way when asked for: a text is then taken as its words'
64-bit hashes end to end, in which a window of that many words has one length, and bytes are those of the hashes. White
space between words plays no part.

Defined cases: null and empty texts have nothing to remove and the hash of no bytes; a text shorter
than ``length`` stays; repeated rows are removed whole if long enough; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm._common import Stored, fresh, quoted, scratch, without
from nodeloom.llm.anchors import anchors
from nodeloom.llm.simhash import whole_groups
from nodeloom.llm.suffixes import common_prefix, front_code, front_decode, merge

LENGTH, WIDTH = 400, 201
#: Different contexts of one core, about, up to which they are merged in one task; 16 bits of a digest tell them apart.
HOT = 20_000
#: Into how many parts the starts of a crowded core are cut.
FANOUT = 15
#: Parts that the rows of a crowded core are dealt to.
SALTS = 64
#: Undecided anchors that one task merges, about; there are as many tasks as that takes.
PER_TASK = 100_000
#: Merged suffixes whose windows are classed together, about.
CLASSED = 1 << 15
#: Bytes of text whose anchors are held at once.
HELD = 1 << 23
#: Bytes that stand for a word where windows are of words, and different words whose hashes a task keeps, about.
CODE, CODED = 8, 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_OFFERED = "role byte, core long, t1 long, t2 long, spot long"
_FOUND = "t1 long, t2 long, first int, last int"
#: Roles of rows: the only context of its core in a batch; one of several contexts; the others of those, which need no
#: answer; and starts whose windows stand in the batch again, byte by byte, with the first in the place of the core and
#: the last in that of the spot.
_SINGLE, _SEVERAL, _OTHER, _KNOWN = 0, 1, 2, 3


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return starts[cut], ends[np.append(cut[1:], len(ends)) - 1]


def spot(core_at: int, first: int, last: int, digest: int) -> int:
    """Where a core stands, the first and last start of its windows, and 16 bits of its context, in one number."""
    return core_at << 32 | (core_at - first) << 24 | (core_at - last) << 16 | digest & 0xFFFF


def _offers(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Rows (core, t1, t2, place of the core, first start, last start, text) for the exchange, equal contexts as one."""
    from xxhash import xxh3_64_intdigest

    by_core: dict[int, list[tuple]] = {}
    for row in rows:
        by_core.setdefault(row[0], []).append(row)
    out, known = [], []
    for core, members in by_core.items():
        contexts: dict[tuple, list[tuple]] = {}
        if len(members) == 1:
            contexts[()] = members
        else:
            for row in members:
                contexts.setdefault((row[3] - row[4], row[6][row[4] : row[5] + length]), []).append(row)
        role = _SINGLE if len(contexts) == 1 else _SEVERAL
        for same in contexts.values():
            _, a1, a2, at, first, last, data = same[0]
            out.append((role, core, a1, a2, spot(at, first, last, xxh3_64_intdigest(data[first : last + length]))))
            role = _OTHER
            if len(same) > 1:
                known += [(x[1], x[2], x[4], x[5]) for x in same]
    out += [(_KNOWN, first, a1, a2, last) for a1, a2, first, last in _joined(known)]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _OFFERED.split(", ")])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _octets(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


class _Codes(dict):
    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh64_digest

        if len(self) >= CODED:
            self.clear()
        self[word] = found = xxh64_digest(word)
        return found


def coder(by_words: bool):
    """What the windows of a text are taken of: its bytes, or the hashes of its words, ``CODE`` bytes each."""
    codes = _Codes()
    return (lambda data: b"".join(map(codes.__getitem__, data.split()))) if by_words else lambda data: data


def _survey(length: int, width: int, by_words: bool = False):
    """Batches of (text, t1, t2) to rows for the exchange by core, for all anchors of each different text."""
    from xxhash import xxh64_intdigest

    near = (length - width) // 2

    def run(batches):
        code = coder(by_words)
        for batch in batches:
            texts = dict(zip(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), _octets(batch.column(0)), strict=True))
            rows, held = [], 0
            for (a1, a2), data in texts.items():
                data = code(data)
                for p, first, last in zip(*(x.tolist() for x in anchors(np.frombuffer(data, np.uint8), length, width)), strict=True):
                    at = p - near
                    rows.append((_signed(xxh64_intdigest(data[at : at - width + 1 + length])), a1, a2, at, first, last, data))
                held += len(data)
                if held >= HELD:
                    yield _offers(rows, length)
                    rows, held = [], 0
            yield _offers(rows, length)

    return run


def _refine(length: int, width: int, by_words: bool = False):
    """Batches of (t1, t2, text, crowded cores) to rows for the exchange by core, at most ``width`` starts to a core."""
    from xxhash import xxh64_intdigest

    def run(batches):
        code = coder(by_words)
        for batch in batches:
            rows = []
            for a1, a2, data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _octets(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                data = code(data)
                for x in found:
                    at, first, last = _where(x["spot"])
                    for block in range((at - last) // width, (at - first) // width + 1):
                        core_at = at - block * width
                        core = _signed(xxh64_intdigest(data[core_at : core_at - width + 1 + length]))
                        rows.append((core, a1, a2, core_at, max(first, core_at - width + 1), min(last, core_at), data))
                if len(rows) >= PER_TASK:
                    yield _offers(rows, length)
                    rows = []
            yield _offers(rows, length)

    return run


def _where(x: int) -> tuple[int, int, int]:
    """(place of the core, first start, last start)"""
    at = x >> 32
    return at, at - (x >> 24 & 255), at - (x >> 16 & 255)


def _judge(batches):
    """Rows sorted by (key, t1, t2, spot) to those whose core stands at another place too, each place once, and the known ones."""
    for table, group in whole_groups(batches, 1):
        role, core, t1, t2, spots = (table.column(i).to_numpy() for i in range(1, 6))
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (spots[1:] != spots[:-1]) | (core[1:] != core[:-1])
        places = np.bincount(group, new.astype(int) + (role == _SEVERAL))  # one of several in its batch counts for two
        take = np.flatnonzero(new & ((role >= _OTHER) | (places[group] > 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (role, core, t1, t2, spots)], names=["role", "core", "t1", "t2", "spot"])


def _joined(starts) -> list[list[int]]:
    """Sorted (t1, t2, first, last), with those of a text that touch as one."""
    out: list[list[int]] = []
    for a1, a2, first, last in sorted(starts):
        if out and out[-1][0] == a1 and out[-1][1] == a2 and first <= out[-1][3] + 1:
            out[-1][3] = max(out[-1][3], last)
        else:
            out.append([a1, a2, first, last])
    return out


def _runs(length: int, parts: int, by_words: bool = False):
    """Batches of (t1, t2, text, cores) to sorted front-coded runs, one per target part, and starts already found repeated."""

    def run(batches):
        code = coder(by_words)
        for batch in batches:
            to: dict[int, list] = {}
            for a1, a2, data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _octets(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                data = code(data)
                for x in found:
                    at, first, last = _where(x["spot"])
                    to.setdefault(x["core"] % parts, []).append((data[at : last + length], data[first:at][::-1], a1, a2, at))
            part, blobs, known = [], [], []
            for k in list(to):
                entries = to.pop(k)
                entries.sort()
                sent, many = [], bytearray()
                for e in entries:
                    if sent and sent[-1][0] == e[0] and sent[-1][1] == e[1]:
                        if not many[-1]:
                            known.append(sent[-1])
                            many[-1] = 1
                        known.append(e)
                    else:
                        sent.append(e)
                        many.append(0)
                shared, lengths, rests = front_code([e[0] for e in sent])
                lefts = np.array([len(e[1]) for e in sent], "<u2")
                places = np.array([e[2:] for e in sent], "<i8")
                part.append(k)
                blobs.append(struct.pack("<iq", len(sent), len(rests)) + shared.tobytes() + lengths.tobytes() + lefts.tobytes() + places.tobytes() + bytes(many) + rests + b"".join(e[1] for e in sent))
            if known:
                part.append(known[0][2] % parts)
                blobs.append(struct.pack("<iq", -1, 0) + np.array(_joined((e[2], e[3], e[4] - len(e[1]), e[4] + len(e[0]) - length) for e in known), "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

    return run


class _Run:
    """A received run: suffixes are decoded as the merge asks for them."""

    def __init__(self, blob: bytes):
        n, m = struct.unpack_from("<iq", blob)
        at = struct.calcsize("<iq")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, count, at)
            at += found.nbytes
            return found

        self.shared, self.lengths, lefts = take("<u2", n), take("<u2", n), take("<u2", n)
        self.places, self.many = take("<i8", 3 * n).reshape(n, 3), take("u1", n)
        self.blob, self.rests = blob, blob[at : at + m]
        self.ends = np.cumsum(lefts, dtype=np.int64) + at + m
        self.lefts = lefts

    def left(self, i: int) -> bytes:
        end = int(self.ends[i])
        return self.blob[end - int(self.lefts[i]) : end]

    def __iter__(self):
        return front_decode(self.shared, self.lengths, self.rests)


def classes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Class of each sorted string by its first ``depth`` bytes, from the prefixes neighbours share."""
    return np.cumsum(shared < depth)


def repeated_starts(runs: list[_Run], length: int, width: int):
    """Batches of (places, mask over distances from start to core) of all suffixes with a repeated window.

    Only the suffixes of some cores at a time are held besides the runs.
    """
    nexts = [0] * len(runs)
    shared, rights, lefts, of, index = [], [], [], [], []
    for k, string, n in merge([iter(r) for r in runs]):
        if n <= length - width and len(shared) >= CLASSED:  # another core begins
            yield _classed(runs, shared, rights, lefts, of, index, length, width)
            shared, rights, lefts, of, index = [], [], [], [], []
        i = nexts[k]
        nexts[k] = i + 1
        shared.append(n)
        rights.append(len(string))
        lefts.append(runs[k].left(i))
        of.append(k)
        index.append(i)
    if shared:
        yield _classed(runs, shared, rights, lefts, of, index, length, width)


def _classed(runs, shared, rights, lefts, of, index, length: int, width: int):
    n = len(shared)
    shared = np.array(shared)
    shared[0] = -1
    order = sorted(range(n), key=lefts.__getitem__)
    left_shared = np.array([-1, *(common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False))])
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    left_length, right_length = np.array([len(x) for x in lefts]), np.array(rights)
    many = np.array([runs[k].many[i] for k, i in zip(of, index, strict=True)], np.int64)
    mask = np.zeros((n, width), bool)
    for k in range(width):  # windows that start k bytes before the core
        active = np.flatnonzero((left_length >= k) & (right_length >= length - k))
        if not len(active):
            continue
        key = classes(shared, length - k)[active] * n + classes(left_shared, k)[back][active]
        _, which = np.unique(key, return_inverse=True)
        mask[active[np.bincount(which, 1 + many[active])[which] > 1], k] = True
    hit = np.flatnonzero(mask.any(1) & (many == 0))  # those that a batch had several of are known already
    return np.array([runs[of[i]].places[index[i]] for i in hit], np.int64).reshape(-1, 3), mask[hit]


def _merge_runs(length: int, width: int):
    """Batches of runs to the repeated runs of starts; a task holds the front-coded contexts of its parts only."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def rows(t1, t2, first, last):
        return pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=names)

    def run(batches):
        runs = []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                if struct.unpack_from("<i", blob)[0] >= 0:
                    runs.append(_Run(blob))
                else:
                    known = np.frombuffer(blob, "<i8", offset=struct.calcsize("<iq")).reshape(-1, 4)
                    yield rows(*known.T)
        for places, mask in repeated_starts(runs, length, width):
            edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            at = places[row, 2]
            yield rows(places[row, 0], places[row, 1], at - high + 1, at - low)

    return run


def repeated_runs(docs: DataFrame, text: str = "__text", length: int = LENGTH, width: int = WIDTH, hot: int = HOT, by_words: bool = False) -> list[DataFrame]:
    """Tables of (t1, t2, first, last): runs of starts of repeated windows; texts are named by their hashes.

    ``by_words``: all are places in the coded text, and the last of a copy's may lie beyond its end.
    """
    spark = docs.sparkSession

    def with_text(rows: DataFrame) -> DataFrame:
        """One copy of each text that has such rows, with the rows."""
        lists = rows.groupBy("t1", "t2").agg(F.collect_list(F.struct("core", "spot")).alias("found"))
        return docs.groupBy("t1", "t2").agg(F.first(text).alias(text)).join(lists, ["t1", "t2"]).select("t1", "t2", text, "found")

    copies = docs.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n > 1")
    size = (F.col("size") + 1) * (CODE // 2) if by_words else F.col("size")
    found = [copies.select("t1", "t2", F.lit(0).alias("first"), (size - length).cast("int").alias("last"))]
    offered = docs.select(text, "t1", "t2").mapInArrow(fresh(_survey(length, width, by_words)), _OFFERED)
    while True:
        key = F.when(F.col("role") >= _OTHER, F.col("t1")).otherwise(F.col("core"))
        ordered = offered.repartition(key).sortWithinPartitions(key, "t1", "t2", "spot").select(key.alias("key"), "role", "core", "t1", "t2", "spot")
        both = Stored(ordered.mapInArrow(fresh(_judge), _OFFERED), "anchors").read()
        found.append(both.where(F.col("role") == _KNOWN).select("t1", "t2", F.col("core").cast("int").alias("first"), F.col("spot").cast("int").alias("last")))
        judged = both.where(F.col("role") != _KNOWN).drop("role")
        crowded = None
        if width > 1:
            contexts = judged.select("core", F.col("spot").bitwiseAND(F.lit(0xFFFF)).alias("context")).distinct().groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > hot)
            crowded = Stored(contexts.select("core", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "crowded").read()
            crowded = None if crowded.isEmpty() else crowded
        salted = judged.withColumn("salt", F.pmod("t1", F.lit(SALTS)).cast("int"))  # a crowded core is no hot key
        sparse = judged if crowded is None else salted.join(crowded, ["core", "salt"], "left_anti")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sparse.count() // PER_TASK))
        runs = with_text(sparse).mapInArrow(fresh(_runs(length, parts, by_words)), "part int, run binary")
        found.append(runs.repartition(parts, "part").mapInArrow(fresh(_merge_runs(length, width)), _FOUND))
        if crowded is None:
            return found
        width = -(-width // FANOUT)
        offered = with_text(salted.join(crowded, ["core", "salt"], "left_semi")).mapInArrow(fresh(_refine(length, width, by_words)), _OFFERED)


def passage_bytes(data: bytes, first: np.ndarray, last: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the bytes of passages of ``words`` words, from the runs of their starts in the coded text."""
    edges = np.array([m.span() for m in _WORD.finditer(data)], np.int64).reshape(-1, 2)
    low, high = -(-first // CODE), np.minimum(last // CODE, len(edges) - words)
    low, high = low[low <= high], high[low <= high]
    return edges[low, 0], edges[high + words - 1, 1]


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, width: int = WIDTH, hot: int = HOT, with_kept: bool = False, words: int | None = None) -> DataFrame:
    """``df`` without its text column, with n_bytes, n_removed, n_spans and kept_sha256.

    ``with_kept`` adds ``kept``, the text left; of a character cut apart no byte is left. ``words``, three at
    least: every passage of so many words that also starts anywhere else goes too, however few bytes it has.
    """
    if words is not None and words < 3:
        raise ValueError("a passage has three words at least")
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    keep = [c for c in without(df, new) if c != text_col]
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    docs = df.select(F.struct(F.lit(0).alias("__one"), *(F.col(quoted(c)) for c in keep)).alias("__row"), text.alias("__text"))
    docs = docs.withColumns({"t1": F.xxhash64("__text"), "t2": F.xxhash64(F.lit(1), "__text"), "size": F.octet_length("__text")})
    least = length if words is None else min(length, 2 * words - 1)
    long, none = docs.where(F.col("size") >= least), F.lit(None).cast("array<int>")
    sets = ["found"] if words is None else ["found", "coded"]
    with scratch():
        runs = reduce(DataFrame.unionByName, repeated_runs(docs.where(F.col("size") >= length), "__text", length, width, hot))
        lists = [F.collect_set(F.struct("first", "last")).alias("found")]
        if words is not None:
            coded = repeated_runs(docs.where(F.col("size") >= 2 * words - 1), "__text", CODE * words, min(255, CODE // 2 * words - 3), hot, by_words=True)
            runs = runs.withColumn("of", F.lit("found")).unionByName(reduce(DataFrame.unionByName, coded).withColumn("of", F.lit("coded")))
            lists = [F.collect_set(F.when(F.col("of") == x, F.struct("first", "last"))).alias(x) for x in sets]
        lists = Stored(runs.groupBy("t1", "t2").agg(*lists), "repeats", keep=True).read()
    joined = long.join(lists, ["t1", "t2"], "left").select("__row", "__text", *(F.col(f"{x}.{k}").alias(f"{x}_{k}") for x in sets for k in ("first", "last")))
    joined = joined.unionByName(docs.where(F.col("size") < least).select("__row", "__text", *(none.alias(c) for c in joined.columns[2:])))
    numbers = [T.StructField(n, T.LongType()) for n in new[:3]]
    schema = T.StructType([docs.schema["__row"], *numbers, T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.StringType())] * with_kept])

    def cut(batches):
        for batch in batches:
            rows = []
            for data, *runs in zip(_octets(batch.column(1)), *batch.columns[2:], strict=True):
                removed = spans = 0
                kept = data
                first, last, *coded = (x.values.to_numpy().astype(np.int64) if x.is_valid else np.empty(0, np.int64) for x in runs)
                last += length
                if coded and len(coded[0]):
                    first, last = (np.concatenate(x) for x in zip((first, last), passage_bytes(data, *coded, words), strict=True))
                if len(first):
                    starts, ends = merged(first, last)
                    removed, spans = int((ends - starts).sum()), len(starts)
                    edges = [0, *np.stack((starts, ends), 1).reshape(-1).tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * with_kept))
            columns = list(zip(*rows, strict=True)) or [[]] * (4 + with_kept)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=schema.names)

    out = joined.mapInArrow(fresh(cut), schema)
    return out.select(*(F.col("__row")[c].alias(c) for c in keep), *schema.names[1:])
