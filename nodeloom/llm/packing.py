"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Best-two-fit: a bin is filled greedily with the longest pieces that fit; if room is left, its
smallest piece is taken out again and two unpacked pieces that fill the widened gap more tightly
take its place.

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths
alone, which has at most ``size`` entries whatever the input: each planned bin is repeated as often
as the remaining counts allow, so a plan has about as many patterns as there are lengths. Documents
then find their place by their rank among the pieces of their length. Ranks come from one pass
that numbers the pieces of each length within a task, plus the counts of the tasks before; nothing
is sorted, no length class ever meets in one task, and the driver sees the histogram only.

Tokens: no pre-token spans white space, so ids are looked up by white-space separated chunk in a
cache that each worker fills by replaying the tokenizer's merges over all new pre-tokens at once
(see ``byte_bpe``); texts with characters for which this is not known to be exact, and tokenizers
of another kind, go through the tokenizer itself.

Defined cases: null and empty texts are documents of one token, the separator; repeated rows and
equal doc_ids are packed each on their own; an empty table packs into nothing.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm._common import forgets, fresh, in_parts, quoted, stored, worker_cache
from nodeloom.llm.byte_bpe import Merges, Words, encode_blocks, foreign, splitter

SIZE, SEPARATOR = 4096, 1
#: Anything but ASCII print, white space and those letters and signs of the Latin blocks that are in
#: NFC as they are and lower-cased alone: such texts go to the tokenizer whole.
_ODD = foreign(r"[^\t-\r -~¡-ĩĬ-ńŊ-ɏ]|ſ")


class WordMerges(Merges):
    """The merges of a tokenizer whose words end in a suffix, and whose pre-tokens never span white space."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rules = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        super().__init__(rules, np.array([vocabulary[a + b] for a, b in pairs], np.int32))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the other bytes are written as 256 and up, in order
        sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.inner = np.array([vocabulary[sign[b]] for b in range(256)], np.int32)
        self.final = np.array([vocabulary[sign[b] + suffix] for b in range(256)], np.int32)

    def start(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first ids of all words, number of bytes of each word); no word is empty."""
        data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        ids, last = self.inner[data], np.cumsum(lengths) - 1
        ids[last] = self.final[data[last]]
        return ids, lengths


#: The pre-tokens of ``word_bpe`` files, for the Latin blocks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def load(path: str):
    """(tokenizer, its merges if they can be replayed chunk by chunk, strings of special tokens)"""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = (
        model["type"] == "BPE"
        and model.get("end_of_word_suffix")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
    )
    return tokenizer, WordMerges(spec) if known else None, [t["content"].lower() for t in spec.get("added_tokens", [])]


class Chunks(Words):
    """Lower-case chunk without white space to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, room: int | None = None, block: int | None = None):
        super().__init__(room, block)
        self.parts = Words(room)  # the same for the pre-tokens that chunks consist of

    def learn(self, words: list[str], merges: WordMerges) -> None:
        if len(self.parts) > self.room // 8:
            self.parts.turn()
        known = self.parts
        found = [[c] if c.isascii() and c.isalpha() else self.split(c) for c in words]
        known.learn([p for p in set(chain.from_iterable(found)) if p not in known and p not in known.old], merges)
        self.update(zip(words, [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in found], strict=True))

    split = staticmethod(splitter(_SPLIT))


forgets.append(load.cache_clear)


def worker_chunks(path: str, room: int | None = None, block: int | None = None) -> Chunks:
    """The cache of this Python worker; it outlives a task."""
    return worker_cache(f"packing {path} {room} {block}", lambda: Chunks(room, block))


def token_bytes(texts: list[str], path: str, chunks: Chunks) -> list[bytes]:
    """The ids of every text, as ``tokenizers`` gives them without special tokens."""
    tokenizer, merges, specials = load(path)
    plain = [merges is not None and not _ODD(t) and not any((s[0].isalpha() or s[0] in t) and s in t.lower() for s in specials) for t in texts]
    found = iter(encode_blocks([t for t, p in zip(texts, plain, strict=True) if p], lambda t: t.lower().split(), chunks, lambda new: chunks.learn(new, merges)))
    return [next(found) if p else np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, p in zip(texts, plain, strict=True)]


PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("task", T.LongType()),
        T.StructField("rank", T.LongType()),
    ]
)


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, size: int, separator: int, with_ids: bool, room: int | None = None, block: int | None = None) -> DataFrame:
    """One row per piece; ``rank`` numbers the pieces of one length within the task that wrote them."""
    schema = T.StructType([df.schema[id_col], *(f for f in PIECES.fields if with_ids or f.name != "ids")])
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        task, seen, chunks = TaskContext.get().partitionId(), {}, worker_chunks(path, room, block)
        for batch in batches if block is None else (part for whole in batches for part in in_parts(whole, 1, block)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows = {n: [] for n in schema.names[1:]}
            source = []
            for i, ids in enumerate(token_bytes(texts, path, chunks)):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[start : start + 4 * size]
                    n = len(part) // 4
                    seen[n] = (rank := seen.get(n, -1) + 1)
                    source.append(i)
                    for name, value in (("piece", k), ("start", start // 4), ("length", n), ("ids_crc32", zlib.crc32(part)), ("ids", part), ("task", task), ("rank", rank)):
                        if name in rows:
                            rows[name].append(value)
            kinds = {"piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(v, kinds.get(n, pa.int64())) for n, v in rows.items())], names=schema.names)

    return df.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string").alias("__nodeloom_text")).mapInArrow(run, schema)


class _Left:
    """What is left of each length, with the longest length up to a bound found in logarithmic time."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.lengths = sorted(counts)

    def longest(self, room: int) -> int:
        i = bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else 0

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.lengths.remove(length)

    def give(self, length: int, n: int) -> None:
        if length not in self.counts or not self.counts[length]:
            i = bisect_right(self.lengths, length)
            self.lengths.insert(i, length)
            self.counts[length] = 0
        self.counts[length] += n


def best_two(left: _Left, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is as near below ``room`` as can be."""
    best, pair = 0, None
    lengths = left.lengths
    i, j = 0, bisect_right(lengths, room) - 1
    while i <= j and best < room:
        total = lengths[i] + lengths[j]
        if total > room:
            j -= 1
        elif i == j and left.counts[lengths[i]] < 2:
            i += 1
        else:
            if total > best:
                best, pair = total, (lengths[j], lengths[i])
            i += 1
    return pair


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how often, [(length, how many)]): best-two-fit on what is left, one pattern at a time.

    A pattern is repeated as long as every length in it lasts, so each uses up at least one length.
    """
    left, bins = _Left({k: v for k, v in counts.items() if v}), []
    while left.lengths:
        content: dict[int, int] = {}
        room = size
        while room and (length := left.longest(room)):
            n = min(left.counts[length], room // length)
            left.take(length, n)
            content[length] = content.get(length, 0) + n
            room -= n * length
        if room and sum(content.values()) > 1:
            smallest = min(content)
            if (pair := best_two(left, room + smallest)) and sum(pair) > smallest:
                content[smallest] -= 1
                if not content[smallest]:
                    del content[smallest]
                for length in pair:
                    left.take(length, 1)
                    content[length] = content.get(length, 0) + 1
                left.give(smallest, 1)
        times = 1 + min(left.counts[k] // n for k, n in content.items())
        for length, n in content.items():
            if times > 1:
                left.take(length, n * (times - 1))
        bins.append((times, sorted(content.items(), reverse=True)))
    return bins


def slots(bins) -> np.ndarray:
    """Rows (length, first rank, how many per bin, first bin, offset), sorted by length and first rank.

    The pieces of a length with ranks from the first on go to the bins from the first on.
    """
    used: dict[int, int] = {}
    rows, bin_id = [], 0
    for times, content in bins:
        offset = 0
        for length, n in content:
            first = used.get(length, 0)
            rows.append((length, first, n, bin_id, offset))
            used[length] = first + n * times
            offset += n * length
        bin_id += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_fit_packing(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    separator: int = SEPARATOR,
    with_ids: bool = False,
    room: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """Packs every document of ``df``; one row per piece with its sequence and offset there.

    ``with_ids`` adds the ids themselves as little-endian unsigned 32-bit integers. ``room`` and ``block``
    bound what a worker keeps of the chunks it has seen, and the text it looks at together; they change no result.
    """
    spark = df.sparkSession
    rows = stored(pieces(df, path, id_col, text_col, size, separator, with_ids, room, block), "pieces")
    by_task = rows.groupBy("task", "length").agg(F.count("*").alias("__n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `size` rows
    table = spark.sparkContext.broadcast(slots(plan(counts, size)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = rows.join(before, ["task", "length"])
    names = [c for c in rows.columns if c not in ("task", "rank")]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        found = table.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            key = found[:, 0] * (1 << 44) + found[:, 1]
            at = found[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            sequence, offset = at[:, 3] + (rank - at[:, 1]) // at[:, 2], at[:, 4] + (rank - at[:, 1]) % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return ranked.select(*(F.col(quoted(c)) for c in names), (F.col("rank") + F.col("__before")).alias("__rank")).mapInArrow(fresh(place), schema)
