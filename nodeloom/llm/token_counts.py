"""Token counts under a SentencePiece model, by a map-side two-tier lookup.

No piece of the model holds a word boundary anywhere but at its start, so no merge crosses the
place between a character and a following space: a text falls apart into pre-tokens, each a run of
spaces and the characters up to the next space, and its count is the sum of theirs. The first
tier is a compact table of the lengths of frequent pre-tokens, built once and broadcast; what it
lacks goes to the second tier, a cache that each Python worker fills by encoding the miss.
Frequencies are counted over all texts without any shuffle of pre-tokens: each task keeps a summary of
a fixed number of heavy hitters, and summaries, one row each, are merged as a tree. A pre-token that
makes up more than one in ``FREQUENT`` of all is in the table; no count of tokens depends on what is.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row;
nothing else of the row is read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm._common import Stored, append_columns, forgets, fresh, quoted, scratch, worker_cache

#: Entries of the broadcast tier, and of each worker's cache before it is emptied.
FREQUENT, CACHED = 65_536, 400_000
#: Summaries that one task merges.
FAN = 32
#: Longer pre-tokens are encoded but not kept in a cache.
LONGEST_KEPT = 64

_SPACES = re.compile(r"( +[^ ]*)")


@lru_cache(maxsize=4)
def load(model_path: str):
    """The model and whether counting by pre-tokens is exact for it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    splits = all("▁" not in p.lstrip("▁") for p in pieces) and model.normalize("a  b\n c") == "▁a▁▁b\n▁c"
    return model, splits


class Lengths(dict):
    """Pre-token to number of tokens; misses are encoded, and kept up to a fixed number of entries."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__()
        self.model = model
        self.prefer(frequent)

    def prefer(self, frequent: dict[str, int]) -> None:
        self.frequent = frequent | {"": 1}  # a space before another run of spaces, or at the end
        self.update(self.frequent)

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word, num_threads=1))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHED + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


forgets.append(load.cache_clear)


def worker_lengths(model_path: str) -> Lengths:
    """The cache of this Python worker; it outlives a task."""
    return worker_cache(f"token_counts {model_path}", lambda: Lengths(load(model_path)[0], {}))


def pre_tokens(text: str) -> list[str]:
    """Words as the model is to be given them; it puts one space before each by itself."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [x[1:] for x in _SPACES.findall(f" {text}")]


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """The table as two byte strings: the words, and one byte each for their lengths."""
    kept = sorted((w, n) for w, n in lengths.items() if n < 256 and "\0" not in w)
    return "\0".join(w for w, _ in kept).encode("utf-8", "surrogatepass"), bytes(n for _, n in kept)


def unpack(table: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(table[0].decode("utf-8", "surrogatepass").split("\0"), table[1], strict=True)) if table[1] else {}


def thinned(counts: Counter, size: int) -> Counter:
    """At most ``size`` entries, all less the largest count that is left out, as Misra and Gries do."""
    if len(counts) <= size:
        return counts
    ordered = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    cut = ordered[size][1]
    return Counter({w: n - cut for w, n in ordered[:size] if n > cut})


def _summary(counts: Counter) -> pa.RecordBatch:
    words, numbers = "\0".join(counts).encode("utf-8", "surrogatepass"), np.fromiter(counts.values(), "<i8", len(counts)).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([words], pa.binary()), pa.array([numbers], pa.binary())], names=["words", "counts"])


def _merged(batches, size: int) -> Counter:
    counts = Counter()
    for batch in batches:
        for words, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if numbers:
                for w, n in zip(words.decode("utf-8", "surrogatepass").split("\0"), np.frombuffer(numbers, "<i8").tolist(), strict=True):
                    counts[w] += n
                counts = thinned(counts, size)
    return counts


def frequent_words(df: DataFrame, text_col: str, size: int = FREQUENT, room: int = FREQUENT) -> list[str]:
    """The commonest pre-tokens of all texts, the first in order of equals, from summaries of ``room`` entries."""

    def count(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(w for w in pre_tokens(text or "") if 0 < len(w) <= LONGEST_KEPT and "\0" not in w)
                if len(counts) > 4 * room:
                    counts = thinned(counts, room)
        yield _summary(thinned(counts, room))

    def merge(batches):
        yield _summary(_merged(batches, room))

    kinds = "words binary, counts binary"
    level = df.select(F.col(quoted(text_col)).cast("string").alias("t")).mapInArrow(fresh(count), kinds)
    held = Stored(level, "words")
    n = held.read().count()
    while n > 1:  # FAN summaries to a task, until one is left
        n = -(-n // FAN)
        following = Stored(held.read().repartition(n).mapInArrow(fresh(merge), kinds), "words")
        held.drop()
        held = following
    found = _merged([_as_batch(held.read().collect())], room)  # one row of a fixed size
    held.drop()
    return [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:size]]


def _as_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bytes(r[i]) for r in rows], pa.binary()) for i in range(2)], names=["words", "counts"])


def token_counts(df: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to every row of ``df``."""
    spark = df.sparkSession
    with scratch():
        words = frequent_words(df, text_col)
    lengths = map(len, load(model_path)[0].encode(words, num_threads=1)) if words else []
    table = spark.sparkContext.broadcast(pack(dict(zip(words, lengths, strict=True))))

    def make():
        model, splits = load(model_path)
        lengths = worker_lengths(model_path)
        lengths.prefer(unpack(table.value))

        def count(text: str) -> int:
            if not text:
                return 0
            if splits and "▁" not in text:  # the model takes that sign for a space
                return sum(map(lengths.__getitem__, pre_tokens(text)))
            return len(model.encode(text, num_threads=1))

        def columns(texts):
            tokens = [count(t) for t in texts]
            return [[len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], tokens, [n > limit for n in tokens]]

        return columns

    return append_columns(df, text_col, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make, caches=True)
