"""Byte-level BPE encoding and decoding by merge replay over many words at once.

The distinct pre-tokens of a block of documents are laid end to end. An inverted index maps each
rank to the places where a pair with that rank stands; ranks are taken in ascending order, all
places of a rank are merged at once, and only the two neighbours of a merged place are looked up
again and enter the index. A place is left out if its pair changed meanwhile, and of overlapping
places every second one is, as from left to right. Decoding looks the ids up and joins the bytes.

Defined cases: null and empty texts give no tokens; lone surrogates cannot occur in Spark strings;
every byte has a rank, so every text can be encoded, and decoding gives its UTF-8 bytes again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
import unicodedata
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nodeloom.llm._common import append_columns, forgets, worker_cache

#: Pre-tokens that a worker's cache holds, about; long ones are not kept.
CACHED, LONGEST_KEPT = 800_000, 64
#: Characters of a block of documents whose new pre-tokens are replayed together.
BLOCK = 32_000_000
NONE = np.int32(2**31 - 1)


class Merges:
    """Merge rules as a table: a pair of ids to its rank, and a rank to the id of both."""

    def __init__(self, rules: dict[tuple[int, int], int], made: np.ndarray):
        self.width = 1 + max((max(p) for p in rules), default=0)
        self.width = max(self.width, len(made) + 1)
        keys = np.array([a * self.width + b for a, b in rules], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(rules.values()), np.int32)[order]
        self.made = made  # the id that a merge of this rank gives

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


class ByteRanks(Merges):
    """The ranks of a file: a pair merges if its bytes have a rank, which is the id as well."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks_of = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        rules = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        super().__init__(rules, np.arange(len(self.bytes_of), dtype=np.int32))

    def start(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all bytes of all words, number of bytes of each word)"""
        return self.first[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words], np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> ByteRanks:
    return ByteRanks(path)


def distinct(x: np.ndarray) -> np.ndarray:
    """``x`` sorted, without repeats; sorts it in place."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def replay(ids: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, by applying all merges in rank order to all words together.

    ``ids`` are the words' first ids end to end, ``lengths`` how many each word has. Returns the
    new ids end to end and where each word starts, with the end of the last.
    """
    if not len(ids):
        return ids, np.zeros(len(lengths) + 1, np.int64)
    ids = ids.copy()
    ends = np.cumsum(lengths)
    n = len(ids)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[lengths > 0] - 1] = -1
    starts = (ends - lengths)[lengths > 0]
    before[starts] = -1
    alive = np.ones(n, bool)
    ranked = np.full(n, NONE, np.int32)  # the rank of the pair that starts here
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Looks the pairs that start at these places up and enters them into the index."""
        places = places[after[places] >= 0]
        found = merges.pair(ids[places], ids[after[places]])
        ranked[places] = found
        places, found = places[found != NONE], found[found != NONE]
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for rank, part in zip(found[np.concatenate(([0], cuts))].tolist() if len(found) else [], np.split(places, cuts), strict=False):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(waiting, rank)

    enter(np.arange(n))
    while waiting:
        rank = heapq.heappop(waiting)
        parts = index.pop(rank)
        places = parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))
        places = places[alive[places] & (ranked[places] == rank)]
        if not len(places):
            continue
        if len(places) > 1:
            chained = after[places[:-1]] == places[1:]
            if chained.any():  # overlapping places: every second of a run, from its left end
                run_start = np.concatenate(([True], ~chained))
                since = np.arange(len(places)) - np.maximum.accumulate(np.where(run_start, np.arange(len(places)), 0))
                places = places[since % 2 == 0]
        gone = after[places]
        ids[places] = merges.made[rank]
        alive[gone] = False
        following = after[gone]
        after[places] = following
        inner = following >= 0
        before[following[inner]] = places[inner]
        ranked[places] = NONE
        left = before[places]
        left[1:][left[1:] == places[:-1]] = -1  # merged places themselves
        left = left[left >= 0]
        ranked[left] = NONE
        places = np.concatenate((left, places))
        places.sort()
        enter(places)
    flat = ids[alive]
    return flat, np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]


class Words(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers.

    An unknown pre-token is noted with an empty array that is filled once it is learnt, so that each place in a
    text costs one look-up. Entries are of two generations: what is not asked for in one is forgotten
    with the next. ``room`` is how many there are at most, about, ``block`` how many characters of text are
    looked at together.
    """

    def __init__(self, room: int | None = None, block: int | None = None):
        super().__init__()
        self.room, self.block = room or CACHED, block or BLOCK
        self.new: dict[str, bytearray] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        """Makes all entries old ones; those that were old already go."""
        self.old = dict(self)
        self.clear()

    def forget(self) -> None:
        self.old, self.new = {}, {}
        self.clear()

    def __missing__(self, word: str):
        known = self.old.get(word)
        if known is not None:
            self[word] = known
            return known
        self[word] = self.new[word] = later = bytearray()
        return later

    def learn(self, words: list[str], merges) -> None:
        flat, bounds = replay(*merges.start([w.encode() for w in words]), merges)
        data = flat.astype("<u4").tobytes()
        at = (4 * bounds).tolist()
        self.update(zip(words, [data[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))


forgets.append(load.cache_clear)


def worker_words(path: str) -> Words:
    """The cache of this Python worker; it outlives a task."""
    return worker_cache(f"byte_bpe {path}", Words)


def foreign(pattern: str):
    """A test for characters that match ``pattern``; for texts of the first 256 characters without regular expressions."""
    search = re.compile(pattern).search
    fine = bytes(i for i in range(256) if not search(chr(i)))

    def test(text: str) -> bool:
        try:
            return bool(text.encode("latin-1").translate(None, fine))
        except UnicodeEncodeError:
            return bool(search(text))

    return test


#: Any character but ASCII print, white space and the Latin blocks.
_NOT_LATIN = foreign(r"[^\t-\r -~\x85\xa0-\u024f]")


@lru_cache(maxsize=2)
def splitter(pattern: str):
    """Splits a text by ``pattern``: by the standard library where classes for the Latin blocks do, which is faster."""
    import regex

    def letters(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)

    space, letter, number = r"\t-\r \x85\xa0", letters("L"), letters("N")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    for name, chars in ((r"\p{L}", letter), (r"\p{N}", number), (r"\s", space)):
        plain = plain.replace(f"[{name}]", f"[{chars}]").replace(name, f"[{chars}]")
    plain = plain.replace(r"\S", f"[^{space}]")
    slow = regex.compile(pattern).findall
    if r"\p" in plain:
        return slow
    fast, odd = re.compile(plain).findall, _NOT_LATIN
    return lambda text: fast(text) if text.isascii() or not odd(text) else slow(text)


def encode(texts: list[str], path: str, pattern: str, words: Words | None = None) -> list[bytes]:
    """The ids of every text as little-endian unsigned 32-bit integers."""
    merges, split = load(path), splitter(pattern)
    words = worker_words(path) if words is None else words
    return encode_blocks(texts, split, words, lambda new: words.learn(new, merges))


@contextmanager
def no_cycles():
    """Many lists are made here and none of them in a cycle: the collector need not look at them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encode_blocks(texts: list[str], split, words: Words, learn) -> list[bytes]:
    """Joins what ``words`` holds for the parts of every text; ``learn`` fills in the parts that a block of texts brings."""
    out: list[bytes] = []
    for block in blocks(texts, words.block):
        if len(words) > words.room // 2:
            words.turn()
        try:
            with no_cycles():
                found = [list(map(words.__getitem__, split(t))) for t in block]
                new, words.new = words.new, {}
                learn(list(new))
                for word, later in new.items():
                    later[:] = words[word]
                    if len(word) > LONGEST_KEPT:
                        del words[word]
                out += map(b"".join, found)
        except BaseException:
            words.forget()
            raise
    return out


def blocks(texts: list[str], size: int = BLOCK):
    """The texts in order, in lists of about ``size`` characters."""
    block, held = [], 0
    for text in texts:
        block.append(text)
        held += len(text) + 1
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def decode(ids: bytes, path: str) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(load(path).bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(df: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds n_tokens and the SHA-256 of the ids and of the decoded bytes; with ``with_ids`` also ids and decoded."""

    def make():
        def columns(texts):
            found = encode(texts, path, pattern)
            back = [decode(x, path) for x in found]
            out = [[len(x) // 4 for x in found], [hashlib.sha256(x).hexdigest() for x in found], [hashlib.sha256(x).hexdigest() for x in back]]
            return [*out, found, back] if with_ids else out

        return columns

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append_columns(df, text_col, [*fields, *[("ids", T.BinaryType()), ("decoded", T.BinaryType())] * with_ids], make, held=None, caches=True)
