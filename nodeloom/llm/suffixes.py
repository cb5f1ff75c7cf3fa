"""Sorted suffix runs: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix; the first ``known`` bytes are not looked at again."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:  # a and b agree up to low and differ before high
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(run: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(prefix shared with the one before, length of the rest, all rests) of sorted strings."""
    shared, rests, before = [], [], b""
    for s in run:
        n = common_prefix(before, s)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, "<u2"), np.array([len(r) for r in rests], "<u2"), b"".join(rests)


def front_decode(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a run with the prefix each shares with the one before it."""
    at, before = 0, b""
    for n, m in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:n] + rests[at : at + m]
        at += m
        yield before, n


def merge(runs: Sequence[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, prefix shared with the string before) over all runs in sorted order.

    Every candidate carries the length it shares with the string put out last. Of two candidates,
    the one that shares more is smaller; only at equal lengths are bytes compared, from there on,
    and the loser then carries the length it shares with the winner. Equal strings come in the
    order of their runs.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [*runs, *(iter(()) for _ in range(k - len(runs)))]
    heads: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, source in enumerate(sources):
        if found := next(source, None):
            heads[i] = found[0]

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(x, y, shared[a])
        if n == len(x) or n == len(y):
            first = len(x) < len(y) or (len(x) == len(y) and a < b)
        else:
            first = x[n] < y[n]
        winner, loser = (a, b) if first else (b, a)
        shared[loser] = n
        return winner, loser

    losers = [0] * k
    level = list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        following = []
        for i in range(0, len(level), 2):
            winner, losers[at + i // 2] = duel(level[i], level[i + 1])
            following.append(winner)
        level = following
    winner = level[0]
    while heads[winner] is not None:
        yield winner, heads[winner], shared[winner]
        found = next(sources[winner], None)
        heads[winner], shared[winner] = found if found else (None, 0)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = duel(winner, losers[node])
            node //= 2
