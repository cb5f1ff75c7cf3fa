"""Content-defined anchors: places that every copy of a string picks alike.

For a window of ``length`` bytes, the anchor is the place of the smallest hash of eight bytes among
the ``width`` places in its middle. Equal windows have their anchor at the same offset, so windows
need only be compared with windows of an equal anchor, and consecutive windows mostly share one.
"""

from __future__ import annotations

import numpy as np

GRAM = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the eight bytes from each place on; the last seven places have none."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    x *= _ODD
    return x >> np.uint64(32)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of ``width`` values, the place of the smallest, the first of equals; values below 2**32."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    keyed = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    keyed[: len(values)] = values << np.uint64(32) | np.arange(len(values), dtype=np.uint64)
    grid = keyed.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first window start, last window start) of all windows of a text, in order."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    lead = (length - width) // 2
    found = []
    for i in range(0, n, _CHUNK):
        m = min(_CHUNK, n - i)
        part = data[i + lead : i + lead + m + width - 1 + GRAM - 1]
        found.append(sliding_first_min(gram_hashes(part), width) + i + lead)
    places = found[0] if len(found) == 1 else np.concatenate(found)
    cuts = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    return places[cuts], cuts, np.append(cuts[1:], n) - 1
