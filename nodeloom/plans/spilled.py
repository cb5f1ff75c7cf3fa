"""Rows of numbers that a task reads again and again: in memory while they are few, in a file of its own beyond."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Rows in memory at once, and bytes that are kept there before the file is begun.
BLOCK_ROWS, KEPT_BYTES = 16_384, 64_000_000


class Spilled:
    """A matrix that grows by rows and is read in blocks, in the order in which they came."""

    def __init__(self, width: int):
        self.shape, self._held, self._file, self._kept = (0, width), [], None, 0

    def __len__(self) -> int:
        return self.shape[0]

    def append(self, rows: np.ndarray) -> None:
        rows = np.ascontiguousarray(rows, float)
        self.shape = (self.shape[0] + len(rows), self.shape[1])
        if self._file is None and self._kept + rows.nbytes <= KEPT_BYTES:
            self._held.append(rows)
            self._kept += rows.nbytes
            return
        if self._file is None:
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self._file = tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None)
            for part in self._held:
                self._file.write(part)
            self._held = []
        self._file.write(rows)

    def blocks(self) -> Iterator[np.ndarray]:
        if self._file is None:
            yield from self._held
            return
        self._file.seek(0)
        for start in range(0, len(self), BLOCK_ROWS):
            block = np.empty((min(BLOCK_ROWS, len(self) - start), self.shape[1]))
            self._file.readinto(memoryview(block).cast("B"))
            yield block

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out, start = np.empty(self.shape, dtype or float), 0
        for block in self.blocks():
            out[start : start + len(block)] = block
            start += len(block)
        return out


def blocks(x) -> Iterator[tuple[slice, np.ndarray]]:
    """(which rows, their values) of a matrix or of spilled rows."""
    start = 0
    for part in x.blocks() if isinstance(x, Spilled) else (x[i : i + BLOCK_ROWS] for i in range(0, len(x), BLOCK_ROWS)):
        yield slice(start, start + len(part)), part
        start += len(part)
