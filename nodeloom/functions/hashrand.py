"""Random draws that depend on their keys only, not on partitions or order.

A draw hashes its seed and keys; the same text in, the same number out, in Spark and in any engine
with md5. Uniform draws lie strictly between 0 and 1.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that make a draw.
DIGITS = 12


def _key(parts) -> Column:
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def uniform(*keys) -> Column:
    """A uniform draw named by ``keys``: columns, or values that are the same for all rows."""
    digits = F.conv(F.substring(F.md5(_key(keys)), 1, DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**DIGITS)


def normal(*keys, sigma: float = 1.0, mean: float = 0.0) -> Column:
    """A normal draw, by Box and Muller from two uniform ones."""
    radius = F.sqrt(-2.0 * F.log(uniform(*keys, "r")))
    return mean + sigma * radius * F.cos(2.0 * math.pi * uniform(*keys, "a"))


def below(n, *keys) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(*keys) * n).cast("int")


class Draws:
    """The same draws in Python, of keys that begin alike."""

    def __init__(self, *keys):
        self.start = "|".join(map(str, keys))

    def uniform(self, *keys) -> float:
        text = "|".join([self.start, *map(str, keys)])
        return (int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16) + 0.5) / float(16**DIGITS)

    def normal(self, *keys) -> float:
        return math.sqrt(-2.0 * math.log(self.uniform(*keys, "r"))) * math.cos(2.0 * math.pi * self.uniform(*keys, "a"))

    def normals(self, *shape: int) -> np.ndarray:
        """A draw for each place of an array, named by its indices."""
        return np.array([self.normal(*at) for at in np.ndindex(*shape)]).reshape(shape)

    def below(self, n: int, *keys) -> int:
        return int(math.floor(self.uniform(*keys) * n))


def uniform_sql(*keys: str) -> str:
    """The same draw as DuckDB SQL; keys are SQL expressions."""
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"((('0x' || substr(md5(concat_ws('|', {text})), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**DIGITS)!r})"


def normal_sql(*keys: str, sigma: float = 1.0, mean: float = 0.0) -> str:
    r, a = uniform_sql(*keys, "'r'"), uniform_sql(*keys, "'a'")
    return f"({mean} + {sigma} * sqrt(-2.0 * ln({r})) * cos({2.0 * math.pi!r} * {a}))"
