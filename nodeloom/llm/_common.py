"""Plumbing shared by the training-data operators.

Three rules hold everywhere below:

* inputs are read through Spark only, so any path Spark can open works;
* intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
  driver and executors share, so a lost executor loses no finished stage;
* Python sees Arrow batches, which Spark bounds in rows and bytes
  (``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``), never whole partitions.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dirs: list[tuple[SparkSession, str]] = []
_scopes: list[list[Stored]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir`` if the session names one.

    Only where it is unset (single-machine tests) a temporary folder is made, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    for owner, path in _own_dirs:
        if owner is spark:
            return path
    _own_dirs.append((spark, tempfile.mkdtemp(prefix="nodeloom-")))
    return _own_dirs[-1][1]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the JVM is already gone; the folder is the cluster's scratch space
        pass


class Stored:
    """A table written to the shared folder: a cut of the lineage that survives lost executors.

    Within ``scratch()`` it is deleted at the end of the block, unless it is to be kept; then the block
    around that one decides. Without a block it stays until the program ends.
    """

    def __init__(self, df: DataFrame, tag: str, keep: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/nodeloom/{tag}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)
        if len(_scopes) > keep:
            _scopes[-1 - keep].append(self)
        else:
            atexit.register(_delete_at_exit, self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the table; only once nothing will read it again."""
        _delete(self.spark, self.path)


@contextmanager
def scratch():
    """Deletes at its end the tables that were stored in it: for steps whose result is written before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            table.drop()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Stored(df, tag).read()


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` that clash with none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: What this Python worker keeps between tasks, by owner, and what else is to be forgotten with it.
_kept: dict[str, object] = {}
forgets: list[Callable[[], None]] = []
#: Characters of text that a step computes on at a time, if it says nothing else.
HELD = 1 << 23


def worker_cache(owner: str, make: Callable[[], object]):
    """What this Python worker keeps for ``owner`` between tasks. It has one owner at a time."""
    if owner not in _kept:
        release()
        _kept[owner] = make()
    return _kept[owner]


def release() -> None:
    """Gives the memory back that earlier steps have left in this Python worker."""
    if _kept:
        _kept.clear()
        for forget in forgets:
            forget()
        gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(run):
    """``run(batches)`` for a step that keeps nothing, with the worker's memory given back before it."""

    @functools.wraps(run)
    def wrapped(batches):
        release()
        yield from run(batches)

    return wrapped


def in_parts(batch: pa.RecordBatch, column: int, held: int) -> list[pa.RecordBatch]:
    """The rows of ``batch`` in order, in parts of about ``held`` characters of a text column, or one text."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64) + 1)
    cuts = [0, *(np.flatnonzero(np.diff(ends // held)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a or not batch.num_rows]


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list], Sequence]],
    keep: Sequence[str] | None = None,
    held: int | None = HELD,
    caches: bool = False,
) -> DataFrame:
    """``df`` with columns computed from one text column, batch by batch, without a shuffle.

    ``make()`` runs once per task and returns ``f(texts) -> list of columns`` in the order of
    ``fields``. Null texts reach ``f`` as empty strings. ``keep`` names the input columns that
    stay (default: all); a kept column whose name clashes with a new one is replaced by it. Of a batch
    only about ``held`` characters are computed on at a time, or one text; None for the whole batch.
    ``caches``: ``make`` uses a cache of the worker's.
    """
    names = [n for n, _ in fields]
    keep = [c for c in without(df, names) if keep is None or c in keep]
    source = "__nodeloom_text"
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])
    kinds = [_arrow(t) for _, t in fields]

    def run(batches):
        if not caches:
            release()
        f = make()
        for batch in batches if held is None else (part for whole in batches for part in in_parts(whole, len(keep), held)):
            columns = f(["" if x is None else x for x in batch.column(source).to_pylist()])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *arrays], names=[*keep, *names])

    return df.select(*(F.col(quoted(c)) for c in keep), F.col(quoted(text_col)).cast("string").alias(source)).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(id_col: str = "doc_id"):
    """True for rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 5 == 0, F.lit(False))
