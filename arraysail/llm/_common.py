"""What the text operators share: checkpoints, memo tables, column guards."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only where none is named, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"arraysail-{uuid.uuid4().hex}"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder and cuts its lineage; a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Memo(dict):
    """A dictionary that computes what it misses and empties itself at ``limit`` entries."""

    def __init__(self, compute, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def slices(texts, chars: int = 2_000_000):
    """(first, last) ranges of a list of texts of about ``chars`` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array, size: int = 4_000_000):
    """(first, last, texts) ranges of a column of about ``size`` bytes each, nulls as empty texts.

    A batch is never all Python strings at once, and what a slice needed goes
    back to the system before the next one.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield start, stop, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop
        _trim()


def by_slices(column: pa.Array, f, size: int = 4_000_000) -> list:
    """``f`` of the texts of each slice, all results in one list."""
    return [x for _, _, texts in text_slices(column, size) for x in f(texts)]


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def one_label(labels: DataFrame, column: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` labelled documents (id, label), one row each, picked by a hash of the id.

    Rows with a null id or label are left out; where labels of one document
    disagree, the lower holds.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min(column).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id")
        .limit(limit)
    )
