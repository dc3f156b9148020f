"""Results kept as parquet, by name and arguments (SNK01-05)."""

from __future__ import annotations

import functools
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODES = ("normal", "readonly", "overwrite", "delete", "ignore")
#: Session settings in place of environment variables.
HOME, MODE = "spark.arraysail.cache.home", "spark.arraysail.cache.mode"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished result is there."""
    fs, _ = _fs(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def replace(spark: SparkSession, df: DataFrame, path: str, **options) -> DataFrame:
    """Writes beside ``path`` and swaps, so a plan may read what it replaces and a failed job leaves the old result.

    The old result is set aside, and put back where the new one can't be moved.
    """
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(beside)
    fs, p = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}-old")
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    there = fs.exists(p)
    if there and not fs.rename(p, aside):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), p):
        if there:
            fs.rename(aside, p)
        raise OSError(f"{beside} could not be moved to {path}")
    if there:
        fs.delete(aside, True)
    return spark.read.parquet(path)


def materialize(spark: SparkSession, make: Callable[[], DataFrame], path: str, mode: str = "normal", compression: str = "snappy") -> DataFrame:
    """``make()`` under a mode.

    normal: read where there is a result, else compute and write; readonly:
    read, or compute without writing; overwrite: compute and replace; delete:
    drop the result and compute; ignore: compute.
    """
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    there = mode in ("normal", "readonly") and exists(spark, path)
    if there:
        return spark.read.parquet(path)
    if mode == "delete":
        delete(spark, path)
    if mode in ("normal", "overwrite"):
        return replace(spark, make(), path, compression=compression)
    return make()


def cached(identifier: str, mode: str | None = None, helper: Callable[[dict], dict] | None = None):
    """Decorator for functions of a session that return a DataFrame; ``{name}`` in the identifier stands for an argument."""

    def wrap(f):
        signature = inspect.signature(f)

        @functools.wraps(f)
        def inner(spark: SparkSession, *args, **kwargs):
            bound = signature.bind(spark, *args, **kwargs)
            bound.apply_defaults()
            named = dict(bound.arguments)
            named = helper(named) if helper else named
            home = spark.conf.get(HOME, None)
            if home is None:
                return f(spark, *args, **kwargs)
            return materialize(spark, lambda: f(spark, *args, **kwargs), f"{home.rstrip('/')}/{identifier.format(**named)}", mode or spark.conf.get(MODE, "normal"))

        return inner

    return wrap


def append(df: DataFrame, path: str, *by: str) -> None:
    """Adds rows to a partitioned result (SNK05)."""
    df.write.mode("append").partitionBy(*by).parquet(path)
