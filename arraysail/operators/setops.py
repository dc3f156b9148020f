"""Unions, intersections, differences and distinct rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat(parts: Mapping[object, DataFrame], key: str | None = None) -> DataFrame:
    """All parts by column name, with the name of each in ``key`` (SET01, SET02)."""
    named = [p if key is None else p.withColumn(key, F.lit(k)) for k, p in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def shared(df: DataFrame, item: str, group: str, n_groups: int | None = None) -> DataFrame:
    """Items that are in every group (SET03); one aggregate, whatever the number of groups."""
    if n_groups is None:
        n_groups = df.select(group).distinct().count()
    return df.groupBy(item).agg(F.count_distinct(group).alias("__n")).where(F.col("__n") == n_groups).select(item)


def shared_repeated(df: DataFrame, item: str, group: str, repetition: str, n_repetitions: int) -> DataFrame:
    """Items that were shown ``n_repetitions`` times in every group (SET03)."""
    n = df.select(group).distinct().count()
    return shared(df.where(F.col(repetition) == n_repetitions - 1), item, group, n)


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` lacks (SET04)."""
    return a.join(b.select(*on), list(on), "left_anti")


def distinct_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows of all parts (SET05, SET06)."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def simulate_errors(df: DataFrame, mean: str, error: str, out: str = "y", ddof: int = 1) -> DataFrame:
    """Three rows for each, whose mean and standard deviation are the given ones (SET07)."""
    k = ((3 - ddof) / 2) ** 0.5
    return df.withColumn("__k", F.explode(F.array(F.lit(-k), F.lit(0.0), F.lit(k)))).withColumn(out, F.col(mean) + F.col("__k") * F.col(error)).drop("__k")


def is_subset(a: DataFrame, b: DataFrame, on: Sequence[str]) -> bool:
    """Whether ``b`` holds every key of ``a`` (SET08)."""
    return a.join(b, list(on), "left_anti").isEmpty()
