"""Selection by label, masks and missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_labels(df: DataFrame, coord: str, values: Sequence | DataFrame, exclude: bool = False) -> DataFrame:
    """Rows whose coordinate is (or, with ``exclude``, is not) among the values (FLT01).

    Literals become a predicate that reaches the scan. A table becomes a semi
    or anti join, which keeps rows with a null coordinate on exclusion.
    """
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("__v"))
        return df.join(v, F.col(coord) == F.col("__v"), "left_anti" if exclude else "left_semi")
    inside = F.col(coord).isin(list(values))
    return df.where(~F.coalesce(inside, F.lit(False)) if exclude else inside)


def mask_rows(df: DataFrame, *masks: tuple[DataFrame, Sequence[str], str]) -> DataFrame:
    """Rows for which every mask (table, keys, boolean column) is true (FLT02, FLT03)."""
    for table, keys, name in masks:
        df = df.join(table.where(F.col(name)).select(*keys).distinct(), list(keys), "left_semi")
    return df


def all_of(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Keys for which the condition holds in every row (FLT04)."""
    return df.groupBy(*keys).agg(F.bool_and(condition).alias("__ok")).where("__ok").drop("__ok")


def selector(choices: Sequence[Mapping[str, object]]) -> Column:
    """True where all entries of at least one of the mappings hold (FLT05)."""
    one = [reduce(and_, [F.col(k) == F.lit(v) for k, v in c.items()], F.lit(True)) for c in choices]
    return reduce(or_, one, F.lit(False))


def any_of(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Whether the condition holds in some row of each key."""
    return df.groupBy(*keys).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias("selected"))


def drop_prefixed(df: DataFrame, column: str, prefix: str, sep: str = "_") -> DataFrame:
    """Without the rows whose first token begins with ``prefix`` (FLT06)."""
    token = F.split(F.col(column), sep)[0]
    return df.where(~F.coalesce(F.startswith(token, F.lit(prefix)), F.lit(False)))


def drop_sentinel(df: DataFrame, column: str, sentinel) -> DataFrame:
    """Without the rows that hold the sentinel (FLT07)."""
    return df.where(F.col(column) != F.lit(sentinel))


def missing(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return v.isNull() | F.isnan(v.cast("double"))


def drop_missing(cells: DataFrame, keys: Sequence[str], value: str = "value", how: str = "any") -> DataFrame:
    """Without the keys that have any, or only, missing values (FLT08)."""
    if how not in ("any", "all"):
        raise ValueError(f"how is any or all, not {how}")
    agg = F.bool_or if how == "any" else F.bool_and
    bad = cells.groupBy(*keys).agg(agg(missing(value)).alias("__bad")).where("__bad").drop("__bad")
    return cells.join(bad, list(keys), "left_anti")


def columns_with(df: DataFrame, part: str, count: int | None = None) -> list[str]:
    """Names that contain ``part``; an error where there are not ``count`` of them (FLT09)."""
    got = [c for c in df.columns if part in c]
    if count is not None and len(got) != count:
        raise ValueError(f"{len(got)} columns contain {part!r}, not {count}")
    return got


def nonzero(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Coordinates of the cells that are not nought (FLT10)."""
    return df.unpivot(list(keys), list(values), name, value).where(F.col(value) != 0)


def drop_zero_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose greatest value is above nought (FLT11)."""
    return df.groupBy(*keys).agg(F.max(value).alias(value)).where(F.col(value) > 0)


def label_masks(volume: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """The cells of each labelled region (FLT12)."""
    return volume.join(labels, on)


def in_bounds(value: Column | str, low: float, high: float) -> Column:
    """Finite and within bounds (FLT13)."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & v.between(low, high), F.lit(False))
