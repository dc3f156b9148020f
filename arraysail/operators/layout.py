"""Row form (id, features ARRAY), long form (id, feature, value) and flat ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, array: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """A row for each element; all other columns stay."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias(feature, "__v")).select(*rest, feature, F.col("__v").cast("double").alias(value))


def to_rows(df: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "value", array: str = "features") -> DataFrame:
    """One array for each key, ordered by feature."""
    got = F.sort_array(F.collect_list(F.struct(feature, value)))
    return df.groupBy(*keys).agg(F.transform(got, lambda s: s[value]).alias(array))


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def flat_id(sizes: Sequence[int], *coords: Column | str) -> Column:
    """Row-major number of a cell of a grid (PRJ04)."""
    coords = [F.col(c) if isinstance(c, str) else c for c in coords]
    return reduce(lambda a, cs: a * F.lit(cs[1]) + cs[0], zip(coords[1:], sizes[1:]), coords[0].cast("long"))


def unravel(flat: Column | str, sizes: Sequence[int]) -> list[Column]:
    """Coordinates of a flat id (PRJ05)."""
    x = F.col(flat) if isinstance(flat, str) else flat
    out = []
    for s in reversed(sizes[1:]):
        out.append(F.pmod(x, F.lit(s)))
        x = F.floor(x / F.lit(s)).cast("long")
    return [x, *reversed(out)]


def div_mod(number: Column | str, size: int, base: int = 1) -> tuple[Column, Column]:
    """(group, place) of a number that counts from ``base`` (PRJ06)."""
    x = (F.col(number) if isinstance(number, str) else number) - F.lit(base)
    return F.floor(x / F.lit(size)).cast("long"), F.pmod(x, F.lit(size))


def run_label(trial: Column | str, pair: int = 125, first: int = 63) -> Column:
    """Number of the run of a trial where runs of ``first`` and ``pair - first`` trials alternate (PRJ07)."""
    t = F.col(trial) if isinstance(trial, str) else trial
    return (F.floor(t / F.lit(pair)) * 2 + F.when(F.pmod(t, F.lit(pair)) >= first, 1).otherwise(0)).cast("long")


def flatten_dims(df: DataFrame, dims: Sequence[str], sizes: dict[str, int], out: str = "feature") -> DataFrame:
    """Several dimensions as one, in the sorted order of their names (PRJ04)."""
    dims = sorted(dims)
    return df.withColumn(out, flat_id([sizes[d] for d in dims], *dims)).drop(*dims)


def dense_grid(cells: DataFrame, axes: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Every combination of the axes, with the cells where there are any (PRJ08); axes are small, cells are not broadcast."""
    grid = reduce(lambda a, b: a.crossJoin(b), axes)
    return grid.join(cells, list(on), "left")


def cross(*axes: DataFrame) -> DataFrame:
    """All combinations of small axes (JN09)."""
    return reduce(lambda a, b: a.crossJoin(b), axes)


def relabel(df: DataFrame, names: dict[str, str] | None = None, constants: dict[str, object] | None = None, types: dict[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Renames, adds constant coordinates, casts, drops (PRJ01, PRJ02)."""
    df = df.withColumnsRenamed(names or {})
    df = df.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})
    df = df.withColumns({k: F.col(k).try_cast(t) for k, t in (types or {}).items()})
    return df.drop(*drop)


def swap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Transposes long form (PRJ03)."""
    return df.select(*[F.col(c).alias({a: b, b: a}.get(c, c)) for c in df.columns])


def upper_triangle(pairs: DataFrame, i: str = "i", j: str = "j", k: int = 1) -> DataFrame:
    """Cells at least ``k`` above the diagonal (ARR02)."""
    return pairs.where(F.col(j) - F.col(i) >= k)


def diagonal(pairs: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    return pairs.where(F.col(i) == F.col(j))
