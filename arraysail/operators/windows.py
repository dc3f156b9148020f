"""Order-dependent operators. Every order must be total; none needs all rows in one partition."""

from __future__ import annotations

import math
import os.path
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraysail.errors import MissingValueError
from arraysail.operators.select import missing


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Pieces that a table is cut into at most to number its rows.
MOST_PIECES = 4096


def _pieces(df: DataFrame, key: str, piece: str) -> DataFrame:
    """``df`` with a number or text in ``piece`` that never falls as ``key`` rises, for pieces of about equal size."""
    kind = df.schema[key].dataType.simpleString()
    if kind == "string":
        # the first characters after those that all keys share
        low, high = df.agg(F.min(key), F.max(key)).first()
        same = len(os.path.commonprefix([low, high])) if low is not None else 0
        return df.withColumn(piece, F.coalesce(F.substring(key, 1, same + 3), F.lit("")))
    x = F.col(key).cast("timestamp").cast("double") if kind.startswith("timestamp") or kind == "date" else F.col(key).cast("double")
    df = df.withColumn("__x", x)
    n = min(MOST_PIECES, max(2, 4 * df.sparkSession.sparkContext.defaultParallelism))
    bounds = df.agg(F.percentile_approx("__x", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted({b for b in bounds if math.isfinite(b)})
    if not bounds:
        return df.drop("__x").withColumn(piece, F.when(F.col(key).isNull(), 0).otherwise(1))
    # binary search in the JVM; NaN goes last, as it sorts
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__x", outputCol="__b", handleInvalid="keep").transform(df)
    return cut.withColumn(piece, F.when(F.col(key).isNull(), -1.0).otherwise(F.col("__b"))).drop("__x", "__b")


def global_position(df: DataFrame, key: Column | str, name: str = "pos", ties: Sequence[str] = ()) -> DataFrame:
    """The 0-based place of each row in the order of ``key`` and ``ties``, exactly, without a single-partition window.

    Numeric and time keys are cut at approximate quantiles, strings by the
    first characters that tell them apart; rows are numbered inside the pieces
    and the sizes of the pieces before are added. Nulls come first, NaN last.
    Rows of one key value are in one piece.
    """
    df = _pieces(df.withColumn("__k", _column(key)), "__k", "__p")
    sizes = df.groupBy("__p").agg(F.count("*").alias("__n"))
    # a row for each piece
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__k", *ties)) - 1
    return df.withColumn("__i", place).join(before.select("__p", "__before"), "__p").withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).drop("__k", "__p", "__i", "__before")


def occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "repetition") -> DataFrame:
    """How often the keys came up before, from 0 (WIN01)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def ordinal_rank(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """0-based ordinal rank (WIN02); equal values are told apart by ``ties``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(value, *ties)) - 1)


def _guard(df: DataFrame, value: str, nan_policy: str) -> DataFrame:
    if nan_policy not in ("omit", "propagate", "raise"):
        raise ValueError(f"no such policy: {nan_policy}")
    if nan_policy == "raise" and not df.where(missing(value)).isEmpty():
        raise MissingValueError(f"{value} contains NaN")
    return df


#: Groups whose statistics are broadcast at most.
MOST_GROUPS = 1_000_000


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], few_groups: bool = False) -> DataFrame:
    """Adds plain aggregates of the keys to every row.

    By a window as a rule: one shuffle, but a group is in one task. With
    ``few_groups`` they are aggregated, which combines before the shuffle and so
    bears hot keys, and joined back: by broadcast up to ``MOST_GROUPS`` groups,
    which are counted, beyond that as the planner chooses.
    """
    if not few_groups:
        w = Window.partitionBy(*keys)
        return df.withColumns({k: e.over(w) for k, e in stats.items()})
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    g = df.groupBy(*keys).agg(*[e.alias(k) for k, e in stats.items()]).withColumnsRenamed(names)
    if g.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS:
        g = F.broadcast(g)
    return df.join(g, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()], "left").drop(*names.values())


def _mean(value: str, nan_policy: str) -> Column:
    v = F.col(value).cast("double")
    return F.avg(F.when(~F.isnan(v), v)) if nan_policy == "omit" else F.avg(v)


def center(df: DataFrame, keys: Sequence[str], value: str = "value", nan_policy: str = "propagate", out: str | None = None, few_groups: bool = False) -> DataFrame:
    """Values less the mean of their keys (WIN04)."""
    df = with_group_stats(_guard(df, value, nan_policy), keys, {"__m": _mean(value, nan_policy)}, few_groups)
    return df.withColumn(out or value, F.col(value) - F.col("__m")).drop("__m")


def z_score(df: DataFrame, keys: Sequence[str], value: str = "value", correction: int = 1, nan_policy: str = "propagate", out: str | None = None, few_groups: bool = False) -> DataFrame:
    """Standard scores within keys (WIN03, WIN05).

    With ``omit`` the mean skips NaN, but the divisor counts them, as the
    system does whose results these match. No spread gives null.
    """
    v = F.col(value).cast("double")
    df = with_group_stats(_guard(df, value, nan_policy), keys, {"__m": _mean(value, nan_policy), "__n": F.count(F.lit(1)) if nan_policy == "omit" else F.count(v)}, few_groups)
    d = v - F.col("__m")
    df = with_group_stats(df, keys, {"__s": F.sum(F.when(~F.isnan(v), d * d) if nan_policy == "omit" else d * d)}, few_groups)
    sd = F.sqrt(F.col("__s") / F.nullif(F.col("__n") - correction, F.lit(0)))
    return df.withColumn(out or value, (v - F.col("__m")) / F.nullif(sd, F.lit(0.0))).drop("__m", "__n", "__s")


def scale_by(df: DataFrame, keys: Sequence[str], value: str, divisor: float, zscore: bool = True, out: str | None = None) -> DataFrame:
    """Session scores (population spread), or values over a constant (WIN03)."""
    return z_score(df, keys, value, 0, out=out) if zscore else df.withColumn(out or value, F.col(value) / F.lit(divisor))


def z_score_by(df: DataFrame, reference: DataFrame, keys: Sequence[str], value: str = "value", epsilon: float = 1e-6, out: str | None = None) -> DataFrame:
    """Scores by the mean and population spread of another table (WIN06)."""
    stats = reference.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(stats, list(keys)).withColumn(out or value, (F.col(value) - F.col("__m")) / (F.col("__s") + F.lit(epsilon))).drop("__m", "__s")


def sliding_mean(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: int | float, step: int, value: str = "value", out: str = "mean", position: str = "pos") -> DataFrame:
    """Means of ``size`` rows from every ``step``-th on (WIN07); the last are of the rows that are left.

    A fraction is a share of the rows of the keys. Every window begins inside
    the rows and is named after its first one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn(position, F.row_number().over(w) - 1)
    if isinstance(size, float):
        if not 0 < size <= 1:
            raise ValueError("a fraction is above 0 and at most 1")
        n = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) * F.lit(size)), F.lit(1))
        total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        df = df.withColumn("__n", n.cast("long")).withColumn("__c", total)
        ends = df.select(*keys, (F.col(position)).alias("__e"), F.col("__c").alias("__ce"))
        last = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1
        df = df.withColumn("__e", F.least(F.col(position) + F.col("__n") - 1, last)).where(F.pmod(F.col(position), F.lit(step)) == 0)
        df = df.join(ends, [*keys, "__e"])
        return df.withColumn(out, (F.col("__ce") - F.col("__c") + F.col(value)) / (F.col("__e") - F.col(position) + 1)).drop("__n", "__c", "__e", "__ce")
    return df.withColumn(out, F.avg(value).over(w.rowsBetween(0, size - 1))).where(F.pmod(F.col(position), F.lit(step)) == 0)


def group_offset(df: DataFrame, group: str, order: str, offset: float, value: str | None = None, multiply: bool = False, out: str = "offset") -> DataFrame:
    """Centred offsets of the groups in the order in which they first come up, added to (or multiplied with) ``value`` (WIN08).

    Only the groups are ranked, not the rows.
    """
    first = df.groupBy(group).agg(F.min(order).alias("__first"))
    n = first.count()
    place = F.row_number().over(Window.orderBy("__first", group)) - 1
    ranked = first.select(F.col(group).alias("__g"), ((place - (n - 1) / 2) * F.lit(float(offset))).alias("__o"))
    df = df.join(F.broadcast(ranked) if n <= MOST_GROUPS else ranked, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    shift = F.col("__o") if value is None else F.col(value) * (1 + F.col("__o")) if multiply else F.col(value) + F.col("__o")
    return df.withColumn(out, shift).drop("__o")


def shuffle_key(column: Column | str, seed: int) -> Column:
    """A hash whose order is a seeded permutation, the same in any partitioning (SRT07)."""
    return F.md5(F.concat(F.lit(f"{seed}-"), _column(column).cast("string")))


def folds(df: DataFrame, key: str, n_folds: int, shuffle: bool = True, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds of equal size, the first ones a row larger (WIN09); exact and without a window over all rows."""
    n = df.count()
    df = global_position(df, shuffle_key(key, seed) if shuffle else F.col(key), "__pos", [key])
    size, more = divmod(n, n_folds)
    big = F.lit(more * (size + 1))
    p = F.col("__pos")
    fold = F.when(p < big, F.floor(p / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((p - big) / F.lit(max(size, 1))))
    return df.withColumn(name, fold.cast("int")).drop("__pos")


def stratified_folds(df: DataFrame, key: str, label: str, n_folds: int, shuffle: bool = True, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds inside each label (WIN10)."""
    order = [shuffle_key(key, seed), F.col(key)] if shuffle else [F.col(key)]
    return df.withColumn(name, F.ntile(n_folds).over(Window.partitionBy(label).orderBy(*order)) - 1)


def dominant_sign(cells: DataFrame, component: str, value: str, order: str) -> DataFrame:
    """The sign of the cell of greatest size in each component (WIN11); of equals the first."""
    top = F.max_by(F.col(value), F.struct(F.abs(value), -F.col(order)))
    return cells.groupBy(component).agg(F.signum(top).alias("sign"))


def first_above(cells: DataFrame, column: str, value: str, epsilon: float = 1e-12):
    """The first column with a value beyond ``epsilon`` in size, None without one (WIN12)."""
    return cells.where(F.abs(value) > epsilon).agg(F.min(column)).first()[0]
