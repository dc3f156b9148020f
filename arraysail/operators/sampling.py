"""Sorting, top-k, splits, permutations and derangements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arraysail.operators.windows import shuffle_key


def top_k(df: DataFrame, k: int, value: str, ties: Sequence[str]) -> DataFrame:
    """The ``k`` largest, ties in order (SRT03); a bounded heap in each task, no full sort."""
    return df.orderBy(F.desc(value), *ties).limit(k)


def head_tail(df: DataFrame, position: str, n: int, head: bool = True) -> DataFrame:
    """Rows before, or from, place ``n`` (SRT05)."""
    return df.where(F.col(position) < n if head else F.col(position) >= n)


#: Rows of a group that one task ranks at most; larger groups are ranked around the place where they are cut.
MOST_IN_TASK = 100_000


def first_of(df: DataFrame, groups: Sequence[str], order: Column, ties: Sequence[str], n: Callable[[Column], Column], name: str = "first") -> DataFrame:
    """Tells in ``name`` whether a row is one of the first ``n(rows of the group)`` of its group in the order of a hash.

    ``order`` is a hash in hexadecimal digits. Where a group has more than
    ``MOST_IN_TASK`` rows, they are counted by the first two digits, and only
    those that share them with the last of the first rows, one of 256, are
    ranked; ``df`` is then read four times.
    """
    spark, within = df.sparkSession, Window.partitionBy(*groups)
    big = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > MOST_IN_TASK)
    found = big.collect()  # at most a row for each MOST_IN_TASK rows of the input
    if not found:
        return df.withColumn(name, F.row_number().over(within.orderBy(order, *ties)) <= n(F.count(F.lit(1)).over(within)))
    kept, names = [c for c in df.columns if c != name], {k: f"__key_{i}" for i, k in enumerate(groups)}
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    df = df.withColumn("__h", order).withColumn("__digits", F.coalesce(F.substring("__h", 1, 2), F.lit("")))
    sizes = df.join(F.broadcast(spark.createDataFrame(found, big.schema).withColumnsRenamed(names)), same).groupBy(*names.values(), "__digits").agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    # a row for each group and two digits
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*names.values()).orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).withColumn("__n", F.least(n(F.col("__n")), F.col("__n")).cast("long"))
    last = F.greatest("__n", F.lit(1))
    cuts = sizes.where((F.col("__before") < last) & (last <= F.col("__before") + F.col("__c")))
    cuts = cuts.select(*names.values(), F.col("__digits").alias("__at"), (F.col("__n") - F.col("__before")).alias("__left"))
    df = df.join(F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema)), same, "left")
    sure = df.where(F.col("__digits") != F.col("__at")).select(*kept, (F.col("__digits") < F.col("__at")).alias(name))
    ranked = df.where(F.col("__at").isNull() | (F.col("__digits") == F.col("__at")))
    place = F.row_number().over(within.orderBy("__h", *ties))
    ranked = ranked.withColumn(name, place <= F.coalesce("__left", n(F.count(F.lit(1)).over(within))))
    return sure.unionByName(ranked.select(*kept, name))


def subsample(df: DataFrame, key: str, draw: Column | str, fraction: float, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``int(fraction n)`` keys of each draw without replacement (SRT06), by the order of a hash."""
    d = F.col(draw) if isinstance(draw, str) else draw
    h = F.md5(F.concat_ws("-", F.lit(seed), F.col("__d").cast("string"), F.col(key).cast("string")))
    df = first_of(df.withColumn("__d", d), ["__d", *by], h, [key], lambda rows: F.floor(rows * F.lit(fraction)), "__first")
    return df.where("__first").drop("__d", "__first")


def permuted(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a seeded random order (SRT07)."""
    return df.orderBy(shuffle_key(key, seed), key)


def derangements(spark: SparkSession, n: int, count: int, seed: int = 0, most_tries: int = 10_000) -> DataFrame:
    """(draw, permutation): distinct permutations of 0 .. n-1 that leave nothing in its place (SRT08, SET06).

    They come in the order of drawing, so none is favoured; an error where
    ``most_tries`` drawings don't give enough of them.
    """
    rng, found = np.random.default_rng(seed), {}
    for _ in range(most_tries):
        if len(found) == count:
            break
        p = rng.permutation(n)
        if not (p == np.arange(n)).any():
            found.setdefault(tuple(p.tolist()), len(found))
    if len(found) < count:
        raise ValueError(f"only {len(found)} derangements of {n} found")
    return spark.createDataFrame([(i, list(p)) for p, i in found.items()], "draw int, permutation array<int>")
