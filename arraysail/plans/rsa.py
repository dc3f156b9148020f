"""Representational similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.operators.aggregates import p_value, pearson, spearman_r
from arraysail.operators.joins import pairs
from arraysail.operators.sampling import subsample


def rsm(cells: DataFrame, item: str, feature: str = "feature", value: str = "value", raw: bool = True) -> DataFrame:
    """(i, j, r) for i < j: correlations of items over features (RSA01).

    Quadratic in the items: aggregate rows to conditions first. With ``raw`` the
    factor n / (n - 1) of the matched system stays.
    """
    p = pairs(cells, item, feature, value)
    r = pearson("x", "y")
    if raw:
        r = r * F.count("*") / F.nullif(F.count("*") - 1, F.lit(0))
    return p.groupBy("i", "j").agg(r.alias("r"))


def clean_rsm(cells: DataFrame, items: DataFrame, i: str = "i", j: str = "j", r: str = "r") -> DataFrame:
    """The upper triangle of chosen items, noughts as nulls (ARR03)."""
    k = items.columns[0]
    a = cells.join(items.select(F.col(k).alias(i)), i, "left_semi").join(items.select(F.col(k).alias(j)), j, "left_semi")
    return a.where(F.col(i) < F.col(j)).select(i, j, F.nullif(F.col(r), F.lit(0.0)).alias(r))


def rsa_correlation(x: DataFrame, y: DataFrame, correlation: str = "pearson") -> DataFrame:
    """(r) of two triangles (RSA02)."""
    both = x.select("i", "j", F.col("r").alias("x")).join(y.select("i", "j", F.col("r").alias("y")), ["i", "j"])
    if correlation == "spearman":
        both = both.withColumn("__id", F.struct("i", "j"))
        return spearman_r(both, "x", "y", "__id").select(F.col("rho").alias("r"))
    return both.agg(pearson("x", "y").alias("r"))


def rsa_resampled(spark: SparkSession, x: DataFrame, y: DataFrame, items: DataFrame, n_draws: int = 5000, fraction: float = 0.9, seed: int = 0) -> DataFrame:
    """(draw, r) over subsets of the items drawn without replacement (RSA02); draws are spread over tasks."""
    k = items.columns[0]
    chosen = subsample(items.select(F.col(k).alias("__k")).crossJoin(spark.range(n_draws).select(F.col("id").cast("int").alias("draw"))), "__k", "draw", fraction, seed=seed)
    both = x.select("i", "j", F.col("r").alias("x")).join(y.select("i", "j", F.col("r").alias("y")), ["i", "j"])
    a, b = chosen.select("draw", F.col("__k").alias("i")), chosen.select("draw", F.col("__k").alias("j"))
    return both.join(a, "i").join(b, ["draw", "j"]).groupBy("draw").agg(pearson("x", "y").alias("r"))


def permutation_test(null: DataFrame, observed: DataFrame, value: str, tail: str = "both") -> DataFrame:
    """(p) of one observed value against a table of null values (AGG14)."""
    return null.crossJoin(observed.select(F.col(observed.columns[0]).alias("__o"))).agg(p_value(F.col(value), F.col("__o"), tail).alias("p"))
