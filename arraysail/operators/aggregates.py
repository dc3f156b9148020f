"""Counts, moments, correlations and pooling as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraysail.operators.windows import global_position, ordinal_rank


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def count_matrix(df: DataFrame, row: str, column: str, columns: Sequence) -> DataFrame:
    """Counts of two keys, a column for each given value, nought where there are none (AGG02)."""
    return df.groupBy(row).pivot(column, list(columns)).count().fillna(0)


def lists(df: DataFrame, key: str, order: str, value: str, out: str = "values") -> DataFrame:
    """The values of each key in order (AGG03)."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(out))


def noise_ceiling_fraction(df: DataFrame, item: str, most: int = 3) -> DataFrame:
    """(fraction) of noise that is left after averaging the repeats, (r1 + r2/2 + r3/3) / (r1 + r2 + r3) (AGG04)."""
    n = df.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return n.agg((F.sum(1 / F.col("n")) / F.nullif(F.count("*"), F.lit(0))).alias("fraction"))


def noise_ceiling(signal: DataFrame, snr: str, fraction: DataFrame, out: str = "noise_ceiling") -> DataFrame:
    s = _double(snr) * _double(snr)
    return signal.crossJoin(fraction).withColumn(out, s / F.nullif(s + F.col("fraction"), F.lit(0.0))).drop("fraction")


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and both standard deviations (AGG05)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_samp"), F.stddev_pop(value).alias("std_pop"))


def nan_mean(value: Column | str) -> Column:
    v = _double(value)
    return F.avg(F.when(~F.isnan(v), v))


def nan_sum(value: Column | str) -> Column:
    v = _double(value)
    return F.coalesce(F.sum(F.when(~F.isnan(v), v)), F.lit(0.0))


def pool(cells: DataFrame, keys: Sequence[str], value: str = "value", how: str = "max") -> DataFrame:
    """Pools the dimensions that are not in ``keys`` (AGG07)."""
    return cells.groupBy(*keys).agg({"max": F.max, "mean": F.avg}[how](value).alias(value))


def band_pool(cells: DataFrame, keys: Sequence[str], position: str, width: int, odd: bool = False, value: str = "value") -> DataFrame:
    """Max-pools every other band of ``width`` places (AGG08)."""
    band = F.pmod(F.floor(F.col(position) / F.lit(width)), F.lit(2))
    return cells.where(band == int(odd)).groupBy(*keys).agg(F.max(value).alias(value))


def covariance(x: Column | str, y: Column | str) -> Column:
    """Over n - 1 (AGG09)."""
    return F.covar_samp(_double(x), _double(y))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation, null without spread (AGG10); a single aggregate, so partial sums meet in one shuffle."""
    x, y = _double(x), _double(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson_r(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), correction: int = 1) -> DataFrame:
    """(keys, r); with ``correction`` 0 the factor n / (n - 1) of the matched system stays."""
    r = pearson(x, y)
    if correction == 0:
        n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
        r = r * n / F.nullif(n - 1, F.lit(0))
    return df.groupBy(*keys).agg(r.alias("r"))


def pearson_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, r) of named columns, all in one pass over the rows."""
    names = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    wide = df.groupBy(*keys).agg(*[pearson(a, b).alias(f"__{k}") for k, (a, b) in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"__{k}").alias("r")) for k, (a, b) in enumerate(names)])
    return wide.select(*keys, F.inline(cells))


def spearman_r(df: DataFrame, x: str, y: str, ties: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of ordinal ranks; equal values are ranked by ``ties`` (AGG11).

    Without keys the ranks are exact places in pieces of the rows, so no task holds them all.
    """
    keys = list(keys)
    if keys:
        df = ordinal_rank(ordinal_rank(df, keys, x, [ties], "__rx"), keys, y, [ties], "__ry")
    else:
        df = global_position(global_position(df, x, "__rx", [ties]), y, "__ry", [ties])
    return df.groupBy(*keys).agg(pearson("__rx", "__ry").alias("rho"))


def r2(truth: Column | str, prediction: Column | str) -> Column:
    """1 - SSE / SS (AGG12), null without spread."""
    t, p = _double(truth), _double(prediction)
    return 1 - F.sum((t - p) * (t - p)) / F.nullif(F.count(t) * F.var_pop(t), F.lit(0.0))


def r2_score(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(r2(truth, prediction).alias("r2"))


def p_value(null: Column, observed: Column, tail: str = "both") -> Column:
    """Share of the null distribution beyond the observed value, with one added (AGG14).

    ``left`` counts observed >= null, ``right`` observed <= null, as the matched system names them.
    """
    beyond = {"left": observed >= null, "right": observed <= null, "both": F.abs(observed) <= F.abs(null)}[tail]
    return (F.count_if(beyond) + 1) / (F.count("*") + 1)


def mean_square(value: Column | str) -> Column:
    return F.avg(_double(value) * _double(value))


def min_max(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Scales to 0 .. 1 within keys (AGG16); null without spread."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, (F.col(value) - low) / F.nullif(high - low, F.lit(0)))


def layer_mean(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over layers, NaN where one is NaN (AGG17)."""
    return cells.groupBy(*keys).agg(F.avg(value).alias(value))


def linear_cka(x: DataFrame, y: DataFrame, sample: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(cka) of two long tables over the same samples in feature space (AGG13): sums of squared covariances, no sample pairs.

    Where every sample has every feature, and these are few enough for the
    driver, one pass over the samples gives all sums; otherwise features meet in joins.
    """
    from arraysail.plans import linalg

    rows = lambda t, n: t.groupBy(sample).agg(F.transform(F.sort_array(F.collect_list(F.struct(feature, value))), lambda s: s[value].cast("double")).alias(n))
    both = rows(x, "x").join(rows(y, "y"), sample)
    a, b, c, d = both.agg(F.min(F.size("x")), F.max(F.size("x")), F.min(F.size("y")), F.max(F.size("y"))).first()
    if a is not None and a == b and c == d and b + d <= linalg.MOST_FEATURES:
        ((n, s, g, (p, _)),) = linalg.gram(both, "x", "y").values()
        k = linalg.covariance_matrix(n, s, g, 0)
        norm = ((k[:p, :p] ** 2).sum() * (k[p:, p:] ** 2).sum()) ** 0.5
        return x.sparkSession.createDataFrame([(float((k[:p, p:] ** 2).sum() / norm) if norm else None,)], "cka double")

    def crossed(a, b):
        p = a.select(sample, F.col(feature).alias("i"), F.col(value).alias("x")).join(b.select(sample, F.col(feature).alias("j"), F.col(value).alias("y")), sample)
        c = p.groupBy("i", "j").agg(F.covar_pop("x", "y").alias("c"))
        return c.agg(F.sum(F.col("c") * F.col("c")).alias("s"))

    a, b, c = crossed(x, y), crossed(x, x), crossed(y, y)
    joined = a.select(F.col("s").alias("xy")).crossJoin(b.select(F.col("s").alias("xx"))).crossJoin(c.select(F.col("s").alias("yy")))
    return joined.select((F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("cka"))


def centred_kernel(k: DataFrame, i: str = "i", j: str = "j", value: str = "value") -> DataFrame:
    """(i, j, value) of a full symmetric kernel table less its row and column means, plus its grand mean."""
    means = k.groupBy(i).agg(F.avg(value).alias("__m"))
    grand = means.agg(F.avg("__m").alias("__g"))
    a, b = means.select(i, F.col("__m").alias("__a")), means.select(F.col(i).alias(j), F.col("__m").alias("__b"))
    centred = F.col(value) - F.col("__a") - F.col("__b") + F.col("__g")
    return k.join(a, i).join(b, j).crossJoin(grand).select(i, j, centred.alias(value))


def hsic(kx: DataFrame, ky: DataFrame, i: str = "i", j: str = "j", value: str = "value") -> DataFrame:
    """(hsic) of two kernel tables over the same items, tr(KxH KyH) / (n - 1)^2 (AGG13); any kernel will do, but it has a row for each pair."""
    both = centred_kernel(kx, i, j, value).withColumnRenamed(value, "__x").join(centred_kernel(ky, i, j, value).withColumnRenamed(value, "__y"), [i, j])
    n = F.sqrt(F.count("*"))
    return both.agg((F.sum(F.col("__x") * F.col("__y")) / F.nullif((n - 1) * (n - 1), F.lit(0.0))).alias("hsic"))


def cka(kx: DataFrame, ky: DataFrame, i: str = "i", j: str = "j", value: str = "value") -> DataFrame:
    """(cka) of two kernel tables."""
    a, b, c = (hsic(p, q, i, j, value).withColumnRenamed("hsic", n) for p, q, n in ((kx, ky, "__xy"), (kx, kx, "__xx"), (ky, ky, "__yy")))
    return a.crossJoin(b).crossJoin(c).select((F.col("__xy") / F.nullif(F.sqrt("__xx") * F.sqrt("__yy"), F.lit(0.0))).alias("cka"))
