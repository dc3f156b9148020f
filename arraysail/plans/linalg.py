"""Decompositions on distributed sufficient statistics.

Rows (id, array) are reduced to sums and products in one pass; only p x p
numbers reach the driver. Beyond ``MOST_FEATURES`` features that would be too
many, and it is an error.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FEATURES = 4096


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def gram(df: DataFrame, x: str, y: str | None = None, keys: tuple[str, ...] = ()) -> dict[tuple, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """{keys: (n, sums of x and y, products of (x, y) with (x, y), first row)} of array columns, in one pass.

    Keys are numbers, strings, booleans or null. Every task sends a row of the product for each of its keys and features,
    these are summed by a shuffle, and the driver gets the sums alone.
    """
    df = df.where(F.col(x).isNotNull() & (F.col(y).isNotNull() if y else F.lit(True)))
    sizes = df.agg(F.max(F.size(x)), F.min(F.size(x)), *([F.max(F.size(y)), F.min(F.size(y))] if y else [])).first()
    if sizes[0] is None:
        return {}
    if sizes[0] != sizes[1] or (y and sizes[2] != sizes[3]):
        raise ValueError("arrays of unequal lengths")
    p, q = sizes[0], sizes[2] if y else 0
    if p + q > MOST_FEATURES:
        raise ValueError(f"{p + q} features; at most {MOST_FEATURES} fit on the driver")
    rows = df.select(F.to_json(F.struct(*keys)).alias("k") if keys else F.lit("{}").alias("k"), F.col(x).cast("array<double>").alias("x"), *([F.col(y).cast("array<double>").alias("y")] if y else []))

    def partial(batches):
        held: dict = {}
        for b in batches:
            z = _matrix(b["x"], p)
            if q:
                z = np.hstack([z, _matrix(b["y"], q)])
            names = b["k"].to_pylist()
            code = {k: i for i, k in enumerate(dict.fromkeys(names))}
            at = np.array([code[k] for k in names])
            for k, i in code.items():
                w = z[at == i]
                n, s, g = held.get(k, (0, 0.0, 0.0))
                held[k] = n + len(w), s + w.sum(0), g + w.T @ w
        for k, (n, s, g) in held.items():
            columns = [pa.array([k] * (p + q)), pa.array(range(p + q), pa.int32()), pa.array([n] * (p + q)), pa.array(s), pa.array(list(g), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "i", "n", "s", "g"])

    schema = "k string, i int, n long, s double, g array<double>"
    parts = rows.mapInArrow(partial, schema)

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = _matrix(table["g"].combine_chunks(), p + q).sum(0)
        columns = [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([sum(table["n"].to_pylist())]), pa.array([float(np.sum(table["s"].to_numpy()))]), pa.array([g], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["k", "i", "n", "s", "g"])

    out: dict = {}
    for r in parts.groupBy("k", "i").applyInArrow(summed, schema).collect():
        k = tuple(map(json.loads(r["k"]).get, keys))
        n, s, g = out.setdefault(k, [0, np.zeros(p + q), np.zeros((p + q, p + q))])
        out[k][0], s[r["i"]], g[r["i"]] = r["n"], r["s"], r["g"]
    return {k: (n, s, g, np.array([p, q])) for k, (n, s, g) in out.items()}


def summed_rows(df: DataFrame, partial, rows: int, width: int) -> np.ndarray:
    """The sum over all tasks of the (rows, width) matrices that ``partial`` makes of a task's batches; added by a shuffle, so the driver gets one."""

    def f(batches):
        m = partial(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows * width), pa.int32()), pa.array(m.ravel())], names=["i", "v"])

    out = np.zeros(rows * width)
    for i, v in df.mapInArrow(f, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out.reshape(rows, width)


def covariance_matrix(n: int, s: np.ndarray, g: np.ndarray, ddof: int = 1) -> np.ndarray:
    return (g - np.outer(s, s) / n) / (n - ddof)


def project(df: DataFrame, column: str, weights: np.ndarray, offset: np.ndarray | None = None, scale: np.ndarray | None = None, out: str = "scores", intercept: np.ndarray | None = None) -> DataFrame:
    """``(x - offset) / scale @ weights + intercept`` of every row by an Arrow function; the weights have a fixed size and go with it."""
    p = weights.shape[0]
    a = weights if scale is None else weights / scale[:, None]
    b = (0 if intercept is None else intercept) - (0 if offset is None else offset @ a)

    def f(x: pa.Array) -> pa.Array:
        z = _matrix(x, p) @ a + b
        return pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))

    return df.withColumn(out, F.arrow_udf(f, "array<double>")(F.col(column).cast("array<double>")))


def flip(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs such that the greatest of each column of ``u`` in size is positive (LIN02)."""
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return u * sign, v * sign


def _eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(values)[::-1]
    return np.maximum(values[order], 0), vectors[:, order]


def _column_signs(scores: DataFrame, column: str) -> np.ndarray:
    """For each component the sign of its greatest score in size, by an aggregate."""
    long = scores.select(F.posexplode(column).alias("k", "v"))
    got = {r["k"]: r["s"] for r in long.groupBy("k").agg(F.signum(F.max_by("v", F.struct(F.abs("v"), "v"))).alias("s")).collect()}
    return np.array([got[k] or 1.0 for k in range(len(got))])


@dataclass
class SVD:
    """x = u diag(s) v'."""

    s: np.ndarray
    v: np.ndarray
    u: DataFrame


def svd(df: DataFrame, column: str, n_components: int | None = None, out: str = "u") -> SVD:
    """Singular values, right vectors, and left ones as a column of the rows (LIN01); signs as in :func:`flip`."""
    ((n, _, g, _),) = gram(df, column).values()
    values, v = _eigen(g)
    k = min(n_components or len(values), n, len(values))
    s = np.sqrt(values[:k])
    v = v[:, :k]
    w = np.where(s > s[0] * 1e-12 if len(s) else False, 1 / np.where(s > 0, s, 1), 0)
    sign = _column_signs(project(df.where(F.col(column).isNotNull()), column, v * w, out=out), out)
    return SVD(s, v * sign, project(df, column, v * w * sign, out=out))


class PCA:
    """Principal components of an array column (LIN03); ``scale`` works on standard scores."""

    def __init__(self, n_components: int | None = None, scale: bool = False):
        self.n_components, self.scale = n_components, scale

    def fit(self, df: DataFrame, column: str) -> PCA:
        ((n, s, g, _),) = gram(df, column).values()
        self.column, self.n_samples, self.mean = column, n, s / n
        c = covariance_matrix(n, s, g)
        self.std = np.sqrt(np.diag(c)) if self.scale else np.ones(len(s))
        self.std[self.std == 0] = 1
        values, v = _eigen(c / np.outer(self.std, self.std))
        k = min(self.n_components or min(n, len(s)), n, len(s))
        self.eigenvalues, self.components = values[:k], v[:, :k]
        sign = _column_signs(self.transform(df.where(F.col(column).isNotNull())), "scores")
        self.components = self.components * sign
        return self

    def transform(self, df: DataFrame, components: list[int] | None = None, out: str = "scores") -> DataFrame:
        v = self.components if components is None else self.components[:, components]
        return project(df, self.column, v, self.mean, self.std, out)

    def inverse_transform(self, df: DataFrame, column: str = "scores", components: list[int] | None = None, out: str = "features") -> DataFrame:
        v = self.components if components is None else self.components[:, components]
        return project(df, column, v.T * self.std, out=out, intercept=self.mean)


class PLSSVD:
    """Singular value decomposition of the cross-covariance of two array columns (LIN04)."""

    def __init__(self, n_components: int | None = None, scale: bool = False):
        self.n_components, self.scale = n_components, scale

    def fit(self, df: DataFrame, x: str, y: str) -> PLSSVD:
        ((n, s, g, (p, _)),) = gram(df, x, y).values()
        c = covariance_matrix(n, s, g)
        sd = np.sqrt(np.diag(c)) if self.scale else np.ones(len(s))
        sd[sd == 0] = 1
        self.x, self.y, self.x_mean, self.y_mean, self.x_std, self.y_std = x, y, s[:p] / n, s[p:] / n, sd[:p], sd[p:]
        u, self.singular_values, vt = np.linalg.svd((c / np.outer(sd, sd))[:p, p:], full_matrices=False)
        k = self.n_components or len(self.singular_values)
        u, v = flip(u[:, :k], vt.T[:, :k])
        self.left, self.right, self.singular_values = u, v, self.singular_values[:k]
        return self

    def transform(self, df: DataFrame, out: tuple[str, str] = ("x_scores", "y_scores")) -> DataFrame:
        return project(project(df, self.x, self.left, self.x_mean, self.x_std, out[0]), self.y, self.right, self.y_mean, self.y_std, out[1])


def remove_top_components(df: DataFrame, column: str, reference: DataFrame, k: int = 32, out: str = "denoised") -> DataFrame:
    """Projects the top eigenvectors of a reference's products out of the rows and centres them again (LIN06)."""
    ((n, s, g, _),) = gram(reference, column).values()
    _, v = _eigen(g)
    v = v[:, :k]
    keep = np.eye(len(v)) - v @ v.T
    ((m, t, _, _),) = gram(df, column).values()
    return project(df, column, keep, offset=t / m, out=out)


class NMF:
    """Non-negative factors by multiplicative updates (LIN05).

    The feature factor is held by the driver; a row's own factor is solved
    where the row is, from that alone, and every epoch is one pass that returns
    k x p and k x k sums. The loss never rises.
    """

    def __init__(self, n_components: int, epochs: int = 200, inner: int = 20, tolerance: float = 1e-6, seed: int = 0):
        self.n_components, self.epochs, self.inner, self.tolerance, self.seed = n_components, epochs, inner, tolerance, seed

    @staticmethod
    def _rows(x: np.ndarray, v: np.ndarray, inner: int) -> np.ndarray:
        u = np.full((len(x), v.shape[1]), max(x.mean(), 1e-12) if x.size else 1.0)
        xv, vv = x @ v, v.T @ v
        for _ in range(inner):
            u *= xv / (u @ vv + 1e-12)
        return u

    def fit(self, df: DataFrame, column: str) -> NMF:
        rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x"))
        p, low = rows.agg(F.max(F.size("x")), F.min(F.array_min("x"))).first()
        if low is not None and low < 0:
            raise ValueError("negative values")
        k, inner = self.n_components, self.inner
        v = np.random.default_rng(self.seed).uniform(0.1, 1, (p, k))
        self.losses: list[float] = []
        rows = rows.persist()
        for _ in range(self.epochs):

            def sums(batches, v=v):
                m = np.zeros((p + k + 1, k))
                for batch in batches:
                    x = _matrix(batch["x"], p)
                    u = self._rows(x, v, inner)
                    m[:p] += x.T @ u
                    m[p : p + k] += u.T @ u
                    m[p + k, 0] += ((x - u @ v.T) ** 2).sum()
                return m

            got = summed_rows(rows, sums, p + k + 1, k)
            a, b = got[:p], got[p : p + k]
            self.losses.append(float(got[p + k, 0]))
            if len(self.losses) > 1 and self.losses[-2] - self.losses[-1] <= self.tolerance * self.losses[-2]:
                break
            for _ in range(5):
                v = v * (a / (v @ b + 1e-12))
        rows.unpersist()
        self.column, self.components = column, v
        return self

    def transform(self, df: DataFrame, out: str = "factors") -> DataFrame:
        v, inner = self.components, self.inner

        def f(x: pa.Array) -> pa.Array:
            u = self._rows(_matrix(x, len(v)), v, 5 * inner)
            return pa.array(list(u), pa.list_(pa.float64()))

        return df.withColumn(out, F.arrow_udf(f, "array<double>")(F.col(self.column).cast("array<double>")))


def random_projection(p: int, k: int, seed: int = 0) -> np.ndarray:
    """Orthonormal columns by QR (PRM01); with k > p there are p of them."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, k)))
    return q * np.sign(np.diag(r))


def hash_sign(feature: Column | str, component: Column | str, seed: int, density: float) -> Column:
    """An entry of a sparse sign matrix from a hash: -1, 0 or 1, never stored (PRM02)."""
    f = F.col(feature) if isinstance(feature, str) else feature
    c = F.col(component) if isinstance(component, str) else component
    h = F.md5(F.concat_ws("-", F.lit(seed), f.cast("string"), c.cast("string")))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return F.when(u < density, sign).otherwise(0.0)


def sparse_projection(spark: SparkSession, cells: DataFrame, keys: list[str], n_features: int, k: int, density: float | None = None, seed: int = 0, feature: str = "feature", value: str = "value") -> DataFrame:
    """(keys, component, value): cells times a sparse matrix of +-1 / sqrt(density k), a coordinate table that is joined (PRM02)."""
    density = n_features**-0.5 if density is None else density
    m = spark.range(n_features).select(F.col("id").alias("__f")).crossJoin(spark.range(k).select(F.col("id").alias("component")))
    m = m.withColumn("__w", hash_sign("__f", "component", seed, density) / F.lit((density * k) ** 0.5)).where("__w <> 0")
    return cells.join(m, cells[feature] == m["__f"]).groupBy(*keys, "component").agg(F.sum(F.col(value) * F.col("__w")).alias(value))
