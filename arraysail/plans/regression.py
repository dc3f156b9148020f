"""Regression models on sufficient statistics, splits and cross-validation."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraysail.operators.aggregates import r2
from arraysail.plans.linalg import gram, project, summed_rows


class Regression(Protocol):
    """What cross-validation needs of a model (REG01)."""

    weights: np.ndarray
    intercept: np.ndarray

    def solve(self, n: int, s: np.ndarray, g: np.ndarray, p: int) -> Regression: ...


class _Linear:
    x: str
    y: str

    def fit(self, df: DataFrame, x: str, y: str):
        self.x, self.y = x, y
        ((n, s, g, (p, _)),) = gram(df, x, y).values()
        return self.solve(n, s, g, int(p))

    def predict(self, df: DataFrame, x: str | None = None, out: str = "prediction") -> DataFrame:
        return project(df, x or self.x, self.weights, out=out, intercept=self.intercept)


def _centred(n, s, g, p, intercept=True):
    """(x'x, x'y, y'y, mean of x, mean of y), centred unless there is no intercept."""
    m = s / n if intercept else np.zeros_like(s)
    c = g - n * np.outer(m, m)
    return c[:p, :p], c[:p, p:], c[p:, p:], m[:p], m[p:]


class LinearRegression(_Linear):
    """Least squares, of smallest norm where it is not unique (REG02), or ridge with one penalty or one for each target (REG03)."""

    def __init__(self, fit_intercept: bool = True, l2_penalty: float | np.ndarray | None = None, cutoff: float = 1e-10):
        self.fit_intercept, self.l2_penalty, self.cutoff = fit_intercept, l2_penalty, cutoff

    def solve(self, n, s, g, p):
        xx, xy, _, mx, my = _centred(n, s, g, p, self.fit_intercept)
        values, v = np.linalg.eigh(xx)
        z = v.T @ xy
        good = values > max(values.max(initial=0), 1e-300) * self.cutoff
        penalty = np.broadcast_to(np.asarray(0.0 if self.l2_penalty is None else self.l2_penalty, float), (xy.shape[1],))
        d = np.where(good[:, None], values[:, None] + penalty[None, :], np.inf)
        self.weights = v @ (z / d)
        self.intercept = my - mx @ self.weights if self.fit_intercept else np.zeros(xy.shape[1])
        return self


class RidgeGCV(_Linear):
    """Ridge whose penalty has the least leave-one-out error (REG04).

    The errors ``(y - prediction) / (1 - leverage)`` are summed over the rows by
    one pass for all penalties.
    """

    def __init__(self, penalties=(0.1, 1.0, 10.0), fit_intercept: bool = True):
        self.penalties, self.fit_intercept = tuple(penalties), fit_intercept

    def fit(self, df: DataFrame, x: str, y: str):
        self.x, self.y = x, y
        ((n, s, g, (p, q)),) = gram(df, x, y).values()
        p, q = int(p), int(q)
        xx, xy, _, mx, my = _centred(n, s, g, p, self.fit_intercept)
        values, v = np.linalg.eigh(xx)
        values = np.maximum(values, 0)
        fits = [(v / (values + a)) @ (v.T @ xy) for a in self.penalties]
        level = 1.0 / n if self.fit_intercept else 0.0
        rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
        penalties = self.penalties

        def errors(batches):
            total = np.zeros((len(penalties), q))
            for b in batches:
                z = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - mx
                t = b["y"].flatten().to_numpy(zero_copy_only=False).reshape(-1, q) - my
                zv = z @ v
                for k, (a, w) in enumerate(zip(penalties, fits)):
                    lever = (zv**2 / np.maximum(values + a, 1e-300)).sum(1) + level
                    total[k] += (((t - z @ w) / np.maximum(1 - lever, 1e-12)[:, None]) ** 2).sum(0)
            return total

        self.errors = summed_rows(rows, errors, len(penalties), q) / n
        best = self.errors.argmin(0)
        self.penalty = np.array(penalties)[best]
        self.weights = np.stack([fits[b][:, j] for j, b in enumerate(best)], 1)
        self.intercept = my - mx @ self.weights if self.fit_intercept else np.zeros(q)
        return self


class PLSRegression(_Linear):
    """Partial least squares with deflation, run on the covariances alone (REG05)."""

    def __init__(self, n_components: int = 25, scale: bool = True, most_iterations: int = 500, tolerance: float = 1e-6):
        self.n_components, self.scale, self.most_iterations, self.tolerance = n_components, scale, most_iterations, tolerance

    def solve(self, n, s, g, p):
        xx, xy, yy, mx, my = _centred(n, s, g, p)
        sx, sy = (np.sqrt(np.diag(c) / (n - 1)) if self.scale else np.ones(len(c)) for c in (xx, yy))
        sx[sx == 0], sy[sy == 0] = 1, 1
        a, b = xx / np.outer(sx, sx), xy / np.outer(sx, sy)
        start = b.copy()
        w_, p_, q_ = [], [], []
        for _ in range(min(self.n_components, n - 1, p)):
            if np.abs(b).max(initial=0) < 1e-10 * max(np.abs(start).max(initial=0), 1e-300):
                break
            w = b[:, np.argmax((b**2).sum(0))]
            w = w / np.linalg.norm(w)
            for _ in range(self.most_iterations):
                old, w = w, b @ (b.T @ w)
                w = w / np.linalg.norm(w)
                if ((w - old) ** 2).sum() < self.tolerance**2 or b.shape[1] == 1:
                    break
            # rotate so that scores come from the x that is not deflated
            r = w.copy()
            for pj, rj in zip(p_, w_):
                r = r - (pj @ w) * rj
            tt = r @ a @ r
            if tt <= 1e-12:
                break
            load, target = a @ r / tt, start.T @ r / tt
            b = b - np.outer(load, target) * tt
            w_.append(r)
            p_.append(load)
            q_.append(target)
        self.rotations = np.array(w_).T if w_ else np.zeros((p, 0))
        beta = self.rotations @ np.array(q_) if q_ else np.zeros(start.shape)
        self.weights = beta * sy[None, :] / sx[:, None]
        self.intercept = my - mx @ self.weights
        return self


class SGDLinearRegression(_Linear):
    """Linear model by Adam with L1 and L2 penalties (REG06).

    The gradient of the squared error is a function of the statistics, so every
    epoch sees all rows and none is read again. The rate is cut by five on a plateau, down to 1e-6.
    """

    def __init__(self, l1_penalty: float = 0.0, l2_penalty: float = 0.0, epochs: int = 1000, rate: float = 1e-2, patience: int = 10, tolerance: float = 1e-6, seed: int = 11):
        self.l1_penalty, self.l2_penalty, self.epochs, self.rate, self.patience, self.tolerance, self.seed = l1_penalty, l2_penalty, epochs, rate, patience, tolerance, seed

    def solve(self, n, s, g, p):
        xx, xy, yy, mx, my = (c / n if c.ndim == 2 else c for c in _centred(n, s, g, p))
        w = np.random.default_rng(self.seed).standard_normal(xy.shape) * 0.01
        m, v, rate, best, idle = np.zeros_like(w), np.zeros_like(w), self.rate, np.inf, 0
        self.losses = []
        for t in range(1, self.epochs + 1):
            fit = np.trace(yy) - 2 * (w * xy).sum() + (w * (xx @ w)).sum()
            loss = fit / w.shape[1] + self.l1_penalty * np.abs(w).sum() + self.l2_penalty * (w**2).sum()
            self.losses.append(float(loss))
            if loss < best - self.tolerance * max(abs(best), 1) or not np.isfinite(best):
                best, idle = loss, 0
            else:
                idle += 1
                if idle > self.patience:
                    rate, idle = rate / 5, 0
                    if rate < 1e-6:
                        break
            d = 2 * (xx @ w - xy) / w.shape[1] + self.l1_penalty * np.sign(w) + 2 * self.l2_penalty * w
            m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.intercept = w, my - mx @ w
        return self


def regression(df: DataFrame, x: str, y: str, model, fold: str, test, out: str = "prediction") -> DataFrame:
    """Fits on the rows outside the test fold and predicts those inside (REG07)."""
    return model.fit(df.where(F.col(fold) != test), x, y).predict(df.where(F.col(fold) == test), out=out)


def regression_cv(df: DataFrame, x: str, y: str, make, fold: str = "fold", out: str = "prediction") -> DataFrame:
    """Every row with the prediction of the model that did not see its fold (REG08).

    One pass gives the statistics of all folds; the training set of a fold is
    the total less its own, so nothing is read again for a fit. All fold models
    then predict in one more pass.
    """
    per = gram(df, x, y, (fold,))
    if not per:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    total = [sum(v[i] for v in per.values()) for i in range(3)]
    models = {}
    for (k,), (n, s, g, (p, _)) in per.items():
        m = make()
        m.x, m.y = x, y
        m.solve(total[0] - n, total[1] - s, total[2] - g, int(p))
        models[k] = (m.weights, m.intercept)

    p, q = next(iter(models.values()))[0].shape

    def f(at: pa.Array, z: pa.Array) -> pa.Array:
        # the rows of a fold are one product
        codes = at.to_pylist()
        there = np.array([k in models for k in codes], bool) & z.is_valid().to_numpy(zero_copy_only=False)
        rows, x, out = np.flatnonzero(there), z.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(-1, p), np.zeros((len(z), q))
        mine = [codes[i] for i in rows]
        for k, (w, b) in models.items():
            i = np.array([c == k for c in mine], bool)
            out[rows[i]] = x[i] @ w + b
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, q), pa.int32()), pa.array(out.ravel()), mask=pa.array(~there))

    return df.withColumn(out, F.arrow_udf(f, "array<double>")(fold, F.col(x).cast("array<double>")))


def simple_cv(df: DataFrame, x: str, y: str, fold: str = "fold") -> DataFrame:
    """(fold, r2) of one-feature least squares, in SQL alone: per-fold sums, total less fold, one join back (REG08)."""
    v = df.select(fold, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = {"n": F.count("*").cast("double"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "sxy": F.sum(F.col("x") * F.col("y"))}
    per = v.groupBy(fold).agg(*[e.alias(k) for k, e in sums.items()])
    total = per.agg(*[F.sum(k).alias(f"t{k}") for k in sums])
    n, sx, sy, sxx, sxy = (F.col(f"t{k}") - F.col(k) for k in sums)
    slope = (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
    models = per.crossJoin(total).select(fold, slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept"))
    return v.join(F.broadcast(models), fold).groupBy(fold).agg(r2("y", F.col("x") * F.col("slope") + F.col("intercept")).alias("r2"))


def simple_ridge(df: DataFrame, x: str, y: str, penalty: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slope, intercept) of one feature in closed form (REG02, REG03)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    n = F.count("*")
    slope = n * F.covar_pop(a, b) / F.nullif(n * F.var_pop(a) + F.lit(float(penalty)), F.lit(0.0))
    return df.groupBy(*keys).agg(slope.alias("slope"), F.avg(a).alias("__a"), F.avg(b).alias("__b")).withColumn("intercept", F.col("__b") - F.col("slope") * F.col("__a")).drop("__a", "__b")
