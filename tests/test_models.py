"""Models against numpy on seeded arrays: the shapes, penalties and tolerances of the studied tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraysail.plans import linalg as M
from arraysail.plans import regression as R


def frame(spark, x, y=None, **more):
    names = ["id", "x"] + (["y"] if y is not None else []) + list(more)
    rows = [(i, x[i].tolist(), *([y[i].tolist()] if y is not None else []), *(m[i].item() for m in more.values())) for i in range(len(x))]
    kinds = "id long, x array<double>" + (", y array<double>" if y is not None else "") + "".join(f", {k} int" for k in more)
    assert names
    return spark.createDataFrame(rows, kinds).repartition(3)


def column(df, name):
    return np.array([r[name] for r in df.orderBy("id").select(name).collect()])


@pytest.mark.parametrize("shape", [(100, 10), (20, 20), (10, 100), (100, 1), (2, 10)])
@pytest.mark.parametrize("fraction", [0.5, None])
def test_pca(spark, shape, fraction):
    n, p = shape
    x = np.random.default_rng(0).random(shape)
    k = None if fraction is None else max(1, int(fraction * min(n - 1, p)))
    df = frame(spark, x)
    m = M.PCA(k).fit(df, "x")
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    k = len(m.eigenvalues)
    assert m.eigenvalues == pytest.approx((s**2 / (n - 1))[:k], abs=1e-10)
    good = m.eigenvalues > 1e-9
    scores = column(m.transform(df), "scores")
    assert np.abs(scores[:, good]) == pytest.approx(np.abs(centred @ vt.T)[:, :k][:, good], abs=1e-6)
    assert (scores.max(0) >= -scores.min(0) - 1e-9)[good].all()  # of two rows both are as far out
    back = column(m.inverse_transform(m.transform(df)), "features")
    if fraction is None:
        assert back == pytest.approx(x, abs=1e-6)


def test_pca_of_scores(spark):
    x = np.random.default_rng(1).random((60, 5)) * [1, 10, 100, 1, 0]
    df = frame(spark, x)
    m = M.PCA(scale=True).fit(df, "x")
    sd = x.std(0, ddof=1)
    sd[sd == 0] = 1
    want = np.sort(np.linalg.eigvalsh(np.cov(((x - x.mean(0)) / sd).T)))[::-1]
    assert m.eigenvalues == pytest.approx(np.maximum(want, 0), abs=1e-10)
    assert column(m.inverse_transform(m.transform(df)), "features") == pytest.approx(x, abs=1e-8)


def test_svd(spark):
    x = np.random.default_rng(2).normal(size=(50, 6))
    got = M.svd(frame(spark, x), "x")
    u = column(got.u, "u")
    assert (u * got.s) @ got.v.T == pytest.approx(x, abs=1e-8)
    assert got.s == pytest.approx(np.linalg.svd(x, compute_uv=False))
    assert (u[np.abs(u).argmax(0), range(6)] > 0).all()


def test_gram_by_keys(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    k = np.arange(40) % 3
    got = M.gram(frame(spark, x, k=k), "x", keys=("k",))
    for i in range(3):
        n, s, g, _ = got[(i,)]
        w = x[k == i]
        assert n == len(w) and s == pytest.approx(w.sum(0)) and g == pytest.approx(w.T @ w)
    with pytest.raises(ValueError):
        M.gram(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"), "x")
    assert M.gram(spark.createDataFrame([], "x array<double>"), "x") == {}


def test_plssvd(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 5)), rng.normal(size=(80, 3))
    m = M.PLSSVD().fit(frame(spark, x, y), "x", "y")
    c = (x - x.mean(0)).T @ (y - y.mean(0)) / 79
    assert m.singular_values == pytest.approx(np.linalg.svd(c, compute_uv=False))
    out = m.transform(frame(spark, x, y))
    a, b = column(out, "x_scores"), column(out, "y_scores")
    assert np.diag(a.T @ b / 79) == pytest.approx(m.singular_values)


def test_nmf_loss_falls_and_reconstructs(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 3)) @ rng.random((3, 8))
    m = M.NMF(3, epochs=40).fit(frame(spark, x), "x")
    assert all(b <= a * (1 + 1e-6) for a, b in zip(m.losses, m.losses[1:]))
    u = column(m.transform(frame(spark, x)), "factors")
    assert (u >= 0).all() and np.abs(u @ m.components.T - x).mean() < 0.05
    with pytest.raises(ValueError):
        M.NMF(2).fit(frame(spark, -x), "x")


def test_projections(spark):
    w = M.random_projection(10, 4, 1)
    assert w.T @ w == pytest.approx(np.eye(4), abs=1e-12) and M.random_projection(3, 9).shape == (3, 3)
    x = np.random.default_rng(6).normal(size=(40, 12))
    df = frame(spark, x)
    got = column(M.remove_top_components(df, "x", df, 3), "denoised")
    assert np.linalg.matrix_rank(got, tol=1e-8) == 9 and got.mean(0) == pytest.approx(np.zeros(12), abs=1e-10)


@pytest.mark.parametrize("n", [5, 50])
@pytest.mark.parametrize("p", [1, 10, 100])
@pytest.mark.parametrize("intercept", [True, False])
def test_regression(spark, n, p, intercept):
    rng = np.random.default_rng(0)
    x, beta = rng.random((n, p)), rng.random((p, 5))
    y = x @ beta + 0.05 * rng.random((n, 5))
    new = rng.random((20, p))
    df = frame(spark, x, y)
    ((count, s, g, _),) = M.gram(df, "x", "y").values()
    for penalty in (None, 0, 0.1, 1, 10, np.array([0.1, 1, 2, 3, 4])):
        m = R.LinearRegression(intercept, penalty).solve(count, s, g, p)
        mx, my = (x.mean(0), y.mean(0)) if intercept else (np.zeros(p), np.zeros(5))
        a, b = x - mx, y - my
        if penalty is None or np.ndim(penalty) == 0 and penalty == 0:
            want = np.linalg.lstsq(a, b, rcond=1e-8)[0]
        else:
            want = np.stack([np.linalg.solve(a.T @ a + np.eye(p) * v, a.T @ b[:, k]) for k, v in enumerate(np.broadcast_to(penalty, 5))], 1)
        assert new @ m.weights + m.intercept == pytest.approx((new - mx) @ want + my, abs=1e-3)
        assert m.weights == pytest.approx(want, abs=1e-3)


def test_predictions_and_folds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x @ rng.normal(size=(4, 2)) + 1 + 0.1 * rng.normal(size=(60, 2))
    fold = np.arange(60) % 5
    df = frame(spark, x, y, fold=fold)
    got = column(R.regression_cv(df, "x", "y", R.LinearRegression), "prediction")
    one = R.regression(df, "x", "y", R.LinearRegression(), "fold", 2)
    want = np.empty_like(y)
    for k in range(5):
        t = fold != k
        a = np.c_[np.ones(t.sum()), x[t]]
        want[~t] = np.c_[np.ones((~t).sum()), x[~t]] @ np.linalg.lstsq(a, y[t], rcond=None)[0]
    assert got == pytest.approx(want, abs=1e-8)
    assert column(one, "prediction") == pytest.approx(want[fold == 2], abs=1e-8)


def test_ridge_leave_one_out(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(25, 6)), rng.normal(size=(25, 2))
    m = R.RidgeGCV((0.1, 5.0)).fit(frame(spark, x, y), "x", "y")
    for k, a in enumerate((0.1, 5.0)):
        errors = np.zeros(2)
        for i in range(25):
            t = np.arange(25) != i
            # the intercept is not penalised
            z = np.c_[np.ones(24), x[t]]
            w = np.linalg.solve(z.T @ z + np.diag([0] + [a] * 6), z.T @ y[t])
            errors += (y[i] - np.r_[1, x[i]] @ w) ** 2
        assert m.errors[k] == pytest.approx(errors / 25)


def test_pls(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(50, 3))
    m = R.PLSRegression(6, tolerance=1e-12).fit(frame(spark, x, y), "x", "y")
    z = np.c_[np.ones(50), x]
    assert column(m.predict(frame(spark, x, y)), "prediction") == pytest.approx(z @ np.linalg.lstsq(z, y, rcond=None)[0], abs=1e-5)  # all components: least squares
    one = R.PLSRegression(1, scale=False).fit(frame(spark, x, y[:, :1]), "x", "y")
    a, b = x - x.mean(0), y[:, :1] - y[:, :1].mean(0)
    w = a.T @ b / np.linalg.norm(a.T @ b)
    t = a @ w
    assert one.weights == pytest.approx(w * (t.T @ b) / (t.T @ t))
    scores = (x - x.mean(0)) / x.std(0, ddof=1) @ m.rotations
    assert scores.T @ scores - np.diag(np.diag(scores.T @ scores)) == pytest.approx(np.zeros((6, 6)), abs=1e-6)


def test_sgd_nears_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 4))
    y = x @ rng.normal(size=(4, 2))
    df = frame(spark, x, y)
    m = R.SGDLinearRegression().fit(df, "x", "y")
    assert m.weights == pytest.approx(R.LinearRegression().fit(df, "x", "y").weights, abs=0.02) and m.losses[-1] < m.losses[0]
    sparse = R.SGDLinearRegression(l1_penalty=10).fit(df, "x", "y")
    assert np.abs(sparse.weights).sum() < np.abs(m.weights).sum()


def test_fits_skip_nulls(spark):
    df = spark.createDataFrame([(0, [1.0], [2.0]), (1, None, [3.0]), (2, [2.0], None), (3, [2.0], [4.0]), (4, [3.0], [6.0])], "id long, x array<double>, y array<double>")
    assert R.LinearRegression().fit(df, "x", "y").weights == pytest.approx(np.array([[2.0]]))
    assert df.select(F.count("*")).first()[0] == 5
