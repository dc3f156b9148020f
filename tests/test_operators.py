"""Guards, error paths and cases that the query catalogue doesn't reach."""

import math
from itertools import product

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from arraysail import queries as core
from arraysail.errors import LabelError, MissingValueError
from arraysail.functions import filters as G
from arraysail.functions import scalar as S
from arraysail.operators import aggregates as A
from arraysail.operators import joins as J
from arraysail.operators import layout as L
from arraysail.operators import sampling as P
from arraysail.operators import select as X
from arraysail.operators import setops as U
from arraysail.operators import windows as W
from arraysail.plans import datasets as D
from arraysail.plans import linalg as M
from arraysail.plans import rsa as Q

NAN = float("nan")


def values(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_alignment_guards(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    target = spark.createDataFrame([(2, 0), (1, 1), (2, 2)], "k int, pos int")
    assert values(J.align(source, target, "k", "pos"), "pos", "v") == [(0, "b"), (1, "a"), (2, "b")]
    with pytest.raises(LabelError):
        J.align(source.union(source), target, "k", "pos")
    with pytest.raises(LabelError):
        J.align(source.where("k = 1"), target, "k", "pos")


def test_exclusion_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert df.transform(lambda d: X.filter_labels(d, "k", [1], exclude=True)).count() == 2
    assert X.filter_labels(df, "k", spark.createDataFrame([(1,), (None,)], "k int"), exclude=True).count() == 2
    assert X.filter_labels(df, "k", spark.createDataFrame([(1,), (1,)], "z int")).count() == 1


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = X.filter_labels(df, "o_orderpriority", ["1-URGENT"]).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority" in plan.replace("In(o_orderpriority, [1-URGENT])", "EqualTo(o_orderpriority") and "o_totalprice" not in plan


def test_missing_values(spark):
    cells = spark.createDataFrame([(1, 1.0), (1, NAN), (2, NAN), (2, None), (3, 1.0)], "k int, value double")
    assert values(X.drop_missing(cells, ["k"]), "k") == [(3,)]
    assert {r[0] for r in values(X.drop_missing(cells, ["k"], how="all"), "k")} == {1, 3}
    with pytest.raises(ValueError):
        X.drop_missing(cells, ["k"], how="some")
    with pytest.raises(ValueError):
        X.columns_with(cells, "val", 2)
    got = cells.select("k", X.in_bounds("value", 0, 2).alias("b")).where("b").count()
    assert got == 2


@pytest.mark.parametrize("correction", [0, 1, 2])
def test_z_score_and_policies(spark, correction):
    v = np.random.default_rng(0).random(10)
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, value double")
    got = [r["value"] for r in W.z_score(df, ["k"], correction=correction).collect()]
    assert sorted(got) == pytest.approx(sorted((v - v.mean()) / v.std(ddof=correction)))
    bad = df.union(spark.createDataFrame([(1, NAN)], "k int, value double"))
    assert all(math.isnan(r["value"]) for r in W.center(bad, ["k"]).collect())
    got = [r["value"] for r in W.z_score(bad, ["k"], correction=correction, nan_policy="omit").collect()]
    d = ((v - v.mean()) ** 2).sum() / (11 - correction)
    assert sorted(x for x in got if not math.isnan(x)) == pytest.approx(sorted((v - v.mean()) / d**0.5))
    with pytest.raises(MissingValueError):
        W.z_score(bad, ["k"], nan_policy="raise")
    assert W.center(df, ["k"], nan_policy="raise").count() == 10
    with pytest.raises(ValueError):
        W.center(df, ["k"], nan_policy="other")
    two = df.union(spark.createDataFrame([(None, 1.0), (None, 4.0)], "k int, value double"))
    for f in (lambda **k: W.z_score(two, ["k"], correction=correction, **k), lambda **k: W.center(two, ["k"], **k)):
        a, b = ([r["value"] for r in f(few_groups=x).orderBy("k", "value").collect()] for x in (False, True))
        assert a == pytest.approx(b) and len(a) == 12  # the same by a window and by a join, null keys included
    one = spark.createDataFrame([(1, 5.0)], "k int, value double")
    assert W.z_score(one, ["k"], correction=correction).collect()[0]["value"] is None


def test_correlations(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random(50), rng.random(50)
    df = spark.createDataFrame([(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double, c double")
    r = np.corrcoef(x, y)[0, 1]
    assert A.pearson_r(df, "x", "y").first()["r"] == pytest.approx(r)
    assert A.pearson_r(df, "y", "x").first()["r"] == pytest.approx(r)
    assert A.pearson_r(df, "x", "y", correction=0).first()["r"] == pytest.approx(r * 50 / 49)
    assert A.pearson_r(df, "x", "c").first()["r"] is None
    assert df.agg(A.covariance("x", "y").alias("c")).first()["c"] == pytest.approx(np.cov(x, y)[0, 1])
    ranks = lambda v: v.argsort().argsort()
    assert A.spearman_r(df, "x", "y", "id").first()["rho"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    tied = spark.createDataFrame([(0, 1, 1), (1, 1, 3), (2, 2, 2), (3, 2, 4)], "id int, x int, y int")
    assert A.spearman_r(tied, "x", "y", "id").first()["rho"] == pytest.approx(0.8)
    assert df.agg(A.r2("x", "c").alias("r")).first()["r"] == pytest.approx(1 - ((x - 1) ** 2).sum() / ((x - x.mean()) ** 2).sum())
    nulls = df.withColumn("y", F.when(F.col("id") < 40, F.col("y")))
    assert A.pearson_r(nulls, "x", "y").first()["r"] == pytest.approx(np.corrcoef(x[:40], y[:40])[0, 1])


def test_permutation_tails(spark):
    null = spark.createDataFrame([(float(v),) for v in (-3, -1, 0, 1, 2)], "z double")
    seen = spark.createDataFrame([(1.5,)], "o double")
    p = {t: Q.permutation_test(null, seen, "z", t).first()["p"] for t in ("left", "right", "both")}
    assert p == {"left": 5 / 6, "right": 2 / 6, "both": 3 / 6}


@pytest.mark.parametrize(("n", "k"), [(11, 4), (3, 5), (20, 5), (1, 1)])
def test_folds(spark, n, k):
    df = spark.range(n)
    for shuffle in (False, True):
        got = [r["fold"] for r in W.folds(df, "id", k, shuffle).orderBy("id").collect()]
        sizes = [got.count(i) for i in range(k)]
        assert sizes == [len(a) for a in np.array_split(np.arange(n), k)]
        if not shuffle:
            assert got == sorted(got)


def test_positions_with_ties_nulls_and_types(spark):
    from datetime import datetime

    rows = [(i, None if i % 7 == 0 else float(i % 5), datetime(2024, 1, 1 + i % 28), f"s{i % 11}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, f double, t timestamp, s string").repartition(4)
    for key, k in (("f", 1), ("t", 2), ("s", 3)):
        got = [r["id"] for r in W.global_position(df, key, "pos", ["id"]).orderBy("pos").collect()]
        assert got == [r[0] for r in sorted(rows, key=lambda r: (r[k] is not None, r[k] or 0, r[0]) if k != 3 else (r[3], r[0]))]
    assert W.global_position(df.limit(0), "f", "pos", ["id"]).count() == 0 and W.global_position(df.limit(0), "s", "pos", ["id"]).count() == 0
    odd = spark.createDataFrame([(0, NAN), (1, float("inf")), (2, None), (3, -1.0), (4, float("-inf")), (5, NAN)], "id int, f double")
    assert [r["id"] for r in W.global_position(odd, "f", "pos", ["id"]).orderBy("pos").collect()] == [2, 4, 3, 1, 0, 5]
    same = spark.createDataFrame([(i, f"a long common beginning {i % 50:03d}", 1.0) for i in range(100)], "id int, s string, c double")
    pieces = W._pieces(same, "s", "p")
    assert pieces.select("p").distinct().count() == 50
    assert [r["id"] for r in W.global_position(same, "c", "pos", ["id"]).orderBy("pos").collect()] == list(range(100))


def test_sliding_mean_against_numpy(spark):
    v = np.random.default_rng(0).random(23)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, i int, value double")
    for size, n in ((4, 4), (0.3, 6), (1.0, 23)):
        got = [r["mean"] for r in W.sliding_mean(df, ["k"], ["i"], size, 3).orderBy("pos").collect()]
        assert got == pytest.approx([v[i : i + n].mean() for i in range(0, 23, 3)])
    with pytest.raises(ValueError):
        W.sliding_mean(df, ["k"], ["i"], 1.5, 3)


def test_errors_have_the_given_spread(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0)], "k int, m double, e double")
    for ddof in (0, 1):
        got = [r["y"] for r in U.simulate_errors(df, "m", "e", ddof=ddof).collect()]
        assert np.mean(got) == pytest.approx(5) and np.std(got, ddof=ddof) == pytest.approx(2)


def test_sets(spark):
    a, b = spark.range(5), spark.range(3)
    assert U.is_subset(b, a, ["id"]) and not U.is_subset(a, b, ["id"])
    assert values(U.concat({"x": a.withColumn("v", F.lit(1)), "y": b}, "part"), "part", "id")[-1] == ("y", 2)
    assert U.shared(spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 1)], "i int, g int"), "i", "g").collect()[0]["i"] == 1


def test_derangements(spark):
    rows = [tuple(r["permutation"]) for r in P.derangements(spark, 5, 44, 1).collect()]
    assert len(set(rows)) == 44 and not any(p[i] == i for p in rows for i in range(5))
    with pytest.raises(ValueError):
        P.derangements(spark, 3, 3)


def test_layouts(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, features array<double>")
    long = L.to_long(rows, "features")
    assert L.to_rows(long, ["id"]).collect()[0]["features"] == [1.0, 2.0, 3.0]
    grid = spark.createDataFrame([(x, y, z) for x in range(2) for y in range(3) for z in range(4)], "x int, y int, z int")
    flat = grid.withColumn("f", L.flat_id([2, 3, 4], "x", "y", "z"))
    assert sorted(r["f"] for r in flat.collect()) == list(range(24))
    back = flat.select("x", "y", "z", *[c.alias(n) for c, n in zip(L.unravel("f", [2, 3, 4]), "abc")])
    assert back.where("x <> a or y <> b or z <> c").isEmpty()
    assert values(L.flatten_dims(grid, ["z", "x", "y"], {"x": 2, "y": 3, "z": 4}), "feature") == [(i,) for i in range(24)]
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, value double")
    assert L.upper_triangle(cells).count() == 1 and L.diagonal(cells).count() == 1 and values(L.swap(cells, "i", "j"), "i", "j") == [(0, 0), (1, 0)]


def test_interval_join_is_exact_at_the_bounds(spark):
    events = spark.createDataFrame([(1, 10.0), (2, 0.0)], "e int, t double")
    signal = spark.createDataFrame([(float(s),) for s in range(-5, 30)], "s double")
    got = values(J.interval(events.withColumn("g", F.lit(1)), signal.withColumn("g", F.lit(1)), ["g"], F.col("t"), F.col("s"), -2, 3), "e", "s")
    assert got == [(e, float(s)) for e, t in ((1, 10), (2, 0)) for s in range(t - 2, t + 4)]


def test_hemisphere_and_recode(spark):
    df = spark.createDataFrame([("Left", -1.0), ("rh", NAN), ("L", 2.0)], "h string, v double")
    assert [r[0] for r in df.select(S.hemisphere("h")).collect()] == ["lh", "rh", "lh"]
    got = [r[0] for r in df.select(S.recode("v", -9.0, 9.0)).collect()]
    assert got[0] == -9 and math.isnan(got[1]) and got[2] == 9
    with pytest.raises(Exception, match="no hemisphere"):
        df.select(S.hemisphere(F.lit("middle"))).collect()


def test_cka_of_a_rotation_is_one(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    q = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    make = lambda a: L.to_long(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id int, f array<double>"), "f")
    assert A.linear_cka(make(x), make(x @ q * 3), "id").first()["cka"] == pytest.approx(1)


def test_kernels(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(12, 3)), rng.normal(size=(12, 5))
    kernel = lambda a: spark.createDataFrame([(i, j, float(a[i] @ a[j])) for i in range(12) for j in range(12)], "i int, j int, value double")
    h = np.eye(12) - 1 / 12
    want = lambda a, b: np.trace(a @ a.T @ h @ b @ b.T @ h) / 121
    assert A.hsic(kernel(x), kernel(y)).first()["hsic"] == pytest.approx(want(x, y))
    assert A.cka(kernel(x), kernel(y)).first()["cka"] == pytest.approx(want(x, y) / (want(x, x) * want(y, y)) ** 0.5)
    long = lambda a: L.to_long(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id int, f array<double>"), "f")
    assert A.linear_cka(long(x), long(y), "id").first()["cka"] == pytest.approx(A.cka(kernel(x), kernel(y)).first()["cka"])


def test_sparse_projection_keeps_norms_on_average(spark):
    x = spark.createDataFrame([(0, j, 1.0) for j in range(200)], "id int, feature int, value double")
    n = M.sparse_projection(spark, x, ["id"], 200, 400, seed=1).agg(F.sum(F.col("value") ** 2)).first()[0]
    assert n == pytest.approx(200, rel=0.25)


def test_filter_banks_are_no_joins_of_axes(spark):
    bank = G.curved_filters(spark, 3, (0.0, 0.2), (5, 7), (1.2,), 3)
    assert bank.columns == ["curvature", "size", "theta", "frequency", "row", "col", "value"]
    want = sorted(product((0.0, 0.2), (5.0, 7.0), [2 * math.pi * i / 3 for i in range(3)], (1.2,), range(3), range(3)))
    assert values(bank, *bank.columns[:-1]) == want
    assert values(G.random_filters(spark, 2, 3, 4), "output", "input", "row", "col") == sorted(product(range(2), range(3), range(4), range(4)))
    assert G.curved_filters(spark, 3, ()).count() == 0
    for f in (bank, G.random_filters(spark, 2, 3, 4)):
        assert not any(x in f._jdf.queryExecution().toString() for x in ("CartesianProduct", "NestedLoopJoin"))


def test_first_of_ranks_only_around_the_cut(spark, monkeypatch):
    df = spark.range(900).select("id", F.when(F.col("id") < 800, F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("first")).union(spark.createDataFrame([(900 + i, 7, 0) for i in range(5)], "id long, g long, first long"))
    df = df.union(df.where("id < 300"))  # keys that come up twice
    h = F.md5(F.concat_ws("-", "g", "id"))
    for n in (lambda c: F.floor(c * F.lit(0.4)), lambda c: F.lit(0), lambda c: F.lit(1), lambda c: c, lambda c: F.lit(10_000)):
        want = values(P.first_of(df, ["g"], h, ["id"], n).withColumn("k", F.hash("id", "g")), "k", "first")
        assert len(want) == 1205
        with monkeypatch.context() as m:
            m.setattr(P, "MOST_IN_TASK", 100)
            got = P.first_of(df, ["g"], h, ["id"], n)
            assert got.columns == ["id", "g", "first"] and values(got.withColumn("k", F.hash("id", "g")), "k", "first") == want


def rows_ranked(df) -> int:
    """Rows that are shuffled to the windows of a query."""
    df.collect()

    def below(p):
        kind = p.getClass().getSimpleName()
        kids = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        yield kind, p
        for k in kids:
            yield from below(k)

    windows = [p for kind, p in below(df._jdf.queryExecution().executedPlan()) if kind == "WindowExec"]
    assert windows
    return sum(next(p for kind, p in below(w) if kind == "ShuffleExchangeExec").metrics().apply("shuffleRecordsWritten").value() for w in windows)


@pytest.mark.parametrize(("name", "rows"), [("permutation_p", 150_000), ("subsample", 1_500)])
def test_draws_over_many_rows_rank_few_of_them(spark, monkeypatch, name, rows):
    monkeypatch.setattr(P, "MOST_IN_TASK", 100, raising=False)
    folder = "/root/testdata/sf0.01"
    df = core.QUERIES[name](spark, folder)
    assert 0 < rows_ranked(df) < rows / 50
    assert oracle.difference(core.QUERIES[name](spark, folder), oracle.connect(folder), core.SQL[name]) == ""


def test_dataset_flows(spark):
    wide = spark.createDataFrame([(10, 1, 760), (11, 2, 0), (12, 3, 64)], "stimulus int, rep0 int, rep1 int")
    p = {(r["session"], r["trial"]): (r["stimulus"], r["repetition"], r["presentation"], r["run"]) for r in D.presentations(wide, "stimulus", ["rep0", "rep1"]).collect()}
    assert p == {(0, 0): (10, 0, 0, 0), (0, 1): (11, 0, 1, 0), (0, 2): (12, 0, 2, 0), (0, 63): (12, 1, 3, 1), (1, 9): (10, 1, 4, 0)}
    twice = spark.createDataFrame([(f"s{i}", i + 1, i + 1) for i in range(3)], "stimulus string, rep0 int, rep1 int")
    assert values(D.presentations(twice, "stimulus", ["rep0", "rep1"]), "presentation", "repetition") == [(i, i % 2) for i in range(6)]
    cells = spark.createDataFrame([(s, n, float(s * n + t)) for s in (0, 1) for n in (1, 2, 3) for t in (0, 1)], "session int, neuroid int, value double")
    mask = spark.createDataFrame([(1, True), (2, True), (3, False)], "neuroid int, ok boolean")
    assert sorted(r["value"] for r in D.betas(cells, [(mask, ["neuroid"], "ok")]).collect()) == [-1.0] * 4 + [1.0] * 4
    assert values(D.validity(cells, "neuroid", "session", 1, F.col("value") < 1.5), "neuroid") == [(1,), (2,), (3,)]
    volume = spark.createDataFrame([(0, 0), (1, 5)], "cell int, label int")
    labels = spark.createDataFrame([("atlas", 5, "V1")], "source string, label int, name string")
    assert values(D.regions({("atlas", "lh"): volume, ("atlas", "rh"): volume}, labels), "hemisphere", "name", "cell") == [("lh", "V1", 1), ("rh", "V1", 1)]
    notes = spark.createDataFrame([(1, 7, 3, "b"), (2, 7, 3, "a"), (3, 8, 3, "c")], "annotation_id int, image_id int, category_id int, caption string")
    images = spark.createDataFrame([(7, 70)], "image_id int, stimulus int")
    assert D.captions(notes, images).collect()[0]["captions"] == ["b", "a"]
    assert values(D.annotation_counts(notes, images, spark.createDataFrame([(3, "dog")], "category_id int, category string")), "stimulus", "category", "n") == [(70, "dog", 2)]
    trials = spark.createDataFrame([(0, "catch_1"), (1, "dog_2"), (2, "dog_2")], "i int, stimulus string")
    assert values(D.without_catch(trials, "stimulus", ["i"]), "i", "repetition") == [(1, 0), (2, 1)]
    signal = spark.createDataFrame([("c", n, float(n)) for n in range(8)], "channel string, n int, value double")
    assert [r["value"] for r in D.averaged_signal(signal, 4).orderBy("n").collect()] == [1.5, 5.5]
    assert [r["value"] for r in D.filtered(signal, [0.25, 0.5, 0.25]).orderBy("n").collect()] == pytest.approx(np.convolve(np.arange(8.0), [0.25, 0.5, 0.25], "same"))
    events = spark.createDataFrame([(0, 0.0), (1, 4.0)], "pos int, onset double")
    s = signal.select("channel", F.col("n").cast("double").alias("time"), "value")
    got = D.eeg_epochs(events, s, 0, 3, 2, 2, n_main=1)
    assert values(got, "pos", "place", "mean", "main") == [(0, 0, 0.5e6, True), (0, 2, 2.5e6, True), (1, 0, 4.5e6, False), (1, 2, 6.5e6, False)]
    assert D.eeg_epochs(events, s, 0, 3, 2, 2, scale="std").count() == 4
    paths = spark.createDataFrame([("x/dog_1.png",), ("x/cat_2.png",)], "path string")
    table = D.stimulus_table(paths, spark.createDataFrame([("dog", 1), ("cat", 2)], "condition string, size int"), spark.createDataFrame([("dog", 4)], "condition string, set int"))
    assert values(table, "stimulus", "size") == [("cat_2", 2), ("dog_1", 1)] and {r["condition"]: r["set"] for r in table.collect()} == {"dog": 4, "cat": None}
    a = spark.createDataFrame([(1, 1.0), (2, NAN)], "neuroid int, value double")
    assert values(D.assembly({0: a, 1: a.where("neuroid = 1")}), "subject", "neuroid") == [(0, 1), (1, 1)]
    names = spark.createDataFrame([(0, "x"), (1, "y")], "line int, name string")
    ev = spark.createDataFrame([(5,), (9,)], "sample int")
    assert values(D.eeg_events(ev, names), "sample", "onset", "name") == [(5, 17, "x"), (9, 33, "y")]
    vectors = spark.createDataFrame([(0, [1.0])], "line int, features array<double>")
    assert D.embeddings(vectors, names).collect()[0]["name"] == "x"
