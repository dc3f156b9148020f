import random

import common
import numpy as np
import pytest

from arraysail.llm import quality_rules as R


def _quantile(v, q):
    return np.sort(v)[int(np.ceil(q * len(v))) - 1]


def _estimate(x):
    m = x.mean(0)
    return m, (x.T @ x) / len(x) - np.outer(m, m) + np.eye(R.P) * R.FLOOR**2


def _plain(x):
    """The same two starts and concentration steps until rest, in numpy."""
    q = np.array([[_quantile(c, p) for p in (0.25, 0.5, 0.75)] for c in x.T])
    m, s = q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2 + R.FLOOR**2)
    spread = 1 / np.sqrt(np.diag(np.linalg.inv(s)))
    now = [(m, s), _estimate(m + spread * np.tanh((x - m) / spread))]
    for _ in range(R.MOST_STEPS):
        before, now = now, [_step(x, *e) for e in now]
        if max(abs(_logdet(a) - _logdet(b)) for a, b in zip(before, now)) <= R.TOLERANCE:
            break
    m, s = min(now, key=_logdet)
    d = R.distance(x, m, np.broadcast_to(np.linalg.inv(s), (len(x), R.P, R.P)))
    return d / max(_quantile(d, 0.5) / R._MEDIAN, 1)


def _logdet(e):
    return np.linalg.slogdet(e[1])[1]


def _step(x, m, s):
    d = R.distance(x, m, np.broadcast_to(np.linalg.inv(s), (len(x), R.P, R.P)))
    return _estimate(x[d <= _quantile(d, R.SUPPORT)])


def test_least_determinant_of_all_subsets(spark):
    from itertools import combinations

    rng = np.random.default_rng(7)
    groups = {}
    for k in range(3):
        x = rng.normal(size=(12, R.P)) * (1 + np.arange(R.P) / 2) + k
        x[:3] += rng.choice([-1, 1], R.P) * 30
        groups[f"g{k}"] = x
    rows = [(g, r.tolist()) for g, x in groups.items() for r in x]
    got = {r["g"]: r for r in R.fit(spark.createDataFrame(rows, "g string, x array<double>").repartition(3)).collect()}
    h = int(np.ceil(R.SUPPORT * 12))
    for g, x in groups.items():
        m, s = min((_estimate(x[list(c)]) for c in combinations(range(12), h)), key=_logdet)
        assert got[g]["centre"] == pytest.approx(m.tolist()) and np.allclose(np.array(got[g]["scatter"]).reshape(R.P, R.P), s)


def test_small_sources_are_drawn_to_their_language(spark):
    rng = random.Random(5)
    text = lambda: common.words(rng, 60)
    for n in (1, 5, 59, 61):
        rows = [(i, text(), "en", "large") for i in range(300)] + [(1000 + i, text(), "en", "small") for i in range(n)] + [(5000, "#@$%! " * 80, "en", "small")]
        kept = {r["doc_id"] for r in R.select(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert len(kept) > 0.99 * (300 + n) and 5000 not in kept


def test_distances_match_a_plain_computation(spark):
    docs = common.table(spark, "documents", "/root/testdata/sf0.01").limit(400).persist()
    one = docs.selectExpr("doc_id", "text", "'en' as lang", "'web' as source")
    rows = one.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], np.sqrt(_plain(np.array([R.statistics(r["text"] or "") for r in rows])))))
    got = {r["doc_id"]: r["distance"] for r in R.select(one, cut=np.inf).collect()}
    docs.unpersist()
    assert set(got) == set(want)
    assert [got[i] for i in want] == pytest.approx(list(want.values()), rel=1e-6)


def test_outliers_do_not_move_the_estimate(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, R.P))
    x[:200] += 15
    df = spark.createDataFrame([("one", r.tolist()) for r in x], "g string, x array<double>").repartition(3)
    (r,) = R.fit(df).collect()
    assert np.abs(np.array(r["centre"])).max() < 0.3


def test_junk_goes_and_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in R.select(common.table(spark, "documents", d)).collect()}
    labels = common.table(spark, "labels", d).toPandas()
    assert labels[labels.quality == 1].doc_id.isin(kept).mean() > 0.99
    rng = random.Random(3)
    rows = [(i, common.words(rng, 80), "en", "web") for i in range(300)] + [(1000 + i, "$#@! " * 60 + "AAAA BBBB\n" * 30, "en", "web") for i in range(20)]
    kept = {r["doc_id"] for r in R.select(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(i >= 1000 for i in kept) and len(kept) > 295


def test_edges(spark, edge):
    rows = R.select(edge).collect()
    kept = R.keep(edge)
    assert kept.columns == edge.columns and kept.count() == len(rows)
    by = {}
    for r in R.select(edge, cut=np.inf).collect():
        by.setdefault(r["doc_id"], []).append(r["distance"])
    assert sum(map(len, by.values())) == edge.count()
    assert len(by[3]) == 3 and len({round(x, 9) for x in by[3]}) == 1
    assert R.select(common.empty(edge)).count() == 0 and R.keep(common.empty(edge)).count() == 0
    same = spark.createDataFrame([(i, "same text here", "en", "web") for i in range(100)], "doc_id long, text string, lang string, source string")
    assert R.select(same).count() == 100  # no spread at all


def test_most_labelled_junk_goes(spark):
    d = "/root/testdata/sf0.1"
    kept = {r["doc_id"] for r in R.select(common.table(spark, "documents", d)).collect()}
    labels = common.table(spark, "labels", d).toPandas()
    assert labels[labels.quality == 0].doc_id.isin(kept).mean() < 0.2
    assert labels[labels.quality == 1].doc_id.isin(kept).mean() > 0.99
