import random

import common
import numpy as np
import pytest

from arraysail.llm import toxicity as T


def _corpus(seed, n):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        w = [f"word{rng.randrange(300)}" for _ in range(40)]
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "vileness", "wretched", "scoundrel"]))
        texts.append(" ".join(w))
        toxic.append(bad)
    return texts, toxic


def test_held_out_accuracy_from_positive_and_unlabelled():
    texts, toxic = _corpus(0, 3000)
    rng = random.Random(5)
    confirmed = [t and rng.random() < 0.4 for t in toxic]  # the others stay among the unlabelled
    weights, offset = T.fit(texts, confirmed, 0.15)
    new, truth = _corpus(1, 1000)
    said = [T.score(t, weights, offset) > 0 for t in new]
    assert sum(a and b for a, b in zip(said, truth)) / sum(truth) > 0.95
    assert sum(a and not b for a, b in zip(said, truth)) / (len(truth) - sum(truth)) < 0.01


def test_risk_is_never_negative_and_falls():
    rng = np.random.default_rng(0)
    p, u = [np.array([0, 1])] * 50, [np.array([int(i)]) for i in rng.integers(1, 4, 200)]
    m = T.PULinear(0.2, steps=200).fit(p, u, np.ones(4))
    assert min(m.risks) >= 0
    assert np.mean(m.risks[-20:]) < np.mean(m.risks[:20])
    assert m.w[0] > 0


def test_gradient_matches_differences():
    m = T.PULinear(0.3)
    m.scale = np.ones(4)
    p, u = [np.array([0]), np.array([0, 2])], [np.array([1]), np.array([2]), np.array([], int)]

    def risk(theta):
        fp, fu = m._forward(theta, p)[0], m._forward(theta, u)[0]
        loss = lambda f: np.logaddexp(0, -f)
        return 0.3 * loss(fp).mean() + loss(-fu).mean() - 0.3 * loss(-fp).mean()

    theta = np.array([0.3, -0.2, 0.1, -0.4])
    (fp, rp, cp), (fu, ru, cu) = m._forward(theta, p), m._forward(theta, u)
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    gp, gu = 0.3 * ((sp - 1) - sp) / 2, su / 3
    g = np.bincount(cp, weights=gp[rp], minlength=4) + np.bincount(cu, weights=gu[ru], minlength=4)
    for k in range(3):
        e = np.eye(4)[k] * 1e-6
        assert g[k] == pytest.approx((risk(theta + e) - risk(theta - e)) / 2e-6, abs=1e-6)


def test_query_over_the_table(spark):
    docs, labels = (common.table(spark, n, "/root/testdata/sf0.1") for n in ("documents", "labels"))
    got = T.scored(spark, docs, labels).toPandas()
    assert len(got) == 10_000 and got["score"].notna().all()
    m = got.merge(labels.toPandas(), on="doc_id", suffixes=("_said", ""))
    m = m[m.quality == 1]
    assert m[m.toxic == 1].toxic_said.mean() > 0.95
    assert m[m.toxic == 0].toxic_said.mean() < 0.05


def test_edges(spark, edge, edge_labels):
    got = T.scored(spark, edge, edge_labels)
    assert got.columns == ["doc_id", "score", "toxic"]
    rows = got.collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[3]) == 1  # repeated rows alike
    assert by[100] == by[101]  # null and empty: the offset
    assert T.scored(spark, common.empty(edge), edge_labels).count() == 0
    none = T.scored(spark, edge, common.empty(edge_labels)).collect()
    assert len(none) == len(rows) and not any(r["toxic"] for r in none)


def _plain_fit(positive, unlabelled, scale, prior, steps, seed):
    """The whole fit with dense rows and gradients by differences; also how often the second term was negative."""
    rng, n = np.random.default_rng(seed), len(scale)
    dense = lambda rows: np.array([np.append(np.bincount(r, minlength=n) * scale, 1.0) for r in rows])
    loss = lambda f: np.logaddexp(0, -f).mean()
    theta, m, v, clipped = np.zeros(n + 1), 0.0, 0.0, 0
    theta[n] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        p = dense([positive[i] for i in rng.integers(0, len(positive), min(len(positive), 600))])
        u = dense([unlabelled[i] for i in rng.integers(0, len(unlabelled), min(len(unlabelled), 1200))])
        second = lambda w: loss(-u @ w) - prior * loss(-p @ w)  # noqa: B023, E731
        whole = lambda w: prior * loss(p @ w) + second(w)  # noqa: B023, E731
        down = second(theta) < 0
        clipped += down
        goal = (lambda w: -second(w)) if down else whole  # noqa: B023
        e = np.eye(n + 1) * 1e-5
        g = np.array([(goal(theta + d) - goal(theta - d)) / 2e-5 for d in e])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
        theta[:n] *= 1 - 0.05 * 1e-3
    return theta[:n] * scale, theta[n], clipped


def test_fit_ascends_where_the_second_term_is_negative():
    rng = np.random.default_rng(2)
    # few unlabelled rows with features of their own are soon known by heart
    positive = [np.unique(rng.integers(0, 4, 3)) for _ in range(12)]
    unlabelled = [np.array([4 + i % 4]) for i in range(6)] + [np.array([0])]
    scale = np.array([1.0, 1.2, 0.7, 1.0, 1.5, 1.0, 1.0, 0.8])
    model = T.PULinear(0.6, steps=120, seed=5).fit(positive, unlabelled, scale)
    w, b, clipped = _plain_fit(positive, unlabelled, scale, 0.6, 120, 5)
    assert 10 < clipped < 110  # both branches
    assert model.w == pytest.approx(w, abs=2e-3) and model.b == pytest.approx(b, abs=2e-3)
