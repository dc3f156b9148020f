"""Toxicity: a linear classifier from confirmed toxic examples and unlabelled text.

The risk is the non-negative positive-unlabelled estimator: with class prior
``p`` and loss ``l``, ``p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])``. Where the
second term turns negative, its gradient is ascended instead, so that the model
can't drive it below nought by learning the unlabelled rows by heart. Features
are the distinct words of a text and their first letters, those that are surely
commoner in toxic examples than in unlabelled text. Fitting uses a bounded sample; scoring reads every text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.llm import _common as C

#: Bounds of the fitted sample: confirmed toxic examples, and unlabelled documents.
MAX_TOXIC, MAX_UNLABELLED = 3_000, 6_000
#: A feature is in at least this many, and this share, of the toxic examples.
LEAST_EXAMPLES, LEAST_SHARE = 3, 0.02
#: ... and so much commoner than among the unlabelled ones, as a ratio and in standard deviations.
LEAST_LIFT, LEAST_DEVIATIONS = 4.0, 4.0
STEPS, RATE, DECAY, SEED = 400, 0.05, 1e-3, 7
PREFIX = 4
_FIND = re.compile(r"[^\W\d_]{2,}").findall


def features(text: str) -> set[str]:
    """Distinct words in lower case, and the first letters of the longer ones with a mark."""
    words = set(_FIND(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


class PULinear:
    """f(x) = w.x + b on sparse binary features of given scale, fitted by Adam on the non-negative risk with logistic loss."""

    def __init__(self, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int = SEED):
        self.prior, self.steps, self.rate, self.decay, self.seed = prior, steps, rate, decay, seed

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], scale: np.ndarray) -> PULinear:
        rng, size = np.random.default_rng(self.seed), len(scale)
        self.scale, (m, v) = np.append(scale, 1.0), np.zeros((2, size + 1))
        theta, n_p, n_u = np.zeros(size + 1), len(positive), len(unlabelled)
        theta[size] = np.log(self.prior / (1 - self.prior))
        self.risks = []
        for t in range(1, self.steps + 1):
            p = [positive[i] for i in rng.integers(0, n_p, min(n_p, 600))]
            u = [unlabelled[i] for i in rng.integers(0, n_u, min(n_u, 1200))]
            (fp, rp, cp), (fu, ru, cu) = self._forward(theta, p), self._forward(theta, u)
            loss = lambda f: np.logaddexp(0, -f)
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            negative = loss(-fu).mean() - self.prior * loss(-fp).mean()
            self.risks.append(self.prior * loss(fp).mean() + max(0.0, negative))
            # derivatives: of l(f) sp - 1, of l(-f) sp
            if negative >= 0:
                gp, gu = self.prior * ((sp - 1) - sp) / len(p), su / len(u)
            else:
                gp, gu = self.prior * sp / len(p), -su / len(u)
            g = np.bincount(cp, weights=gp[rp], minlength=size + 1) + np.bincount(cu, weights=gu[ru], minlength=size + 1)
            g *= self.scale
            g[size] = gp.sum() + gu.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= self.rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
            theta[:size] *= 1 - self.rate * self.decay
        self.w, self.b = theta[:size] * scale, float(theta[size])
        return self

    def _forward(self, theta, rows):
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        c = np.concatenate(rows) if rows else np.empty(0, np.int64)
        r = np.repeat(np.arange(len(rows)), n)
        return np.bincount(r, weights=(theta * self.scale)[c], minlength=len(rows)) + theta[-1], r, c


def telling(a: int, n: int, b: int, m: int) -> bool:
    """Whether a feature of ``a`` in ``n`` toxic and ``b`` in ``m`` unlabelled texts is surely commoner among the toxic ones."""
    p, q = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
    r = (a + b + 1) / (n + m + 2)
    return p > LEAST_LIFT * q and p - q > LEAST_DEVIATIONS * (r * (1 - r) * (1 / max(n, 1) + 1 / max(m, 1))) ** 0.5


def fit(texts: list[str], toxic: list[bool], prior: float) -> tuple[dict[str, float], float]:
    """(weight of each feature, offset) from confirmed examples (``toxic``) and unlabelled texts."""
    sets = [features(t) for t in texts]
    seen, other = Counter(), Counter()
    for s, y in zip(sets, toxic):
        (seen if y else other).update(s)
    n_p, n_u = sum(toxic), len(toxic) - sum(toxic)
    least = max(LEAST_EXAMPLES, LEAST_SHARE * n_p)
    names = sorted(k for k, n in seen.items() if n >= least and telling(n, n_p, other[k], n_u))
    at = {k: i for i, k in enumerate(names)}
    rows = [np.array(sorted(at[k] for k in at.keys() & s), np.int64) for s in sets]
    positive, unlabelled = [r for r, y in zip(rows, toxic) if y], [r for r, y in zip(rows, toxic) if not y]
    if not names or not positive or not unlabelled:
        return {}, float(np.log(prior / (1 - prior))) if prior < 0.5 else -1.0
    everywhere = np.bincount(np.concatenate(unlabelled), minlength=len(names))
    scale = np.log((len(unlabelled) + 1) / (everywhere + 1)) / np.log(len(unlabelled) + 1)
    model = PULinear(prior).fit(positive, unlabelled, scale)
    return dict(zip(names, model.w.tolist())), model.b


def score(text: str, weights: dict[str, float], offset: float) -> float:
    words = set(_FIND(text.lower()))
    words |= {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}
    return offset + sum(map(weights.__getitem__, sorted(words & weights.keys())))


def model(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED, seed: int = SEED) -> tuple[dict[str, float], float]:
    """The classifier; ``prior`` is the share of toxic documents, by default that among the labelled ones.

    The documents not confirmed as toxic are the unlabelled ones, whatever else their labels say.
    """
    per = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = per.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    mix = F.xxhash64("__id", F.lit(seed))
    marked = per.where("toxic = 1").select(F.col("doc_id").alias("__id"))
    some = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"))
    p = marked.orderBy(mix, "__id").limit(max_toxic).withColumn("__toxic", F.lit(True))
    # a known toxic document is no unlabelled one: twice the number is drawn, and these are taken out
    u = some.orderBy(mix, "__id").limit(2 * max_unlabelled).distinct().join(marked, "__id", "left_anti").orderBy(mix, "__id").limit(max_unlabelled).withColumn("__toxic", F.lit(False))
    wanted = C.cut(p.unionByName(u))
    rows = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(wanted), "__id").groupBy("__id").agg(F.max("__toxic").alias("toxic"), F.max("text").alias("text")).orderBy("__id").toLocalIterator()
    texts, toxic = [], []
    for r in rows:
        texts.append(" ".join(sorted(set(_FIND((r["text"] or "").lower())))))
        toxic.append(r["toxic"])
    return fit(texts, toxic, min(max(prior, 1e-3), 0.9))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, score, toxic) of every row; ``toxic`` where the score is above nought.

    A null or empty text has the model's offset as its score. Without confirmed
    examples, or a feature that tells them from the rest, nothing is toxic. Repeated rows are scored alike; whole texts are
    read, other columns ignored; an empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model(docs, labels, **parameters))

    def f(text: pa.Array) -> pa.Array:
        weights, offset = shared.value
        return pa.array(C.by_slices(text, lambda texts: [score(t, weights, offset) for t in texts]), pa.float64())

    out = docs.select("doc_id", F.arrow_udf(f, "double").asNondeterministic()("text").alias("score"))
    return out.withColumn("toxic", F.col("score") > 0)


def detect(spark: SparkSession, docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of :func:`scored` that are toxic."""
    return scored(spark, docs, labels, **parameters).where("toxic")
