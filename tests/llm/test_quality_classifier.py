import common
import numpy as np
import pytest

from arraysail.llm import _common as C
from arraysail.llm import quality_classifier as Q


def _plain(docs, labels):
    """The whole selection on the driver."""
    texts = [r["text"] or "" for r in docs]
    counts = np.zeros((len(docs), Q.BUCKETS))
    for i, t in enumerate(texts):
        counts[i] = np.bincount(Q.ngrams([t])[0], minlength=Q.BUCKETS)
    good = np.array([labels.get(r["doc_id"]) == 1 for r in docs])
    raw, target = counts.sum(0), counts[good].sum(0)
    ratio = np.log((target + 1) / (target.sum() + Q.BUCKETS)) - np.log((raw + 1) / (raw.sum() + Q.BUCKETS))
    return 100 * (counts @ ratio) / (counts.sum(1) + 50)


def test_weights_and_gumbel_top_k_match_a_plain_computation(spark):
    docs, labels = common.table(spark, "documents"), common.table(spark, "labels")
    _, scored, least = Q.model(spark, docs, labels)
    rows = {r["doc_id"]: r for r in scored.collect()}
    local = docs.select("doc_id", "text").collect()
    known = {r["__id"]: r["__label"] for r in C.one_label(labels, "quality", 10**6, 0).collect()}
    want = _plain(local, known)
    assert [rows[r["doc_id"]]["log_weight"] for r in local] == pytest.approx(want.tolist(), abs=1e-6)
    seen = [(w, known[r["doc_id"]]) for r, w in zip(local, want) if r["doc_id"] in known]
    border = Q.border(np.array([s for s, _ in seen]), np.array([y for _, y in seen]))
    k = sum(r["log_weight"] >= border for r in rows.values())
    best = sorted(rows, key=lambda i: -rows[i]["key"])[:k]
    assert {r["doc_id"] for r in Q.select(spark, docs, labels).collect()} == set(best)
    assert least == rows[best[-1]]["key"]


def test_kth_largest(spark):
    values = np.random.default_rng(0).normal(size=30_000).round(3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    order = np.sort(values)[::-1]
    for k in (1, 2, 500, 29_999, 30_000):
        assert Q.kth_largest(df, "v", k) == order[k - 1]
    assert Q.kth_largest(df, "v", 0) == float("inf")
    same = spark.range(20_000).selectExpr("1.5 as v")
    assert Q.kth_largest(same, "v", 7) == 1.5


def test_gumbel_sampling_follows_the_weights(spark):
    from pyspark.sql import functions as F

    u = spark.range(40_000).select(Q.gumbel(F.col("id")).alias("g")).toPandas()["g"]
    assert u.mean() == pytest.approx(0.5772, abs=0.03) and u.std() == pytest.approx(np.pi / 6**0.5, abs=0.03)


def _drawn(rng, w, k):
    """One draw after another, in proportion to what is left."""
    p, out = np.exp(w), []
    for _ in range(k):
        out.append(rng.choice(len(w), p=p / p.sum()))
        p[out[-1]] = 0
    return out


def test_inclusion_frequencies_are_those_of_draws_without_replacement(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w, k, seeds = np.linspace(-1.5, 1.5, 12), 5, 6000
    docs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "doc_id long, w double")
    keys = docs.crossJoin(spark.range(seeds).select(F.col("id").cast("int").alias("seed"))).withColumn("key", F.col("w") + Q.gumbel(F.col("doc_id"), F.col("seed")))
    top = keys.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("key")))).where(F.col("n") <= k)
    got = dict(top.groupBy("doc_id").agg(F.count("*") / seeds).collect())
    rng = np.random.default_rng(1)
    want = np.bincount([i for _ in range(seeds) for i in _drawn(rng, w, k)], minlength=len(w)) / seeds
    assert [got[i] for i in range(len(w))] == pytest.approx(want.tolist(), abs=0.03)
    assert want[0] < 0.25 and want[-1] > 0.6


def test_a_share_of_like_texts_is_a_sample_and_no_threshold(spark):
    import random

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, common.words(rng, rng.randrange(20, 300), 50)) for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    _, scored, least = Q.model(spark, docs, labels, share=0.4)
    rows = scored.collect()
    kept = {r["doc_id"] for r in rows if r["key"] >= least}
    best = {r["doc_id"] for r in sorted(rows, key=lambda r: -r["log_weight"])[:400]}
    assert len(kept) == 400 and 200 < len(kept & best) < 380
    assert {r["doc_id"] for r in Q.select(spark, docs, labels, share=0.4).collect()} == kept
    assert {r["doc_id"] for r in Q.keep(spark, docs, labels, share=0.4).collect()} == kept


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in Q.select(spark, common.table(spark, "documents", d), common.table(spark, "labels", d)).collect()}
    labels = common.table(spark, "labels", d).toPandas()
    assert labels[labels.quality == 1].doc_id.isin(kept).mean() > 0.98
    assert labels[labels.quality == 0].doc_id.isin(kept).mean() < 0.1


def test_edges(spark, edge, edge_labels):
    n = edge.count()
    rows = Q.select(spark, edge, edge_labels).collect()
    kept = Q.keep(spark, edge, edge_labels)
    assert kept.columns == edge.columns and kept.count() == len(rows) <= n
    assert len({r["log_weight"] for r in rows if r["doc_id"] in (100, 101)}) <= 1
    assert Q.select(spark, edge, common.empty(edge_labels)).count() == n  # nothing to go by: all stay
    assert Q.select(spark, common.empty(edge), edge_labels).count() == 0
    assert Q.keep(spark, common.empty(edge), edge_labels).count() == 0
    again = edge.unionByName(edge).unionByName(edge)  # labelled ids that are repeated
    assert Q.select(spark, again, edge_labels).count() % 3 == 0
