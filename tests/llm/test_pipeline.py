import common
from pyspark.sql import functions as F

import corpus_pipeline as CP
from arraysail.llm import decontamination, near_dedup, pieces, quality_classifier, quality_rules, registry


def test_stages_in_order():
    assert [f.__name__ for _, f in CP.STAGES] == ["quality", "rules", "dedup", "decontaminate", "encode"]
    assert CP.ORACLE_SQL is None


def test_run_is_the_stages_one_after_the_other(spark):
    d = "/root/testdata/sf0.01"
    docs, labels, bench = (common.table(spark, n, d) for n in ("documents", "labels", "benchmark"))
    columns = docs.columns
    kept = {r["doc_id"] for r in quality_classifier.select(spark, docs, labels).collect()}
    now = docs.where(F.col("doc_id").isin(list(kept)))
    kept = {r["doc_id"] for r in quality_rules.select(now).collect()}
    now = now.where(F.col("doc_id").isin(list(kept)))
    gone = {r["doc_id"] for r in near_dedup.groups(now).collect()}
    now = now.where(~F.col("doc_id").isin(list(gone)))
    cleaned = {r["doc_id"]: r["cleaned"] for r in decontamination.contaminated(spark, now, bench).collect()}
    texts = {r["doc_id"]: cleaned.get(r["doc_id"], r["text"]) for r in now.collect()}
    got = {r["doc_id"]: r for r in CP.run(spark, d).collect()}
    assert 0 < len(got) < docs.count() and set(got) == set(texts) and cleaned and gone
    assert all(pieces.encoder().model.decode(r["ids"]) == texts[i] for i, r in got.items() if r["round_trip"])
    for _, f in CP.STAGES[:-1]:
        docs = f(spark, docs, d)
        assert docs.columns == columns


def test_each_stage_on_edge_cases(spark, edge):
    for _, f in CP.STAGES:
        out = f(spark, edge, common.SF)
        assert out.count() > 0
        assert f(spark, common.empty(edge), common.SF).count() == 0


def test_all_queries_run(spark):
    for name, f in registry.queries().items():
        df = f(spark, common.SF)
        assert df.columns and df.count() >= 0, name
    assert {int(n[2:].split("_")[0]) for n in registry.queries() if n != "pipeline"} == set(range(1, 11))
