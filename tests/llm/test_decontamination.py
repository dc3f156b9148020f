import random
import re

import common
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arraysail.llm import decontamination as D


def _naive(text, items):
    """Merged spans of all windows of the items, word by word."""
    found = [(m.group(), *m.span()) for m in re.finditer(r"\w+", D.fold(text))]
    words = [w for w, _, _ in found]
    hit = []
    for item in items:
        w = re.findall(r"\w+", D.fold(item or ""))
        n = min(D.PHRASE, len(w))
        if n < D.LEAST_WORDS:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        hit += [(i, i + n) for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows]
    spans = []
    for i, j in sorted(hit):
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], j)
        else:
            spans.append([i, j])
    return [(found[i][1], found[j - 1][2]) for i, j in spans]


WORDS = st.sampled_from(["a", "b", "c", "d", "Über", "x1"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=40).map(" ".join), max_size=4), st.lists(st.lists(WORDS, max_size=14).map("  ".join), max_size=3))
def test_spans_match_a_plain_search(texts, items):
    got = D.shard_spans(texts, [D.phrases(items)])
    assert got == D.shard_spans(texts, [D.phrases([i]) for i in items])
    assert [got.get(i, []) for i in range(len(texts))] == [_naive(t, items) for t in texts]


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    s = np.append(rng.integers(1, 6, 3000), 0)
    index = D.FMIndex(s)
    assert (np.sort(D.suffix_array(s)) == np.arange(len(s))).all()
    for n in (1, 2, 4):
        patterns = rng.integers(1, 7, (50, n))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_query_over_the_table(spark):
    docs, bench = common.table(spark, "documents"), common.table(spark, "benchmark")
    items = [r["text"] for r in bench.collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {i: s for i, t in texts.items() if (s := _naive(t, items))}
    got = {r["doc_id"]: r for r in D.contaminated(spark, docs, bench).collect()}
    assert want and {i: [tuple(x) for x in r["spans"]] for i, r in got.items()} == want
    assert all(r["cleaned"] == D.without(texts[i], want[i]) for i, r in got.items())
    clean = {r["doc_id"]: r for r in D.clean(spark, docs, bench).collect()}
    assert len(clean) == len(texts)
    for i, t in texts.items():
        assert (clean[i]["text"] or "") == (D.without(t, want[i]) if i in want else t)
        if i in want:
            assert clean[i]["n_chars"] == len(clean[i]["text"])


def test_planted_passages_are_taken_out(spark):
    rng = random.Random(4)
    items = [(i, common.words(rng, 20, 5000)) for i in range(10)]
    rows = [(i, f"{common.words(rng, 30, 5000)} {items[i % 10][1].upper()} {common.words(rng, 30, 5000)}") for i in range(20)] + [(50 + i, common.words(rng, 80, 5000)) for i in range(20)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"] for r in D.contaminated(spark, docs, bench).collect()}
    assert got == set(range(20))


def test_edges(spark, edge):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "w1 w2 w3 w4 w5"), (4, "x" * 1000)], "item_id long, text string")
    texts = [(r["doc_id"], r["text"] or "") for r in edge.collect()]
    items = [r["text"] for r in bench.collect()]
    want = sorted((str(i), s) for i, t in texts if (s := _naive(t, items)))
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["spans"]]) for r in D.contaminated(spark, edge, bench).collect()) == want
    cleaned = D.clean(spark, edge, bench)
    assert cleaned.columns == edge.columns and cleaned.count() == len(texts)
    assert {r["text"] for r in cleaned.where("doc_id = 100").collect()} == {None}
    assert D.contaminated(spark, edge, common.empty(bench)).count() == 0
    assert D.contaminated(spark, common.empty(edge), bench).count() == 0 and D.clean(spark, common.empty(edge), bench).count() == 0


def test_a_large_benchmark_is_searched_in_parts(spark, monkeypatch):
    docs, bench = common.table(spark, "documents"), common.table(spark, "benchmark")
    plain = lambda: sorted((r["doc_id"], r["spans"], r["cleaned"]) for r in D.contaminated(spark, docs, bench).collect())
    whole = plain()
    monkeypatch.setattr(D, "PART_CHARS", 300)
    assert len(D._Parts(spark, bench).parts) > 2 and plain() == whole


def test_short_items_are_searched_unless_a_bound_is_given(spark):
    docs = spark.createDataFrame([(1, "the capital is Paris indeed"), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Paris"), (2, "capital is"), (3, "?"), (4, None)], "item_id long, text string")
    got = D.contaminated(spark, docs, bench).collect()
    assert [(r["doc_id"], [tuple(x) for x in r["spans"]]) for r in got] == [(1, [(4, 20)])]
    assert D.contaminated(spark, docs, bench, least_words=3).count() == 0
    assert {r["doc_id"]: r["text"] for r in D.clean(spark, docs, bench).collect()} == {1: "the  indeed", 2: "nothing", 3: None}
