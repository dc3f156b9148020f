import math
import random

import common
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arraysail.llm import cross_parsing as X


def _holds(reference, phrase):
    n = len(phrase)
    return any(tuple(r[i : i + n]) == tuple(phrase) for r in reference for i in range(len(r) - n + 1))


def _greedy(reference, words):
    i = n = 0
    while i < len(words):
        k = 1
        while i + k < len(words) and _holds(reference, words[i : i + k + 1]) and _holds(reference, words[i : i + 1]):
            k += 1
        n, i = n + 1, i + k
    return n


def _incremental(words):
    seen, i, n = set(), 0, 0
    while i < len(words):
        k = 1
        while i + k < len(words) and tuple(words[i : i + k]) in seen:
            k += 1
        seen.add(tuple(words[i : i + k]))
        n, i = n + 1, i + k
    return n


TEXTS = st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=4)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.lists(st.sampled_from("abcd"), max_size=20))
def test_phrases_match_brute_force(reference, words):
    assert X.cross_phrases(X.automaton(reference), words) == _greedy(reference, words)
    assert X.own_phrases(words) == _incremental(words)


def test_automaton_holds_all_and_only_substrings():
    rng = random.Random(0)
    texts = [[rng.choice("ab") for _ in range(30)] for _ in range(3)]
    start = X.automaton(texts)
    for _ in range(500):
        w = [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
        at = start
        for x in w:
            at = at.get(x) if at is not None else None
        assert (at is not None) == _holds(texts, w)


def test_scores_against_a_plain_computation(spark):
    docs, labels = common.table(spark, "documents"), common.table(spark, "labels")
    got = {r["doc_id"]: r for r in X.scores(docs, labels, block_chars=20_000).collect()}
    assert len(got) == docs.count()
    plain = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    from pyspark.sql import functions as F

    blocks = max(1, math.ceil(sum(len(plain[i]) for i in good) / 20_000), math.ceil(sum(map(len, plain.values())) / X.BLOCK_TEXT))
    assert blocks > 1
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(X.SEED)).alias("h")).collect()}
    for i in sorted(plain)[::20]:
        reference = [X.words_of(plain[j]) for j in sorted(good) if (h[j] >> 1) % blocks == (h[i] >> 1) % blocks and (h[j] & 1) != (h[i] & 1)]
        w = X.words_of(plain[i])
        size, c, own = sum(map(len, reference)), X.cross_phrases(X.automaton(reference), w), _incremental(w)
        r = got[i]
        assert (r["n_words"], r["reference_words"], r["n_phrases"]) == (len(w), size, c)
        assert r["cross_entropy"] == pytest.approx(c * math.log2(max(size, 2)) / len(w))
        assert r["relative_entropy"] == pytest.approx((c * math.log2(max(size, 2)) - own * math.log2(max(own, 2))) / len(w))


def test_junk_scores_worse_than_text(spark):
    d = "/root/testdata/sf0.01"
    m = X.scores(common.table(spark, "documents", d), common.table(spark, "labels", d)).toPandas().merge(common.table(spark, "labels", d).toPandas(), on="doc_id")
    assert m[m.quality == 0].cross_entropy.mean() > m[m.quality == 1].cross_entropy.mean() + 2


def test_edges(spark, edge, edge_labels):
    for labels in (edge_labels, None, common.empty(edge_labels)):
        rows = X.scores(edge, labels).collect()
        assert len(rows) == edge.count()
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], set()).add(r[1:])
        assert len(by[3]) == 1
        assert all(next(iter(by[i]))[0] == 0 and next(iter(by[i]))[3] is None for i in (100, 101, 102))
        assert sorted(r["n_words"] for r in rows if r["doc_id"] is None) == [0, 5]
    assert X.scores(common.empty(edge), edge_labels).count() == 0


_TEXT = st.lists(st.sampled_from("ab"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), _TEXT), max_size=6), st.lists(st.tuples(st.integers(5, 9), st.lists(st.sampled_from("abc"), max_size=40)), max_size=3), st.sampled_from([1, 3, 512]), st.integers(1, 3))
def test_phrases_against_all_other_documents(reference, others, stride, shards):
    import numpy as np

    X.STRIDE, old = stride, X.STRIDE
    try:
        parts = [[x for x in reference if x[0] % shards == k] for k in range(shards)]
        built = [X.index([X.codes(w) for _, w in p], np.array([i for i, _ in p], np.int64)) for p in parts if p]
        texts = [*reference, *others, (None, [*"abba"])]
        phrases, sizes = X.parsed([X.codes(w) for _, w in texts], [i for i, _ in texts], built)
    finally:
        X.STRIDE = old
    for (i, w), c, n in zip(texts, phrases, sizes):
        assert n == sum(len(r) for j, r in reference if j == i)
        assert c == _greedy([r for j, r in reference if j != i], w)


def test_long_copies_are_one_phrase():
    import numpy as np

    rng = random.Random(4)
    text = [f"w{rng.randrange(50)}" for _ in range(5000)]
    texts = {1: text, 2: [*text, "end"], 3: ["start", *text[100:3000]], 4: ["x"] * 3000}
    built = X.index([X.codes(w) for w in texts.values()], np.array(list(texts), np.int64))
    phrases, _ = X.parsed([X.codes(w) for w in texts.values()], list(texts), [built])
    assert phrases == [1, 2, 2, 3000]


def test_every_document_meets_the_whole_reference(spark):
    docs, labels = common.table(spark, "documents"), common.table(spark, "labels")
    plain = {r["doc_id"]: X.words_of(r["text"] or "") for r in docs.collect()}
    good = sorted(r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0)
    one = {r["doc_id"]: r for r in X.scores(docs, labels).collect()}
    many = {r["doc_id"]: r for r in X.scores(docs, labels, shard_chars=20_000, task_words=5_000).collect()}
    assert one == many and len(one) == docs.count()
    for i in sorted(plain)[::20]:
        reference = [plain[j] for j in good if j != i]
        assert (one[i]["n_words"], one[i]["reference_words"], one[i]["n_phrases"]) == (len(plain[i]), sum(map(len, reference)), X.cross_phrases(X.automaton(reference), plain[i]))


def test_one_index_whatever_the_pieces(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    import numpy as np

    from arraysail.llm import _common as C

    docs, labels = common.table(spark, "documents"), common.table(spark, "labels")
    root = Path(urlparse(C.checkpoint_dir(spark)).path)
    before = set(root.glob("reference-*"))
    X.scores(docs, labels, shard_chars=20_000, task_words=5_000).collect()
    (folder,) = set(root.glob("reference-*")) - before
    # one file of each kind, so that a batch of documents is searched once and not once for each shard
    assert {p.name for p in folder.iterdir()} == {"text", "start", "owner", "who", "words", "key", "order", "next"}
    got = {k: np.fromfile(folder / k, "i4" if k in ("order", "next") else t) for k, t in X._KINDS.items()}
    plain = {r["doc_id"]: X.words_of(r["text"] or "") for r in docs.collect()}
    good = sorted(r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0)
    good = [i for i in good if i in plain]
    one = X.index([X.codes(plain[i]) for i in good], np.array(good, np.int64))
    assert (got["key"] == one["key"]).all() and (got["who"] == one["who"]).all() and (got["words"] == one["words"]).all()

    def suffixes(x):
        ends = np.append(x["start"][1:], len(x["text"]) - X._BLOCK)
        whose = np.searchsorted(x["start"], x["order"], "right") - 1
        return [tuple(x["text"][a : ends[w]]) for a, w in zip(x["order"][::50].tolist(), whose[::50])]

    assert suffixes(got) == suffixes(one)


def test_a_text_is_not_compared_with_itself_to_its_end(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    texts = [[f"w{rng.randrange(20)}" for _ in range(20_000)], [f"w{rng.randrange(20)}" for _ in range(20_000)]]
    built = X.index([X.codes(w) for w in texts], np.array([1, 2]))
    compared, same = [], X._same

    def counted(*a):
        out = same(*a)
        compared.append(int(out.sum()))
        return out

    monkeypatch.setattr(X, "_same", counted)
    phrases, _ = X.parsed([X.codes(w) for w in texts], [1, 2], [built])
    assert phrases == [X.cross_phrases(X.automaton([texts[1 - k]]), texts[k]) for k in (0, 1)]
    assert sum(compared) < 100 * 40_000


def test_shared_words_of_pairs_in_copies_and_elsewhere(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    text = rng.integers(1, 4, 6000)
    text[4000:6000] = text[1000:3000]
    text[[1500, 4700, 5999]] = 9, 8, 0
    text = np.concatenate([text, np.zeros(X._BLOCK, np.int64)])
    a = np.concatenate([np.arange(4000, 6000), rng.integers(0, 6000, 500)])
    b = np.concatenate([np.arange(1000, 3000), rng.integers(0, 6000, 500)])
    a, b = a[a != b], b[a != b]
    want, compared, same = X._same(text, a, text, b), [], X._same
    monkeypatch.setattr(X, "_same", lambda *x: compared.append(len(x[1])) or same(*x))
    assert (X._shared(text, a, b) == want).all()
    # the copy is measured a few times and not at each of its places
    assert sum(compared) < 600
