import random

import common
import numpy as np

from arraysail.llm import near_dedup as N


def _brute(texts, ids):
    """Components of all pairs within the bound, and the pairs."""
    bits = N.BITS
    f = N.fingerprints(texts)
    unpacked = ((f[:, :, None] >> np.arange(bits)) & 1).reshape(len(f), -1)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for i in range(len(ids)):
        if f[i, 0] < 0:
            continue
        d = (unpacked[i] != unpacked[i + 1 :]).sum(1)
        for j in np.flatnonzero(d <= int(N.MOST_DIFFERING * N.TABLES * bits)):
            if f[i + 1 + j, 0] >= 0:
                a, b = ids[i], ids[i + 1 + j]
                pairs.add((a, b))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in ids}


def test_recall_against_all_pairs(spark):
    docs = common.table(spark, "documents", "/root/testdata/sf0.01")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    pairs, _ = _brute([r["text"] or "" for r in rows], [r["doc_id"] for r in rows])
    keeper = {r["doc_id"]: r["keeper_id"] for r in N.groups(docs).collect()}
    together = sum(keeper.get(a, a) == keeper.get(b, b) for a, b in pairs)
    assert len(pairs) > 20 and together / len(pairs) >= 0.97


def test_many_copies_and_near_copies(spark):
    rng = random.Random(2)
    rows = []
    for g in range(5):
        base = [f"t{rng.randrange(3000)}" for _ in range(150)]
        for k in range([2, 3, 30, 400, 50][g]):
            w = base[:]
            if k and g != 3:
                for _ in range(3):
                    w[rng.randrange(150)] = f"t{rng.randrange(3000)}"
            rows.append((g * 1000 + k, " ".join(w)))
    rows += [(10_000 + k, common.words(rng, 150, 3000)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keeper = {r["doc_id"]: r["keeper_id"] for r in N.groups(docs).collect()}
    copies = [i for i, _ in rows if i < 10_000 and i % 1000]
    assert sum(keeper.get(i) == i // 1000 * 1000 for i in copies) / len(copies) > 0.97
    assert not any(i >= 10_000 for i in keeper)
    left = {r["doc_id"] for r in N.keep(docs).collect()}
    assert {0, 1000, 2000, 3000, 4000} <= left and len(left) < 70


def _keys(word, top):
    """The variants of a word in the first table, by key, with the flipped bit."""
    w = np.full((1, N.TABLES), word, np.int64)
    k = N.variants(N.senders(w, np.zeros(1, np.int64), np.zeros(1, np.int64), top)[0], top)[0]
    return {int(x >> 5): int(x & 31) for x in k if x >> 5 >> N.BITS == 0}


def test_every_pair_within_the_radius_shares_a_variant():
    rng = np.random.default_rng(0)
    for _ in range(50):
        word = int(rng.integers(0, 1 << N.BITS))
        other = word
        for b in rng.choice(N.BITS, rng.integers(0, 3), replace=False):
            other ^= 1 << int(b)
        got = [_keys(w, top) for w in (word, other) for top in (0, 7, N.BITS)]
        assert got[0] == got[1] == got[2] == {word: 0} | {word ^ 1 << i: i + 1 for i in range(N.BITS)}
        assert got[0].keys() & got[3].keys()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a long, b long").repartition(8)
    for at_once in (N.EDGES_AT_ONCE, 0):
        got = {r["node"]: r["root"] for r in N.components(edges, at_once).collect()}
        assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_edges(spark, edge):
    got = {r["doc_id"]: r["keeper_id"] for r in N.groups(edge).collect()}
    assert got[107] == 4 and got[108] == 4 and 3 not in got
    assert not {100, 101, 102, 103, None} & set(got)  # no word, or no id
    kept = N.keep(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 1 and ids.count(None) == 2 and 107 not in ids and 104 in ids and 100 in ids
    assert N.groups(common.empty(edge)).count() == 0 and N.keep(common.empty(edge)).count() == 0


def _plain(f, near):
    """The least member of each row's group, by all pairs that meet in a bucket and pass both bounds."""
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count = lambda x: np.bitwise_count(x).sum(-1)
    for i in range(len(f)):
        bits = np.bitwise_count(f[i] ^ f[i + 1 :])
        own = bits <= N.RADIUS
        sketch = np.stack([bits[:, [2, 3]].sum(1) if t < 2 else bits[:, [0, 1]].sum(1) for t in range(N.TABLES)], 1)
        # rows of one word meet by it, whatever their sketches
        met = (own & ((sketch <= N.SKETCH_MOST) | (bits == 0))).any(1)
        for j in np.flatnonzero(met & (count(f[i] ^ f[i + 1 :]) <= near)):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def _spread(rng, n, flips):
    """``n`` distinct rows around one fingerprint."""
    base = rng.integers(0, 1 << N.BITS, N.TABLES)
    out = np.repeat(base[None], n, 0)
    for row in out:
        for x in rng.integers(0, N.TABLES * N.BITS, rng.integers(1, flips + 1)):
            row[x // N.BITS] ^= 1 << int(x % N.BITS)
    return np.unique(out, axis=0)


def _groups(spark, f, **parameters):
    rows = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(f)], "doc long, f array<long>").repartition(3)
    got = {r["node"]: r["root"] for r in N.components(N.search(rows, **parameters)).collect()}
    return [got.get(i, i) for i in range(len(f))]


def test_the_same_groups_as_all_pairs_of_all_buckets(spark):
    rng = np.random.default_rng(3)
    f = np.concatenate([_spread(rng, n, k) for n, k in ((300, 8), (150, 30), (60, 45), (2, 30), (2, 30), (3, 40), (30, 60))] + [rng.integers(0, 1 << N.BITS, (100, N.TABLES))])
    f[-60:, 4] = 77  # unrelated rows that share a word
    f = rng.permutation(np.unique(f, axis=0))
    want = _plain(f, int(N.MOST_DIFFERING * N.TABLES * N.BITS))
    assert 100 < len(set(want)) < len(f) - 300
    assert _groups(spark, f) == want
    assert _groups(spark, f, hot_rows=7, top=9) == want  # hot first bits in parts


def test_hot_rows_are_dealt_and_others_meet_them_all():
    words = np.zeros((40, N.TABLES), np.int64)
    root = np.zeros(40, np.int64)
    root[:3] = np.arange(37, 40)
    hot = np.array([3 << 7], np.int64), np.array([4]), np.array([0])
    k, doc, _, _ = N.senders(words, np.arange(40), root, 7, hot)
    for r in range(40):
        part = k[(doc == r) & ((k >> N._FLIP & (1 << 32) - 1) == 3 << N.BITS)] >> N._ALL
        assert len(part) == (4 if r < 3 else 1) and (part < 4).all()
        assert (k[(doc == r) & ((k >> N._FLIP & (1 << 32) - 1) == 2 << N.BITS)] >> N._ALL).tolist() == [0]


def test_a_bucket_gives_all_its_pairs():
    for n in (6, 200):
        k = np.concatenate([np.zeros(n, np.int64) + (9 << 5), [8 << 5]])
        root = np.concatenate([np.zeros(n - 4, np.int64), [1, 2, 2, 3, 4]])
        doc = np.arange(n + 1)
        got = [tuple(p) for x in N.meetings(k, doc, root, np.zeros(n + 1, np.int64)) for p in x.tolist()]
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if root[a] != root[b]}
        assert set(got) == want
        far = np.zeros(n + 1, np.int64)
        far[n - 1] = (1 << 56) - 1
        got = {tuple(p) for x in N.meetings(k, doc, root, far) for p in x.tolist()}
        assert got == {p for p in want if n - 1 not in p}


def test_a_pair_is_found_beside_unrelated_colliders(spark):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << N.BITS, (40, N.TABLES))
    prints[:, 0] = 77  # all share one word
    prints[33, 1:] = prints[7, 1:] ^ 1  # one bit differs in every other table
    rows = [(i, [int(x) for x in f]) for i, f in enumerate(prints)]
    got = N.search(spark.createDataFrame(rows, "doc long, f array<long>")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(7, 33)]


def test_pairs_at_the_bound_are_found():
    rng = np.random.default_rng(5)
    assert N.recall() >= 0.9
    differing = rng.random((20_000, N.TABLES, N.BITS)) < N.MOST_DIFFERING
    n = differing.sum(2)
    sketch = np.stack([n[:, 2] + n[:, 3] if t < 2 else n[:, 0] + n[:, 1] for t in range(N.TABLES)], 1)
    assert ((n <= N.RADIUS) & (sketch <= N.SKETCH_MOST)).any(1).mean() > 0.89
    assert N.recall(36) < 0.9 and N.recall(40) < 0.9  # wider words would need more tables
