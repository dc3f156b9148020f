import itertools
import random
import re

import common
import numpy as np
import pytest

from arraysail.llm import html_extraction as H


def _choices(parent, own):
    """The greatest objective over all choices of kept, dropped and mixed nodes that don't contradict an ancestor."""
    n, best = len(parent), -np.inf
    for c in itertools.product((H.DROPPED, H.KEPT, H.MIXED_CHOICE), repeat=n):
        if any(i and c[parent[i]] != H.MIXED_CHOICE and c[i] != c[parent[i]] for i in range(n)):
            continue
        best = max(best, sum(own[i] if c[i] == H.KEPT else max(0, own[i]) - H.MIXED if c[i] == H.MIXED_CHOICE else 0 for i in range(n)))
    return best


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 8)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        own = np.array([rng.choice([-80, -30, -5, 0, 5, 30, 80]) * 1.0 + rng.random() for _ in range(n)])
        got = H.decode(parent, own)
        assert all(not i or got[parent[i]] == H.MIXED_CHOICE or got[i] == got[parent[i]] for i in range(n))
        value = sum(own[i] if got[i] == H.KEPT else max(0, own[i]) - H.MIXED if got[i] == H.MIXED_CHOICE else 0 for i in range(n))
        assert value == pytest.approx(_choices(parent, own))


def test_parser():
    p = H.Page('<html><body><!-- <p>no --><p class="a b">one<b>two<br>x<p>three</body><ul><li>a<li>b</ul><script>var t="</p>";</script><a href=x>l</a></z><td>c')
    names = [(t, p.tag[p.parent[i]]) for i, t in enumerate(p.tag) if i]
    assert names == [("html", "#root"), ("body", "html"), ("p", "body"), ("b", "p"), ("br", "b"), ("p", "body"), ("ul", "html"), ("li", "ul"), ("li", "ul"), ("a", "html"), ("td", "html")]
    assert [t for _, t in p.pieces] == ["one", "two", "x", "three", "a", "b", "l", "c"]
    assert p.tokens[3] == ("a", "b")
    assert H.Page("1 < 2 & 3 > 2").pieces == [(0, "1 < 2 & 3 > 2")]


def test_trees_fit_and_generalise():
    rng = np.random.default_rng(0)
    f = lambda x: ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    x, z = rng.normal(size=(4000, 5)), rng.normal(size=(2000, 5))
    t = H.Trees(trees=60).fit(x, f(x))
    assert ((t.predict(z) > 0) == f(z)).mean() > 0.95
    assert H.log_loss(t, z, f(z)) < 0.3
    one = H.Trees(trees=1, depth=1, rate=1.0).fit(x[:, :1], (x[:, 0] > 0).astype(float))
    assert ((one.predict(z[:, :1]) > 0) == (z[:, 0] > 0)).mean() > 0.95


def _held_out(pages, docs, trees):
    kept = noise = total = 0
    for url, html in pages:
        want = docs[int(re.search(r"/(\d+)(?:[/.?#]|$)", re.sub(r"^https?://[^/]*", "", url))[1])].split()
        got = H.extract([html], trees)[0][0].split()
        a, b = set(want), set(got)
        kept += sum(w in b for w in want)
        total += len(want)
        noise += sum(w not in a for w in got)
    return kept / total, noise / total


def test_held_out_pages_with_and_without_marks(spark):
    pages = [(r["url"], r["html"]) for r in common.table(spark, "pages", "/root/testdata/sf0.01").orderBy("page_id").collect()]
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, "documents", "/root/testdata/sf0.01").collect()}
    trees = H.train([h for _, h in pages[:120]])
    kept, noise = _held_out(pages[120:], docs, trees)
    assert kept > 0.97 and noise < 0.03
    bare = [(u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for u, h in pages[120:]]
    kept, noise = _held_out(bare, docs, trees)
    assert kept > 0.95 and noise < 0.05


def test_query_and_edges(spark):
    from pyspark.sql import functions as F

    pages = common.table(spark, "pages")
    got = H.main_text(spark, pages)
    assert got.columns == ["page_id", "text", "n_nodes", "n_kept"] and got.count() == pages.count()
    rows = [(1, None), (2, ""), (3, "no tags"), (4, "<p>" * 3000 + "deep" + "</p>" * 10), (5, "<div>" * 20_000 + "deeper"), (6, "<<<>>> < p <a <b \"<c 'x>y"), (7, "<!-- open " + "x" * 100_000), (8, "<script>never closed"), (None, "<p>null id</p>"), (9, "<p>&amp;&lt;&#233;&bogus;</p>"), (9, "<p>&amp;&lt;&#233;&bogus;</p>"), (10, "<a " * 50_000), (11, "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit(1) for c in ("text", "n_nodes", "n_kept", "url", "x")})
    out = H.main_text(spark, df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[1]["text"] == by[2]["text"] == "" and by[1]["n_nodes"] == 0
    assert by[3]["text"] == "no tags" and by[9]["text"] == "&<é&bogus;" and by[8]["text"] == "" and by[5]["text"] == "deeper"
    assert H.main_text(spark, common.empty(df)).count() == 0


def test_marks_are_no_features():
    page = '<div {}><p class="lead">Some text.</p></div><div class="side">More.</div>'
    bare = H.features(H.Page(page.format('class="body"')))[0]
    for mark in ('role="main"', 'class="main"', 'id="main"'):
        p = H.Page(page.format(mark))
        assert H.marks(p) is not None
        x = H.features(p)[0]
        assert not x[1, len(H.COLUMNS):].any() and (x[2:] == bare[2:]).all()
    assert bare[1, len(H.COLUMNS):].any()


def test_pages_with_any_mark_are_learned_from(spark):
    html = '<body><div {}><p>' + "Real text of some length, with commas. " * 5 + '</p></div><div class="x"><a>menu</a></div></body>'
    for mark in ('role="main"', "class='big main'", "id=main"):
        assert H.fit(spark.createDataFrame([(1, html.format(mark)), (2, html.format("class=maintain"))], "page_id long, html string")) is not None
    assert H.fit(spark.createDataFrame([(2, html.format('class="mainly"'))], "page_id long, html string")) is None
