"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes.

Nodes are described by their subtree (text, tags, links, punctuation), their
depth, their siblings and hashed tokens of their attributes. The trees learn
from pages that mark their main text themselves (``article``, ``main`` or
``role="main"``); those marks are no features, so the model carries over to
pages without them. Decoding is a dynamic program over the tree: a node keeps
all that is below it, drops all of it, or is mixed and leaves the choice to its
children, so no node contradicts an ancestor.
"""

from __future__ import annotations

import html as _html
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the fitted sample: pages that mark their main text.
MAX_PAGES = 400
TREES, DEPTH, RATE, BINS, LEAST_ROWS, SEED = 40, 4, 0.25, 32, 20, 11
#: Evidence (log odds times characters) that a mixed node costs, and bound of the log odds of a node.
MIXED, MOST_ODDS = 20.0, 4.0
TOKENS = 24

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)(?=[\s>/])[^<>]*>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^\"'<>])*+(?=>)|[^<>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-zA-Z]+")
_PUNCTUATION = str.maketrans("", "", ".,;:!?")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("head title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Tags that an opening tag closes where they are open inside the same container.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {t: ("p",) for t in _BLOCK - {"body", "html"} - frozenset("li dt dd tr td th tbody thead tfoot".split())}
_CONTAINER = frozenset("article aside body div footer form header main nav ol section table ul".split())
_KIND = {t: k for k, names in enumerate(("p blockquote pre", "ul ol dl menu", "li dd dt", "a button label", "h1 h2 h3 h4 h5 h6", "table tr td th tbody thead tfoot", "b i em strong u small span code q sub sup mark", "img figure video picture", "form input select textarea option"), 1) for t in names.split()}
#: The class, id or role by which a page marks its main text.
MARK = "main"
_MAIN, _ASIDE = frozenset(("article", "main")), frozenset("nav aside footer form".split())


class Page:
    """The elements of a page in document order, and its pieces of text with the element that holds each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens = ["#root"], [-1], [()]
        self.pieces: list[tuple[int, str]] = []
        stack, opened = [0], {}
        at = 0
        for m in _MARK.finditer(source):
            if m.start() > at:
                self.pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                if opened.get(name):
                    while True:
                        t = self.tag[stack.pop()]
                        opened[t] -= 1
                        if t == name:
                            break
                continue
            for other in _CLOSES.get(name, ()):
                if opened.get(other):
                    k = len(stack) - 1
                    while k and self.tag[stack[k]] != other and self.tag[stack[k]] not in _CONTAINER:
                        k -= 1
                    if k and self.tag[stack[k]] == other:
                        for i in stack[k:]:
                            opened[self.tag[i]] -= 1
                        del stack[k:]
            i = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            raw = m[4]
            self.tokens.append(tuple(t.lower() for a in _ATTRIBUTE.finditer(raw) for t in _TOKEN.findall(a[2] or a[3] or a[4] or "")) if raw and "=" in raw else ())
            if name not in _VOID and not raw.endswith("/"):
                stack.append(i)
                opened[name] = opened.get(name, 0) + 1
        if at < len(source):
            self.pieces.append((stack[-1], source[at:]))


#: Columns before the hashed tokens.
COLUMNS = ("depth", "chars", "own", "tags", "density", "links", "stops", "children", "place", "siblings", "among", "share", "kind", "alike", "inside", "before")


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each element, characters of its own text)."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, stops, before = [0] * n, [0] * n, [0] * n
    seen, at = 0, 0
    for i, t in page.pieces:
        while at <= i:
            before[at] = seen
            at += 1
        k = len(t) if not t.isspace() else 0
        if k:
            own[i] += k
            stops[i] += k - len(t.translate(_PUNCTUATION))
            seen += k
    before[at:] = [seen] * (n - at)
    hidden = [t in _HEAD for t in page.tag]
    chars, tags, dots, linked, children, depth = own[:], [1] * n, stops[:], [0] * n, [0] * n, [0] * n
    kind = [_KIND.get(t, 0) for t in page.tag]
    inside, place, alike = [0] * n, [0] * n, [0] * n
    first: dict = {}
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
        key = (p, page.tag[i])
        first[key] = first.get(key, 0) + 1
        inside[i] = inside[p] or kind[i] in (2, 3)
        hidden[i] = hidden[i] or hidden[p]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i]
        dots[p] += dots[i]
        if kind[i] == 4:
            linked[i] = chars[i]
        linked[p] += linked[i]
        alike[i] = first[p, page.tag[i]]
    chars_, tags_, own_, kids = np.array(chars, float), np.array(tags, float), np.array(own, float), np.array(children, float)
    up = np.maximum(parent, 0)
    around = np.maximum(kids[up] - 1, 0)
    x = np.zeros((n, len(COLUMNS) + TOKENS), np.float32)
    x[:, 0] = depth
    x[:, 1] = np.log1p(chars_)
    x[:, 2] = np.log1p(own_)
    x[:, 3] = np.log1p(tags_)
    x[:, 4] = np.log1p(chars_ / tags_)
    x[:, 5] = np.array(linked) / np.maximum(chars_, 1)
    x[:, 6] = np.array(dots) / np.maximum(chars_, 1)
    x[:, 7] = kids
    x[:, 8] = np.array(place) / np.maximum(around, 1)
    x[:, 9] = around
    x[:, 10] = np.log1p(np.maximum(chars_[up] - own_[up] - chars_, 0) / np.maximum(around, 1))
    x[:, 11] = chars_ / np.maximum(chars_[up], 1)
    x[:, 12] = kind
    x[:, 13] = alike
    x[:, 14] = inside
    x[:, 15] = np.array(before) / max(seen, 1)
    for i, words in enumerate(page.tokens):
        for w in words:
            if w == MARK:  # it says what is to be learned
                continue
            x[i, len(COLUMNS) + zlib.crc32(w.encode("utf-8", "replace")) % TOKENS] = 1
    own_[np.array(hidden)] = 0
    return x, own_


def marks(page: Page) -> np.ndarray | None:
    """1 inside the main text that the page marks, 0 outside of it, -1 for what holds both; None without a mark."""
    n = len(page.tag)
    state = [0] * n
    main = [t in _MAIN or (t not in _VOID and MARK in page.tokens[i] and t == "div") for i, t in enumerate(page.tag)]
    if not any(main):
        return None
    for i in range(1, n):
        p = state[page.parent[i]]
        state[i] = 0 if page.tag[i] in _ASIDE else 1 if main[i] or p == 1 else 0
    out = np.array(state)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if out[p] == 0 and out[i] != 0:
            out[p] = -1
    return out


class Trees:
    """Boosted regression trees with the logistic loss on features cut into bins, grown level by level."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        b = self._binned(x).astype(np.int64)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.column, self.cut, self.leaf = [], [], []
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            column, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)  # at 255 all go left
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                width = 2**level
                best = np.full(width, 1e-6)
                for j in range(b.shape[1]):
                    if not len(self.edges[j]):
                        continue
                    k = node * self.bins + b[:, j]
                    size = width * self.bins
                    gs, hs, ns = (np.bincount(k, weights=w, minlength=size).reshape(width, -1).cumsum(1) for w in (g, h, None))
                    gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = -1
                    top = gain.argmax(1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    at = np.flatnonzero(better) + width - 1
                    best[better], column[at], cut[at] = value[better], j, top[better]
                at = node + width - 1
                node = node * 2 + (b[np.arange(len(y)), column[at]] > cut[at])
            leaf = self.rate * np.bincount(node, weights=g, minlength=2**self.depth) / (np.bincount(node, weights=h, minlength=2**self.depth) + 1)
            f += leaf[node]
            self.column.append(column)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        b = self._binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, cut, leaf in zip(self.column, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (b[rows, column[at]] > cut[at])
            out += leaf[node]
        return out


def train(sources: list[str]) -> Trees | None:
    """Trees from the pages that mark their main text; None where no page does."""
    xs, ys = [], []
    for s in sources:
        page = Page(s)
        y = marks(page)
        if y is not None:
            x, _ = features(page)
            told = (y >= 0) & (x[:, 1] > 0)
            xs.append(x[told])
            ys.append(y[told])
    if not xs or len(set(np.concatenate(ys))) < 2:
        return None
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


DROPPED, KEPT, MIXED_CHOICE = 0, 1, 2


def decode(parent: list[int], evidence: np.ndarray) -> list[int]:
    """The best choice for each node: all below it kept, all dropped, or mixed; below a mixed node its own text is kept where its evidence is positive."""
    n = len(parent)
    own = evidence.tolist()
    whole, split = own[:], [max(0.0, e) - MIXED for e in own]
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        best[i] = max(whole[i], split[i], 0.0)
        if i:
            whole[parent[i]] += whole[i]
            split[parent[i]] += best[i]
    out = [0] * n
    for i in range(n):
        above = out[parent[i]] if i else MIXED_CHOICE
        if above == MIXED_CHOICE:
            out[i] = KEPT if whole[i] > 0 and whole[i] >= split[i] else MIXED_CHOICE if split[i] > 0 else DROPPED
        else:
            out[i] = above
    return out


def _text(page: Page, choice: list[int], evidence: np.ndarray) -> str:
    lines: list[str] = []
    run: list[str] = []
    last = -1
    tag, parent = page.tag, page.parent

    def block(i):
        while i > 0 and tag[i] not in _BLOCK:
            i = parent[i]
        return i

    for i, t in page.pieces:
        if (choice[i] == KEPT or choice[i] == MIXED_CHOICE and evidence[i] > 0) and not t.isspace():
            b = block(i)
            if b != last and run:
                lines.append("".join(run))
                run = []
            run.append(t)
            last = b
        elif run and t.isspace():
            run.append(" ")
    if run:
        lines.append("".join(run))
    lines = [_SPACE.sub(" ", _html.unescape(x)).strip() for x in lines]
    return "\n".join(x for x in lines if x)


def extract(sources: list[str], trees: Trees | None) -> list[tuple[str, int, int]]:
    """(main text, elements, elements kept whole) of each page; without trees all visible text is kept."""
    pages = [Page(s) for s in sources]
    made = [features(p) for p in pages]
    if not made:
        return []
    if trees is None:
        odds = np.ones(sum(len(x) for x, _ in made))
    else:
        odds = np.clip(trees.predict(np.concatenate([x for x, _ in made])), -MOST_ODDS, MOST_ODDS)
    out, at = [], 0
    for page, (x, own) in zip(pages, made):
        evidence = odds[at : at + len(x)] * own
        at += len(x)
        choice = decode(page.parent, evidence)
        out.append((_text(page, choice, evidence), len(x) - 1, sum(1 for c in choice[1:] if c == KEPT)))
    return out


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, seed: int = SEED) -> Trees | None:
    """Trees fitted on at most ``max_pages`` pages that mark their main text, picked by a hash of the id."""
    marked = pages.where(F.lower("html").rlike(r"<(article|main)[\s>]|<div\s[^>]*\bmain\b"))
    key = F.struct(F.xxhash64("page_id", F.lit(seed)), F.xxhash64("html"))
    # the bound of the sample comes first, so that no task sends more pages than are in it
    last = marked.select(key.alias("k")).distinct().orderBy("k").limit(max_pages).agg(F.max("k.col1").alias("a"), F.max_by("k.col2", "k").alias("b")).first()
    if last["a"] is None:
        return None
    rows = marked.select(key.alias("k"), "html").where((F.col("k.col1") < last["a"]) | (F.col("k.col1") == last["a"]) & (F.col("k.col2") <= last["b"]))
    return train([r["html"] for r in rows.groupBy("k").agg(F.min("html").alias("html")).orderBy("k").collect()])


def main_text(spark: SparkSession, pages: DataFrame, **parameters) -> DataFrame:
    """(page_id, text, n_nodes, n_kept) of every page: its main text, one line for each block.

    Null and empty pages give an empty text and no nodes. Tags without an end,
    stray ends, comments and scripts are handled as browsers do in the main;
    what is no tag is text. Where no page marks its main text there is nothing
    to learn from, and all visible text is kept. Repeated rows give a row each;
    pages are read whole; other columns are ignored; an empty table gives an
    empty result.
    """
    shared = spark.sparkContext.broadcast(fit(pages, **parameters))

    def f(batches):
        for b in batches:
            sources = [s or "" for s in b.column(1).to_pylist()]
            for i in range(0, len(sources), 200):
                rows = extract(sources[i : i + 200], shared.value)
                text, nodes, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(rows)), pa.array(text, pa.string()), pa.array(nodes, pa.int32()), pa.array(kept, pa.int32())], names=["page_id", "text", "n_nodes", "n_kept"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(f, "page_id long, text string, n_nodes int, n_kept int")


def log_loss(trees: Trees, x: np.ndarray, y: np.ndarray) -> float:
    f = trees.predict(x)
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -f, f)))) if len(y) else math.nan
