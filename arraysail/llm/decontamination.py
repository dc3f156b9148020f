"""Benchmark decontamination: an FM-index for each training shard.

A shard is a slice of the documents of a partition. Its words are mapped to the
alphabet of the benchmark (words that no test item has become separators, which
no phrase can cross, and stretches shorter than a phrase cannot hold one and
are left out). Over the rest stand a suffix array, its Burrows-Wheeler
transform in a wavelet tree with rank counts, and sampled suffix positions. All
test phrases are searched backwards at once; occurrences walk to the nearest
sampled position; their spans are merged for each document.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.llm import _common as C

#: Words of a test phrase; shorter items are one phrase. Items under ``LEAST_WORDS`` words are no phrase: by default only those without a word.
PHRASE, LEAST_WORDS = 8, 1
SAMPLE = 8
SHARD_BYTES = 8_000_000
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """Lower case that keeps every position."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def phrases(items: list[str | None], least_words: int = LEAST_WORDS) -> tuple[dict[str, int], dict[int, np.ndarray]]:
    """Word numbers from 2 on, and the distinct phrases by their length."""
    vocabulary: dict[str, int] = {}
    found: dict[int, set] = {}
    for item in items:
        words = _WORD.findall(fold(item or ""))
        n = min(PHRASE, len(words))
        if n < max(1, least_words):
            continue
        ids = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words]
        found.setdefault(n, set()).update(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1))
    return vocabulary, {n: np.array(sorted(x), np.int64) for n, x in found.items()}


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last symbol must be the only least one."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, k = len(s), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class WaveletTree:
    """Ranks of any symbol in a sequence, one bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = s[np.argsort(bit, kind="stable")]
        # where each symbol starts after the last level
        self.start = np.searchsorted(s_sorted_key(s, self.bits), s_key(np.arange(1 << self.bits), self.bits))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        for level, b in enumerate(reversed(range(self.bits))):
            one = self.ones[level][at]
            at = np.where((symbol >> b) & 1, self.zeros[level] + one, at - one)
        return at - self.start[symbol]

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = self.ones[level][at]
            bit = self.ones[level][at + 1] - one
            out = out * 2 + bit
            at = np.where(bit, self.zeros[level] + one, at - one)
        return out


def s_key(symbols: np.ndarray, bits: int) -> np.ndarray:
    """The order of the last level: by reversed bits."""
    out = np.zeros(len(symbols), np.int64)
    for b in range(bits):
        out = out * 2 + ((symbols >> b) & 1)
    return out


def s_sorted_key(s: np.ndarray, bits: int) -> np.ndarray:
    return s_key(s, bits)


class FMIndex:
    """Backward search in a sequence that ends with its only 0."""

    def __init__(self, s: np.ndarray):
        sa = suffix_array(s)
        self.tree = WaveletTree(s[sa - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << self.tree.bits))])
        sampled = sa % SAMPLE == 0
        self.sampled, self.place, self.value = sampled, np.cumsum(sampled) - 1, sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns (rows of symbols)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.sampled), np.int64)
        known = patterns.max(axis=1) < 1 << self.tree.bits
        hi[~known] = 0
        for c in np.where(known[:, None], patterns, 0).T[::-1]:
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
            hi = np.maximum(hi, lo)
        hi[~known] = lo[~known]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, at = np.zeros(len(rows), np.int64), rows.copy()
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            c = self.tree.symbol(at[todo])
            at[todo] = self.before[c] + self.tree.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.value[self.place[at]] + steps


def shard_hits(texts: list[str], vocabulary: dict[str, int], by_length: dict[int, np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """Ranges of words that are a test phrase, by index of the text; texts without one are left out."""
    if not by_length or not texts:
        return {}
    least = min(by_length)
    n, ids, get = np.zeros(len(texts), np.int64), [], vocabulary.get
    for i, t in enumerate(texts):
        words = _WORD.findall(fold(t))
        n[i] = len(words)
        ids.append(np.fromiter(map(get, words, repeat(1)), np.int32, len(words)))
    ids = np.concatenate(ids)
    ends = np.cumsum(n)
    known = ids > 1
    # runs of known words of one document, of the least phrase length at least
    cut = np.zeros(len(ids) + 1, bool)
    cut[np.concatenate([[0], ends])] = True
    starts = np.flatnonzero(known & (cut[:-1] | ~np.concatenate([[False], known[:-1]])))
    stops = np.flatnonzero(known & (cut[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = stops - starts >= least
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return {}
    size = stops - starts + 1
    total = int(size.sum())
    base = np.repeat(starts - (np.cumsum(size) - size), size)
    place = np.arange(total) + base
    inside = place < np.repeat(stops, size)
    s = np.ones(total + 1, np.int64)
    s[:-1][inside] = ids[place[inside]]
    s[-1] = 0
    index = FMIndex(s)
    first, last = [], []
    for length, patterns in by_length.items():
        lo, hi = index.search(patterns)
        hit = hi > lo
        k = (hi - lo)[hit]
        rows = np.repeat(lo[hit] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        at = place[index.locate(rows)]
        first.append(at)
        last.append(at + length)
    first, last = np.concatenate(first), np.concatenate(last)
    doc = np.searchsorted(ends, first, side="right")
    order = np.argsort(doc, kind="stable")
    found, at = np.unique(doc[order], return_index=True)
    begin = ends[found] - n[found]
    return {int(d): list(zip((first[i] - b).tolist(), (last[i] - b).tolist())) for d, b, i in zip(found, begin, np.split(order, at[1:]))}


def merged(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of ranges of words; ranges that overlap or follow one another are one span."""
    words_at = [m.span() for m in _WORD.finditer(fold(text))]
    spans: list[list[int]] = []
    for i, j in sorted(hits):
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], j)
        else:
            spans.append([i, j])
    return [(words_at[i][0], words_at[j - 1][1]) for i, j in spans]


def shard_spans(texts: list[str], parts) -> dict[int, list[tuple[int, int]]]:
    """Merged character spans by index of the text, over parts (vocabulary, phrases by length) of the benchmark."""
    hits: dict[int, list[tuple[int, int]]] = {}
    for vocabulary, by_length in parts:
        for d, found in shard_hits(texts, vocabulary, by_length).items():
            hits.setdefault(d, []).extend(found)
    return {d: merged(texts[d], hits[d]) for d in sorted(hits)}


#: Characters of test items whose phrases are held at once, by the driver and by a task.
PART_CHARS = 4_000_000


class _Parts:
    """The phrases of the benchmark in broadcast parts of bounded size, of which a task holds one at a time."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, least_words: int = LEAST_WORDS):
        self.parts, self.least_words, items, size = [], least_words, [], 0
        for (text,) in benchmark.select("text").toLocalIterator():
            items.append(text)
            size += len(text or "")
            if size >= PART_CHARS:
                self._add(spark, items)
                items, size = [], 0
        self._add(spark, items)

    def _add(self, spark: SparkSession, items: list[str | None]) -> None:
        part = phrases(items, self.least_words)
        if part[1]:
            self.parts.append(spark.sparkContext.broadcast(part))

    def __iter__(self):
        for b in self.parts:
            yield b.value
            if len(self.parts) > 1:
                b.__dict__.pop("_value", None)  # read again from the local copy when it is needed


def _finder(spark: SparkSession, benchmark: DataFrame, least_words: int):
    """A function from a column of texts to (index, text, spans) of those that hold a phrase; a slice of the column is a shard."""
    parts = _Parts(spark, benchmark, least_words)

    def find(column: pa.Array):
        if parts.parts:
            for i, _, texts in C.text_slices(column, SHARD_BYTES):
                for k, spans in shard_spans(texts, parts).items():
                    yield i + k, texts[k], spans

    return find


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, spans, cleaned) of the documents that hold test phrases: merged spans [start, end) in characters, and the text without them.

    Null texts and items are empty; empty texts hold nothing. Items of
    fewer than ``least_words`` words are left out; by default every item with a
    word is searched. Repeated rows give a row each. Whole
    texts are searched; other columns are ignored. Empty tables give an empty result.
    """
    find = _finder(spark, benchmark, least_words)

    def f(batches):
        for b in batches:
            found = list(find(b.column(1)))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array([i for i, _, _ in found], pa.int64())),
                pa.array([[{"start": x, "end": y} for x, y in spans] for _, _, spans in found], kind),
                pa.array([without(text, spans) for _, text, spans in found], pa.string()),
            ], names=["doc_id", "spans", "cleaned"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, spans array<struct<start: int, end: int>>, cleaned string")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the spans taken out of ``text`` and ``n_chars`` counted anew where it is there; rows without a hit are unchanged.

    Null, empty, repeated and very long texts and empty tables are treated as in
    :func:`contaminated`; null texts stay null and extra columns stay as they are.
    """
    find = _finder(spark, benchmark, least_words)

    def f(text: pa.Array) -> pa.Array:
        new = {i: without(t, spans) for i, t, spans in find(text)}
        if not new:
            return text
        at = np.zeros(len(text), bool)
        at[list(new)] = True
        return pc.replace_with_mask(text, pa.array(at), pa.array([new[i] for i in sorted(new)], text.type))

    new = C.fresh(docs, "text")
    out = docs.withColumn(new, F.arrow_udf(f, "string").asNondeterministic()(docs["text"]))
    columns = [F.col(new).alias(c) if c == "text" else F.when(F.col(new) == F.col("text"), F.col(c)).otherwise(F.length(new)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*columns)
