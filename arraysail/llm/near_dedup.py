"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint is ``TABLES`` words of ``BITS`` SimHash bits over its
distinct words. In each table two words within ``RADIUS`` = 2 bits share at
least one variant of at most one flipped bit (half the radius), so every
word emits its ``BITS + 1`` variants, rows meet by a shuffle on the variant, and
the pairs of a bucket are verified over all bits of the fingerprint. Verified
pairs are joined into groups by connected components. The shuffle goes by the
first bits of the variant, as many as the logarithm of the rows: the variants
that agree in them travel as one row and are written out where they arrive.

Width, radius and number of tables are the same at every size, chosen so that a
pair at the bound of ``MOST_DIFFERING`` is found with a chance of over 0.9
(independent bits).

Large groups of copies are never expanded into all pairs. Equal fingerprints
stand for one row. Rows of an equal word are first compared with the least of
them, and verified links give each row a root; a bucket then compares only rows
of different roots, which loses no connection: what it leaves out is in one
group already. A row carries a sketch of its other words, by which unrelated
rows of a bucket are told apart before anything is written. Buckets of common
first bits with more than ``HOT`` rows are split: rows of their main root go to
one part each, all others to every part.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraysail.llm import _common as C

BITS, TABLES, RADIUS = 28, 9, 2
#: Largest share of differing fingerprint bits of a verified pair (an angle of about 0.44 between the sets of words).
MOST_DIFFERING = 0.14
#: Differing bits of two sketches (two words of other tables) up to which a pair is verified; a pair at the bound has more in one of 2 000 cases.
SKETCH_MOST = 17
_FIND = re.compile(r"\w+").findall
#: Variants that one task sorts at once, and rows with the same first bits that a task takes.
ROWS_PER_TASK, HOT = 800_000, 50_000
#: Rows that share their first bits, on average, and hot first bits that the driver names at most; ``HOT`` grows where there would be more.
ROWS_TOGETHER, MOST_HOT = 2_000, 20_000
#: Edges (16 bytes each) whose components one task finds.
EDGES_AT_ONCE = 1_000_000
#: Buckets up to this size are compared side by side.
_SMALL = 48
#: Bits below the key, for the number of the flipped bit, and of the key with them; parts are numbered above.
_FLIP, _ALL = 5, 37


def recall(bits: int = BITS, tables: int = TABLES, share: float = MOST_DIFFERING) -> float:
    """Chance that a pair with this share of differing bits has a word within ``RADIUS`` bits in some table."""
    near = sum(math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(RADIUS + 1))
    return 1 - (1 - near) ** tables


class Signs:
    """Rows of +-1 for words, kept up to ``limit`` words."""

    def __init__(self, bits: int, limit: int = 100_000):
        self.bits, self.limit = bits, limit
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.rows = np.empty((1024, self.bits), np.int8)

    def index(self, sets: list[set]) -> list[list[int]]:
        if len(self.at) > self.limit:
            self.clear()
        new = list(set().union(*sets).difference(self.at))
        if new:
            start = len(self.at)
            size = -(-self.bits // 8)
            raw = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=size).digest() for w in new), np.uint8).reshape(-1, size)
            if start + len(new) > len(self.rows):
                grown = np.empty((max(2 * len(self.rows), start + len(new)), self.bits), np.int8)
                grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start : start + len(new)] = np.unpackbits(raw, axis=1)[:, : self.bits].astype(np.int8) * 2 - 1
            self.at.update(zip(new, range(start, start + len(new))))
        get = self.at.__getitem__
        return [list(map(get, s)) for s in sets]


_SIGNS: dict[int, Signs] = {}


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, TABLES) words; texts without a word get -1 in every table."""
    signs = _SIGNS.setdefault(TABLES * BITS, Signs(TABLES * BITS))
    out = np.full((len(texts), TABLES), -1, np.int64)
    weight = np.int64(1) << np.arange(BITS, dtype=np.int64)
    for i, j in C.slices(texts, 500_000):
        sets = [set(_FIND(t.lower())) for t in texts[i:j]]
        for k, at in enumerate(signs.index(sets), i):
            if at:
                total = signs.rows[at].sum(axis=0, dtype=np.int32)
                out[k] = (total > 0).reshape(TABLES, BITS) @ weight
    return out


def _fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([None if w[0] < 0 else w.tolist() for w in C.by_slices(text, fingerprints)], pa.list_(pa.int64()))


_ROW = "k long, doc long, root long, sketch long"


def senders(words: np.ndarray, doc: np.ndarray, root: np.ndarray, top: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(k, doc, root, sketch): each word as it is, and with each one of its ``top`` first bits flipped.

    ``k`` is the part, the table, the variant and the number of its flipped bit
    (0 for none). ``hot`` has the sorted first bits (with the table) that are
    dealt to parts, the number of parts and the main root of each.
    """
    flips = np.concatenate([[0], np.int64(1) << np.arange(BITS - top, BITS, dtype=np.int64)])
    number = np.concatenate([[0], np.arange(BITS - top, BITS) + 1])
    tables, n = np.arange(TABLES, dtype=np.int64), top + 1
    key = ((words | (tables << BITS))[:, :, None] ^ flips).reshape(-1)
    # the sketch is the words of two tables that are not the row's own
    sketch = np.where(tables < 2, (words[:, 2] << BITS | words[:, 3])[:, None], (words[:, 0] << BITS | words[:, 1])[:, None])
    sketch = np.repeat(sketch.reshape(-1), n)
    doc, root = np.repeat(doc, TABLES * n), np.repeat(root, TABLES * n)
    k = key << _FLIP | np.tile(number, len(key) // n)
    if hot is not None and len(hot[0]):
        first = key >> (BITS - top)
        at = np.minimum(np.searchsorted(hot[0], first), len(hot[0]) - 1)
        parts = np.where(hot[0][at] == first, hot[1][at], 1)
        one = (parts == 1) | (root == hot[2][at])
        part = np.where(parts == 1, 0, (doc * np.int64(0x9E3779B1) >> 8) % parts)
        times = np.where(one, 1, parts)
        again = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        k, doc, root, sketch = (np.repeat(x, times) for x in (k, doc, root, sketch))
        k |= np.where(np.repeat(one, times), np.repeat(part, times), again) << _ALL
    return k, doc, root, sketch


def variants(k: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants with the first bits of the rows of :func:`senders`, and the row of each."""
    own = np.flatnonzero(k & ((1 << _FLIP) - 1) == 0)
    bits = np.arange(BITS - top, dtype=np.int64)
    more = (k[own, None] ^ (np.int64(1) << (bits + _FLIP))) | (bits + 1)
    return np.concatenate([k, more.ravel()]), np.concatenate([np.arange(len(k)), np.repeat(own, len(bits))])


def _senders(top: int, hot):
    """(doc, root, f) to the rows of :func:`senders`."""

    def f(batches):
        for b in batches:
            words = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, TABLES)
            doc, root = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(0, len(doc), 1024):
                j = i + 1024
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in senders(words[i:j], doc[i:j], root[i:j], top, hot.value)], names=["k", "doc", "root", "sketch"])

    return f


def meetings(k: np.ndarray, doc: np.ndarray, root: np.ndarray, sketch: np.ndarray):
    """Arrays (a, b) of the pairs of different roots and similar sketches in the same bucket; those of one word in its own bucket alone."""
    bucket = k >> _FLIP
    order = np.argsort(bucket)
    bucket = bucket[order]
    same = bucket[1:] == bucket[:-1]
    both = np.zeros(len(bucket), bool)
    both[1:] |= same
    both[:-1] |= same
    bucket, order = bucket[both], order[both]
    by = np.lexsort((root[order], bucket))
    bucket, order = bucket[by], order[by]
    if not len(order):
        return
    k, doc, root, sketch = k[order], doc[order], root[order], sketch[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    mixed = root[first] != root[first + size - 1]
    flip = k & ((1 << _FLIP) - 1)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = (root[x] != root[y]) & ((flip[x] != flip[y]) | (flip[x] == 0))
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(sketch[x] ^ sketch[y]) <= SKETCH_MOST
        x, y = doc[x[ok]], doc[y[ok]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)

    left = np.repeat(np.where(mixed & (size <= _SMALL), size, 0), size)
    place = np.arange(len(bucket)) - np.repeat(first, size)
    for apart in range(1, _SMALL):
        x = np.flatnonzero(place + apart < left)
        if not len(x):
            break
        for i in range(0, len(x), 500_000):
            yield near(x[i : i + 500_000], x[i : i + 500_000] + apart)
    for i, n in zip(first[mixed & (size > _SMALL)], size[mixed & (size > _SMALL)]):
        here = np.arange(i, i + n)
        ends = np.append(np.flatnonzero(root[here[1:]] != root[here[:-1]]) + 1, n)
        starts = np.concatenate([[0], ends[:-1]])
        main = int(np.argmax(ends - starts))
        # every row outside the main root meets all rows; the main root's rows meet nothing among themselves
        for x in np.delete(here, slice(starts[main], ends[main])):
            yield near(np.full(n, x), here)


def _meetings(top: int):
    def f(batches):
        parts = [tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)) for b in batches]
        if not parts:
            return
        k, *rest = (np.concatenate(x) for x in zip(*parts))
        first = k >> (_FLIP + BITS - top)
        order = np.argsort(first, kind="stable")
        first = first[order]
        ends = np.append(np.flatnonzero(first[1:] != first[:-1]) + 1, len(first))
        held, n, start = [], 0, 0
        while start < len(first):
            # whole groups of common first bits, up to a number of rows
            stop = int(ends[min(np.searchsorted(ends, start + ROWS_PER_TASK // (BITS - top + 1)), len(ends) - 1)])
            here, start = order[start:stop], stop
            all_k, row = variants(k[here], top)
            row = here[row]
            for pairs in meetings(all_k, *(x[row] for x in rest)):
                held.append(pairs)
                n += len(pairs)
                if n >= 1_000_000:
                    yield from _distinct(held)
                    held, n = [], 0
        yield from _distinct(held)

    return f


def _distinct(held: list[np.ndarray]):
    if held:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs
        for i in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000, 0]), pa.array(pairs[i : i + 100_000, 1])], names=["a", "b"])


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that are not the least of their component."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while (apart := root[u] != root[v]).any():
        u, v = u[apart], v[apart]
        x, y = root[u], root[v]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    linked = root != np.arange(len(node))
    return node[linked], node[root[linked]]


def _contracted(batches):
    """Edges (u, v) to stars of the same components, two million at a time."""
    held, n = [], 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += len(b)
        if held and (b is None or n >= 2_000_000):
            u, v = contracted(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], names=["u", "v"])
            held, n = [], 0


def components(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(node, root): each node of the edges (a, b) and the least node of its component.

    Every partition first replaces its edges by stars. Up to ``at_once`` edges
    are then finished by one task; more by large-star and small-star steps in
    turn until neither changes the edges, whose number of rounds grows with the
    logarithm of the size. The result is the same.
    """
    now, mark = C.cut(edges.select("a", "b").mapInArrow(_contracted, "u long, v long")), None
    if now.count() <= at_once:
        return C.cut(now.repartition(1).mapInArrow(_contracted, "u long, v long")).select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = C.cut(small)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = got


def _verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints differ in few enough bits."""
    fa, fb = prints.select(F.col("doc").alias("a"), F.col("f").alias("fa")), prints.select(F.col("doc").alias("b"), F.col("f").alias("fb"))
    differing = sum((F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(TABLES)), F.lit(0))
    return pairs.join(fa, "a").join(fb, "b").where(differing <= int(MOST_DIFFERING * TABLES * BITS)).select("a", "b")


def search(prints: DataFrame, hot_rows: int = HOT, top: int | None = None) -> DataFrame:
    """Verified links (a, b) between documents (doc, f), f the words of all tables.

    They join exactly what all verified pairs of all buckets would join. ``top``,
    the first bits by which rows meet, and ``hot_rows`` change no result.
    """
    spark = prints.sparkSession
    key = F.col("col").bitwiseOR(F.shiftleft(F.col("pos").cast("long"), BITS)).alias("key")
    words = prints.select("doc", F.posexplode("f")).select(key, "doc")
    least = words.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    near = words.join(least, "key").where("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct()
    first = components(_verified(near, prints))
    rooted = C.cut(prints.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("root", "doc").alias("root"), "f"))
    n = rooted.count()
    top = min(BITS, max(6, math.ceil(math.log2(max(n, 1) / ROWS_TOGETHER)))) if top is None else top
    hot = spark.sparkContext.broadcast(_hot(rooted, top, max(hot_rows, n * TABLES // MOST_HOT)))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n * TABLES * (BITS + 1) / ROWS_PER_TASK))
    rows = rooted.mapInArrow(_senders(top, hot), _ROW)
    pairs = rows.repartition(tasks, F.shiftright("k", _FLIP + BITS - top)).mapInArrow(_meetings(top), "a long, b long").distinct()
    return _verified(pairs, prints).unionByName(first.select(F.col("root").alias("a"), F.col("node").alias("b")))


def _hot(rooted: DataFrame, top: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bits (with the table) of more than ``rows`` rows, the parts of each and the root of the most rows."""
    first = F.shiftright(F.col("col").bitwiseOR(F.shiftleft(F.col("pos").cast("long"), BITS)), BITS - top).alias("first")
    by = rooted.select("root", F.posexplode("f")).select("root", first).groupBy("first", "root").agg(F.count("*").alias("n"))
    # at most TABLES times all rows by ``rows``, which is MOST_HOT at most
    found = by.groupBy("first").agg(F.sum("n").alias("all"), F.max_by("root", F.struct("n", "root")).alias("root")).where(F.col("all") > rows).orderBy("first").collect()
    return tuple(np.array(x, np.int64) for x in ([r["first"] for r in found], [-(-r["all"] // rows) for r in found], [r["root"] for r in found]))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keeper_id) of all documents that are copies of another one, the one with the least id of their group.

    Null ids and texts without a word (null, empty, symbols alone) are in no
    group. Repeated rows of one id count as one document. Ties go to the least
    id. Whole texts are read, other columns ignored; an empty table gives an
    empty result.
    """
    prints = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.arrow_udf(_fingerprint, "array<long>").asNondeterministic()("text").alias("f"))
    prints = C.cut(prints.where(F.col("f").isNotNull()))
    equal = C.cut(prints.groupBy("f").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")))
    copies = prints.join(equal.where("n > 1"), "f").where("doc_id <> doc").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    links = search(equal.select("doc", "f")).unionByName(copies.distinct())
    return components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("keeper_id"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the copies: of each group the document with the least id stays, once.

    Rows with a null id stay; so do those in no group, of repeated rows one.
    Null and empty texts are in no group. Other columns are kept as they are,
    whatever their names; an empty table gives an empty result.
    """
    gone = groups(docs).select(F.col("doc_id").alias(C.fresh(docs, "gone")))
    twice = C.cut(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(C.fresh(docs, "twice"))))
    left = docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
    if twice.isEmpty():
        return left
    again = left.join(twice, left["doc_id"] == twice[twice.columns[0]], "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, left["doc_id"] == twice[twice.columns[0]], "left_anti").unionByName(again)
