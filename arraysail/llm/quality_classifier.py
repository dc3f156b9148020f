"""Quality classifier: importance resampling with hashed n-gram models.

Two bag-of-n-grams models (words, punctuation runs and their bigrams, hashed
into buckets) are counted: one over the target text, one over all raw text. A
document's log weight is the mean over its n-grams of ``log target - log raw``
(drawn to nought for short texts) times ``SHARPNESS``. The mean makes documents
of any length compete alike; the sum would be hundreds of times the noise and
the sampling a plain threshold. Gumbel noise, a hash of the document id, is
added and the ``k`` largest keys stay, which samples without replacement in
proportion to the weights. ``k`` is a share of the corpus, by default that of
the documents whose log weight passes the border between the two labels.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.llm import _common as C

BUCKETS = 1 << 15
MAX_LABELLED = 20_000
SEED = 42
SLACK = 0.005
#: Weight of a mean log ratio against the noise, whose deviation is 1.28, and n-grams of no evidence that are added to each text.
SHARPNESS, SMOOTHING = 100.0, 50
_FIND = re.compile(r"\w+|[^\w\s]+").findall
_HASH = C.Memo(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")), 100_000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the index of each one's text, and the n-grams of each text."""
    words = [_FIND(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    total = int(n.sum())
    get = _HASH.__getitem__
    h = np.fromiter((x for w in words for x in map(get, w)), np.uint32, total)
    row = np.repeat(np.arange(len(texts)), n)
    inner = row[1:] == row[:-1]
    two = (h[:-1][inner] * np.uint32(0x9E3779B1)) ^ (h[1:][inner] * np.uint32(0x85EBCA6B))
    two ^= two >> np.uint32(15)
    bucket = np.concatenate([h & np.uint32(BUCKETS // 2 - 1), (two & np.uint32(BUCKETS // 2 - 1)) + np.uint32(BUCKETS // 2)]).astype(np.int64)
    return bucket, np.concatenate([row, row[1:][inner]]), n


def _counts(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        good = np.array([x == 1 for x in b.column(1).to_pylist()], bool)
        for i, j, texts in C.text_slices(b.column(0), 2_000_000):
            bucket, row, _ = ngrams(texts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[i:j][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The weight of each bucket; counts are smoothed by one. Without target text all weights are nought."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1.0) / (target.sum() + len(raw))) - np.log((raw + 1.0) / (raw.sum() + len(raw)))


def fit(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """Counts n-grams over all of ``docs`` and over those labelled 1; the log ratio per bucket."""
    marked = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(labelled), "__id", "left").select("text", "__label")
    parts = marked.mapInArrow(_counts, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toLocalIterator():
        raw[r[0]], target[r[0]] = r[1], r[2]
    return log_ratio(raw, target)


def score_texts(texts: list[str], ratio: np.ndarray) -> np.ndarray:
    """The log weight of each text."""
    out = np.zeros(len(texts))
    for i, j in C.slices(texts):
        bucket, row, _ = ngrams(texts[i:j])
        total = np.bincount(row, weights=ratio[bucket], minlength=j - i)
        out[i:j] = SHARPNESS * total / (np.bincount(row, minlength=j - i) + SMOOTHING)
    return out


def scorer(spark: SparkSession, ratio: np.ndarray):
    """A column function from text to log weight; the model has a fixed size, so it is broadcast."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(C.by_slices(text, lambda texts: score_texts(texts, shared.value)), pa.float64())

    return score.asNondeterministic()


def gumbel(doc_id, seed=SEED):
    """Standard Gumbel noise from a hash of the id: the same at any partitioning."""
    u = (F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed) if isinstance(seed, int) else seed), F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def border(scores: np.ndarray, labels: np.ndarray) -> float:
    """The least score that separates the labels within ``SLACK`` of the best (recall less false acceptance).

    The slack leans towards keeping documents.
    With one label only: below all scores (all accepted) or, where all are
    labelled 0, above all of them.
    """
    good, bad = np.sort(scores[labels == 1]), np.sort(scores[labels != 1])
    if not len(bad):
        return -np.inf
    if not len(good):
        return np.inf
    at = np.unique(scores)
    j = (len(good) - np.searchsorted(good, at)) / len(good) - (len(bad) - np.searchsorted(bad, at)) / len(bad)
    k = int(np.argmax(j >= j.max() - SLACK))
    return float(at[k] if not k else (at[k - 1] + at[k]) / 2)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The exact ``k``-th largest value, by narrowing a histogram; only counts reach the driver."""
    if k <= 0:
        return float("inf")
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above, bins = 0, 4096
    while True:
        width = (high - low) / bins
        if not width > 0 or low + width == low:
            return float(low)
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        inside = keys.where(F.col(column).between(low, high))
        got = sorted(inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for _, n, lo, hi in got:
            if above + n >= k:
                break
            above += n
        if n <= 10_000 or lo == hi:
            rest = sorted((r[0] for r in keys.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True) if lo < hi else [lo] * n
            return float(rest[k - above - 1])
        low, high = lo, hi


def model(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED, share: float | None = None):
    """(ratio per bucket, scored documents (doc_id, log_weight, key), least key that stays).

    ``max_labelled`` bounds the labelled rows that give the target text and the
    border. ``share`` is the share of the rows that stay; without it, that of
    the rows beyond the border.
    """
    labelled = C.cut(C.one_label(labels, "quality", max_labelled, seed))
    ratio = fit(docs, labelled)
    scored = docs.select("doc_id", scorer(spark, ratio)("text").alias("log_weight"))
    scored = C.cut(scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    if share is not None:
        return ratio, scored, kth_largest(scored, "key", round(share * scored.count()))
    # a row for each labelled document, however often it is repeated
    seen = scored.join(F.broadcast(labelled), F.col("doc_id") == F.col("__id")).groupBy("__id").agg(F.min("log_weight").alias("w"), F.min("__label").alias("y")).toPandas()
    least = border(seen["w"].to_numpy(), seen["y"].to_numpy()) if len(seen) else -np.inf
    k = scored.where(F.col("log_weight") >= F.lit(float(least))).count()
    return ratio, scored, kth_largest(scored, "key", k)


def select(spark: SparkSession, docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, log_weight, key, kept) of the documents that the resampling keeps, one row for each input row.

    A null or empty text has log weight 0 (no evidence) and competes as such.
    Null ids share one noise value. Repeated rows are kept or rejected alike;
    ties at the last key all stay. Texts are read whole. No labels: all stay.
    Other columns are ignored. An empty table gives an empty result.
    """
    _, scored, least = model(spark, docs, labels, **parameters)
    return scored.where(F.col("key") >= F.lit(least)).withColumn("kept", F.lit(True))


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that :func:`select` keeps, with all their columns; nothing is joined or shuffled.

    Null, empty, repeated and very long texts, null ids, ties and empty tables
    are treated as there; extra columns stay, whatever their names.
    """
    ratio, _, least = model(spark, docs, labels, **parameters)
    name = C.fresh(docs, "weight")
    out = docs.withColumn(name, scorer(spark, ratio)(docs["text"]))
    return out.where(F.col(name) + gumbel(F.col("doc_id"), parameters.get("seed", SEED)) >= F.lit(least)).drop(name)
