"""Quality rules: robust multivariate outliers per language and source.

Every text gives a vector of transformed statistics. For each (language,
source) the minimum covariance determinant is estimated by concentration steps
over *all* its rows: squared distances under the present centre and scatter,
their ``h`` quantile, and the moments of the rows below it. Two deterministic
starts compete and the smaller determinant wins. All steps are grouped
aggregates, so a hot source is spread over all tasks. Steps go on until no
determinant changes. A source's estimate is drawn towards that of its language
by ``PRIOR_ROWS`` rows' weight, so that a few rows alone say little; there is no
least size. Rows whose Mahalanobis distance is beyond the cut are rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraysail.llm import _common as C

#: Share of rows whose scatter is minimised, and the weight in rows of a language's estimate in that of each of its sources.
SUPPORT, PRIOR_ROWS = 0.7, 100
#: Steps end when no log determinant changes by more, and at the latest after so many.
TOLERANCE, MOST_STEPS = 1e-2, 30
#: Scatter is estimated for each group, then this much (in units of the transformed statistics) is added to each spread.
FLOOR = 0.3
#: Squared distance beyond which a row goes: the 1 - 1e-6 quantile of chi-squared with 7 degrees of freedom.
CUT = 40.52
#: Estimates (about 0.5 kB each) that are broadcast at most; more are joined by a shuffle, in which adaptive execution splits hot groups.
MOST_BROADCAST = 20_000
STATISTICS = ("word_length", "upper", "symbol", "digit", "variety", "short", "lines")
P = len(STATISTICS)
_DROP_UPPER = re.compile(r"[^\W\d_a-z]")
_SYMBOL = re.compile(r"[^\w\s.,]")
_DIGIT = re.compile(r"\d")


def _logit(x: float, n: float, rate: float, weight: float) -> float:
    """Log odds of x of n, drawn towards ``rate`` by ``weight`` pseudo-counts, so that short texts say little."""
    a = x + rate * weight
    return float(np.log(a / (n + weight - a)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; an empty one has those of the prior alone."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words))
    upper = 0
    if text.isascii():
        b = text.encode()
        upper = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digit = len(b) - len(b.translate(None, b"0123456789"))
        symbol = len(b) - len(b.translate(None, b"!\"#$%&'()*+-/:;<=>?@[\\]^`{|}~"))
    else:
        upper = sum(map(str.isupper, _DROP_UPPER.findall(text)))
        digit, symbol = len(_DIGIT.findall(text)), len(_SYMBOL.findall(text))
    short = sum(1 for w in words if len(w) <= 3)
    distinct = len(set(words))
    return [
        float(np.log((chars + 50 * 5.0) / (n + 50))),
        _logit(upper, chars, 0.03, 400),
        _logit(symbol, chars, 0.02, 400),
        _logit(digit, chars, 0.03, 400),
        float(np.log((distinct + 20) / (n + 20) ** 0.85)),
        _logit(short, n, 0.35, 60),
        _logit(text.count("\n"), n, 0.03, 100),
    ]


def _statistics(text: pa.Array) -> pa.Array:
    return pa.array(C.by_slices(text, lambda texts: map(statistics, texts)), pa.list_(pa.float64()))


def with_statistics(docs: DataFrame, name: str = "x") -> DataFrame:
    return docs.withColumn(name, F.arrow_udf(_statistics, "array<double>").asNondeterministic()(docs["text"]))


def distance(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances of rows, each with a centre and an inverse of its own."""
    d = x - centre
    return np.maximum(np.einsum("ni,nij,nj->n", d, inverse, d), 0)


def _matrix(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _distances(batches):
    """(g, start, x, centre, inverse) to (g, start, d)."""
    for b in batches:
        d = distance(_matrix(b["x"], P), _matrix(b["centre"], P), _matrix(b["inverse"], P, P))
        yield pa.RecordBatch.from_arrays([b["g"], b["start"], pa.array(d)], names=["g", "start", "d"])


_I, _J = np.triu_indices(P)
_SUMS = [f"q{i}" for i in range(P + len(_I))]
_PARTS = "g string, start int, n long, " + ", ".join(f"{c} double" for c in _SUMS)


def _sums(batches):
    """Sums of x and of its products by (g, start), of the rows with d <= h; without ``h``, of rows drawn in by tanh."""
    total: dict = {}
    for b in batches:
        x, c, v = _matrix(b["x"], P), _matrix(b["centre"], P), _matrix(b["inverse"], P, P)
        if "h" in b.schema.names:
            near = distance(x, c, v) <= b["h"].to_numpy(zero_copy_only=False)
        else:
            near, spread = np.ones(len(x), bool), 1 / np.sqrt(v[:, range(P), range(P)])
            x = c + spread * np.tanh((x - c) / spread)
        groups: dict = {}
        row = np.array([groups.setdefault(k, len(groups)) for k in zip(b["g"].to_pylist(), b["start"].to_pylist())], int)[near]
        x = x[near]
        n = np.bincount(row, minlength=len(groups))
        columns = [*x.T, *(x[:, i] * x[:, j] for i, j in zip(_I, _J))]
        q = np.array([np.bincount(row, weights=y, minlength=len(groups)) for y in columns]).T
        for k, i in groups.items():
            m, t = total.get(k, (0, 0.0))
            total[k] = m + int(n[i]), t + q[i]
    if total:
        yield pa.RecordBatch.from_pandas(pd.DataFrame([[*k, n, *q] for k, (n, q) in total.items()], columns=["g", "start", "n", *_SUMS]).astype({"start": "int32"}), preserve_index=False)


_SCHEMA = "g string, start int, n long, centre array<double>, inverse array<double>, logdet double, scatter array<double>"


def _packed(pdf: pd.DataFrame, m: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    flat = lambda a: list(a.reshape(len(a), -1))
    return pd.DataFrame({"g": pdf["g"], "start": pdf["start"], "n": pdf["n"], "centre": flat(m), "inverse": flat(np.linalg.inv(s)), "logdet": np.linalg.slogdet(s)[1], "scatter": flat(s)})


def _estimates(parts):
    """Centre, floored scatter, its inverse and determinant from the sums of each group."""
    for pdf in parts:
        q = pdf[_SUMS].to_numpy(float) / pdf["n"].to_numpy(float)[:, None]
        m, s = q[:, :P], np.empty((len(pdf), P, P))
        s[:, _I, _J] = s[:, _J, _I] = q[:, P:] - m[:, _I] * m[:, _J]
        yield _packed(pdf, m, s + np.eye(P) * FLOOR**2)


def _started(parts):
    """First start: medians, and the interquartile ranges as uncorrelated spreads."""
    for pdf in parts:
        q = np.array(pdf["q"].tolist(), float).reshape(len(pdf), P, 3)
        s = np.zeros((len(pdf), P, P))
        s[:, range(P), range(P)] = ((q[:, :, 2] - q[:, :, 0]) / 1.349) ** 2 + FLOOR**2
        yield _packed(pdf, q[:, :, 1], s)


def _small(e: DataFrame) -> DataFrame:
    """A checkpointed table of groups, broadcast where there are few: rows of a hot group then stay where they are."""
    return F.broadcast(e) if e.count() <= MOST_BROADCAST else e


def _moved(rows: DataFrame, e: DataFrame) -> DataFrame:
    """The estimates that follow from the rows near ``e``."""
    sums = rows.join(_small(e), "g").mapInArrow(_sums, _PARTS)
    sums = sums.groupBy("g", "start").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    return C.cut(sums.where("n > 0").mapInPandas(_estimates, _SCHEMA))


def fit(rows: DataFrame, support: float = SUPPORT, most_steps: int = MOST_STEPS) -> DataFrame:
    """(g, centre, scatter) from rows (g, x): the better of two starts when the concentration steps have come to rest."""
    x = F.col("x")
    quantiles = F.flatten(F.array(*(F.percentile_approx(x[i], [0.25, 0.5, 0.75], 2000) for i in range(P)))).alias("q")
    first = rows.groupBy("g").agg(F.count("*").alias("n"), quantiles).withColumn("start", F.lit(0))
    first = C.cut(first.mapInPandas(_started, _SCHEMA))
    near = ["g", "start", "centre", "inverse"]
    now = C.cut(first.unionByName(_moved(rows, first.select(*near)).withColumn("start", F.lit(1))))
    for _ in range(most_steps):
        e = now.select(*near)
        d = rows.join(_small(e), "g").select("x", *near).mapInArrow(_distances, "g string, start int, d double")
        h = d.groupBy("g", "start").agg(F.percentile_approx("d", support, 5000).alias("h"))
        before, now = now.select("g", "start", F.col("logdet").alias("before")), _moved(rows, C.cut(e.join(h, ["g", "start"])))
        if (now.join(before, ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0] or 0) <= TOLERANCE:
            break
    best = now.groupBy("g").agg(F.min_by(F.struct("centre", "scatter"), F.struct("logdet", "start")).alias("b"))
    return best.select("g", "b.*")


#: Median of chi-squared with 7 degrees of freedom.
_MEDIAN = 6.3458


def _inverted(parts):
    for p in parts:
        s = np.array(p["scatter"].tolist(), float).reshape(len(p), P, P)
        yield pd.DataFrame({"g": p["g"], "centre": p["centre"], "inverse": list(np.linalg.inv(s).reshape(len(p), -1))})


def _drawn(parts):
    """Estimates of sources drawn to those of their languages, both with a scatter whose median squared distance is that of chi-squared."""
    for p in parts:
        array = lambda c: np.array(p[c].tolist(), float).reshape(len(p), -1)
        w = (p["n"].to_numpy(float) / (p["n"].to_numpy(float) + PRIOR_ROWS))[:, None]
        c = w * array("centre") + (1 - w) * array("lang_centre")
        s = w * array("scatter") * np.maximum(array("factor"), 1) + (1 - w) * array("lang_scatter") * np.maximum(array("lang_factor"), 1)
        yield pd.DataFrame({"g": p["g"], "centre": list(c), "inverse": list(np.linalg.inv(s.reshape(-1, P, P)).reshape(len(p), -1))})


def _key(*columns):
    """One string for a group; nulls differ from every string."""
    return F.concat_ws("\u0001", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns))


_MODEL = "g string, centre array<double>, inverse array<double>"


def model(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors (doc_id, lang, source, g, lang_g, x), estimates (g, centre, inverse) of the sources), both in the shared folder."""
    rows = with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text")
    rows = C.cut(rows.withColumns({"g": _key(F.col("lang"), F.col("source")), "lang_g": _key(F.col("lang"))}))
    both = rows.select(F.explode(F.array("g", "lang_g")).alias("g"), "x")
    e = C.cut(fit(both))
    d = both.join(_small(C.cut(e.mapInPandas(_inverted, _MODEL))), "g").withColumn("start", F.lit(0)).mapInArrow(_distances, "g string, start int, d double")
    e = C.cut(e.join(d.groupBy("g").agg((F.percentile_approx("d", 0.5, 5000) / _MEDIAN).alias("factor")), "g"))
    sources = rows.groupBy("g", "lang_g").agg(F.count("*").alias("n"))
    lang = e.select(F.col("g").alias("lang_g"), *(F.col(c).alias(f"lang_{c}") for c in ("centre", "scatter", "factor")))
    return rows, C.cut(sources.join(e, "g").join(lang, "lang_g").mapInPandas(_drawn, _MODEL))


def _squared(x: pa.Array, centre: pa.Array, inverse: pa.Array) -> pa.Array:
    return pa.array(distance(_matrix(x, P), _matrix(centre, P), _matrix(inverse, P, P)))


def _text_squared(text: pa.Array, centre: pa.Array, inverse: pa.Array) -> pa.Array:
    """Statistics and distance in one function: two in a stage would take two Python workers for each task."""
    return _squared(_statistics(text), centre, inverse)


def select(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, lang, source, distance, kept) of the rows that are no outliers, one for each input row.

    Null languages and sources are groups; a null or empty text has the prior's
    statistics, near the centre. Repeated rows and ties are judged alike. Texts
    are read whole; other columns are ignored. An empty table gives an empty result.
    """
    rows, e = model(docs)
    d = F.sqrt(F.arrow_udf(_squared, "double")("x", "centre", "inverse"))
    d = rows.join(_small(e), "g").select("doc_id", "lang", "source", d.alias("distance"))
    return d.where(F.col("distance") <= float(np.sqrt(cut))).withColumn("kept", F.lit(True))


def keep(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that :func:`select` keeps, with all their columns.

    Null, empty, repeated and very long texts, null languages and sources and
    empty tables are treated as there; extra columns stay, whatever their names.
    """
    _, e = model(docs)
    o, c, v = (C.fresh(docs, n) for n in ("own", "centre", "inverse"))
    e = C.cut(e.select(F.col("g").alias(o), F.col("centre").alias(c), F.col("inverse").alias(v)))
    d = docs.withColumn(o, _key(docs["lang"], docs["source"])).join(_small(e), o)
    return d.where(F.arrow_udf(_text_squared, "double")(docs["text"], c, v) <= cut).drop(o, c, v)
