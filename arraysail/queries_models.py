"""Queries for models over few features, whose closed forms DuckDB can compute, and for reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from arraysail.functions import scalar as S
from arraysail.operators import joins as J
from arraysail.operators import layout as L
from arraysail.operators import select as X
from arraysail.operators import windows as W
from arraysail.plans import datasets as D
from arraysail.plans import linalg as M
from arraysail.plans import regression as R
from arraysail.queries import _FOLDS, cells, query, r, rr

#: Four numbers of each row and a fold.
_E = f"(SELECT vec_id, fold, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM {_FOLDS})"


def _few(t):
    """x of two features, y of one."""
    e = t("embeddings").select("vec_id", "label", F.slice("embedding", 1, 2).alias("x"), F.slice("embedding", 3, 1).alias("y"))
    return W.stratified_folds(e, "vec_id", "label", 5)


_CENTRED = f"""m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM {_E}), z AS (SELECT vec_id, fold, a - ma AS a, b - mb AS b, c - mc AS c FROM {_E}, m)"""
_MOMENTS = "s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac, sum(b * c) AS bc, sum(c * c) AS cc, count(*) AS n FROM z)"
#: The two eigenvalues and vectors of the products in ``s``.
_EIGEN = """e AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE -1 END * sqrt(((aa - bb) / 2) ** 2 + ab ** 2) + (aa + bb) / 2 AS l FROM s, range(0, 2) t(k)),
v AS (SELECT k, l, ab / sqrt(ab ** 2 + (l - aa) ** 2) AS va, (l - aa) / sqrt(ab ** 2 + (l - aa) ** 2) AS vb FROM e, s),
p AS (SELECT vec_id, k, l, va, vb, a * va + b * vb AS raw FROM z, v), g AS (SELECT k, sign(arg_max(raw, abs(raw))) AS g FROM p GROUP BY k)"""
_PLAIN = f"z AS (SELECT * FROM {_E})"


@query(f"WITH {_CENTRED}, {_MOMENTS}, {_EIGEN} SELECT vec_id, CAST(k AS INTEGER) AS component, {r('raw * g')} AS score, {r('l / (n - 1)')} AS eigenvalue FROM p JOIN g USING (k), s")
def pca_two_features(t, spark):
    m = M.PCA().fit(_few(t), "x")
    long = m.transform(_few(t)).select("vec_id", F.posexplode("scores").alias("component", "score"))
    values = F.element_at(F.array(*map(F.lit, m.eigenvalues.tolist())), F.col("component") + 1)
    return rr(long.withColumn("eigenvalue", values), "score", "eigenvalue")


@query(f"WITH {_PLAIN}, {_MOMENTS}, {_EIGEN} SELECT vec_id, CAST(k AS INTEGER) AS component, {r('raw * g / sqrt(l)')} AS u, {r('sqrt(l)')} AS s FROM p JOIN g USING (k)")
def svd_two_features(t, spark):
    got = M.svd(_few(t), "x")
    long = got.u.select("vec_id", F.posexplode("u").alias("component", "u"))
    return rr(long.withColumn("s", F.element_at(F.array(*map(F.lit, got.s.tolist())), F.col("component") + 1)), "u", "s")


@query(f"""WITH {_PLAIN}, {_MOMENTS}, {_EIGEN}, t AS (SELECT va, vb FROM v WHERE k = 0), q AS (SELECT vec_id, a - va * (a * va + b * vb) AS a, b - vb * (a * va + b * vb) AS b FROM z, t)
SELECT vec_id, {r('a - avg(a) OVER ()')} AS a, {r('b - avg(b) OVER ()')} AS b FROM q""")
def denoise_two_features(t, spark):
    e = _few(t)
    got = M.remove_top_components(e, "x", e, 1).select("vec_id", F.col("denoised")[0].alias("a"), F.col("denoised")[1].alias("b"))
    return rr(got, "a", "b")


@query(f"WITH {_CENTRED}, {_MOMENTS} SELECT vec_id, {r('(a * ac + b * bc) / sqrt(ac ** 2 + bc ** 2) * CASE WHEN abs(ac) >= abs(bc) THEN sign(ac) ELSE sign(bc) END')} AS x_score, {r('c * CASE WHEN abs(ac) >= abs(bc) THEN sign(ac) ELSE sign(bc) END')} AS y_score FROM z, s")
def plssvd_one_target(t, spark):
    got = M.PLSSVD(1).fit(_few(t), "x", "y").transform(_few(t)).select("vec_id", F.col("x_scores")[0].alias("x_score"), F.col("y_scores")[0].alias("y_score"))
    return rr(got, "x_score", "y_score")


def _ridge(penalty: float) -> str:
    det = f"((aa + {penalty}) * (bb + {penalty}) - ab * ab)"
    return f"WITH {_CENTRED}, {_MOMENTS} SELECT vec_id, {r(f'mc + a * ((bb + {penalty}) * ac - ab * bc) / {det} + b * ((aa + {penalty}) * bc - ab * ac) / {det}')} AS prediction FROM z, s, m"


def _predicted(df):
    return rr(df.select("vec_id", F.col("prediction")[0].alias("prediction")), "prediction")


@query(_ridge(0.0))
def ols_two_features(t, spark):
    return _predicted(R.LinearRegression().fit(_few(t), "x", "y").predict(_few(t)))


@query(_ridge(10.0))
def ridge_two_features(t, spark):
    return _predicted(R.LinearRegression(l2_penalty=10.0).fit(_few(t), "x", "y").predict(_few(t)))


def _cv_sql(penalty: float) -> str:
    det = f"((aa + {penalty}) * (bb + {penalty}) - ab * ab)"
    return f"""WITH e AS (SELECT * FROM {_E}), f AS (SELECT DISTINCT fold AS f FROM e), m AS (SELECT f, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM f, e WHERE fold <> f GROUP BY f),
s AS (SELECT f, sum((a - ma) ** 2) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) ** 2) AS bb, sum((a - ma) * (c - mc)) AS ac, sum((b - mb) * (c - mc)) AS bc FROM e JOIN m ON fold <> f GROUP BY f)
SELECT vec_id, fold, {r(f'mc + (a - ma) * ((bb + {penalty}) * ac - ab * bc) / {det} + (b - mb) * ((aa + {penalty}) * bc - ab * ac) / {det}')} AS prediction FROM e JOIN s ON s.f = fold JOIN m ON m.f = fold"""


@query(_cv_sql(0.0))
def ols_cv_two_features(t, spark):
    got = R.regression_cv(_few(t), "x", "y", R.LinearRegression)
    return rr(got.select("vec_id", "fold", F.col("prediction")[0].alias("prediction")), "prediction")


@query(_cv_sql(1.0))
def ridge_cv_two_features(t, spark):
    got = R.regression_cv(_few(t), "x", "y", lambda: R.LinearRegression(l2_penalty=1.0))
    return rr(got.select("vec_id", "fold", F.col("prediction")[0].alias("prediction")), "prediction")


@query(f"""WITH {_CENTRED}, {_MOMENTS}, w AS (SELECT q, ac / (aa + q) AS w FROM s, (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) v(q)),
e AS (SELECT q, avg(((c - a * w) / (1 - a * a / (aa + q) - 1.0::DOUBLE / n)) ** 2) AS e FROM z, s, w GROUP BY q), best AS (SELECT arg_min(q, e) AS q FROM e)
SELECT vec_id, {r('mc + a * w')} AS prediction FROM z, m, w JOIN best USING (q)""")
def ridge_gcv_one_feature(t, spark):
    e = _few(t).withColumn("x", F.slice("x", 1, 1))
    return _predicted(R.RidgeGCV().fit(e, "x", "y").predict(e))


@query(f"""WITH {_CENTRED}, {_MOMENTS}, u AS (SELECT ac / sqrt(aa) / sqrt((ac / sqrt(aa)) ** 2 + (bc / sqrt(bb)) ** 2) AS wa, bc / sqrt(bb) / sqrt((ac / sqrt(aa)) ** 2 + (bc / sqrt(bb)) ** 2) AS wb FROM s),
t AS (SELECT vec_id, c, a / sqrt(aa) * wa + b / sqrt(bb) * wb AS t FROM z, s, u), k AS (SELECT sum(t * c) / sum(t * t) AS k FROM t)
SELECT vec_id, {r('mc + t * k')} AS prediction FROM t, k, m""")
def pls_one_component(t, spark):
    return _predicted(R.PLSRegression(1).fit(_few(t), "x", "y").predict(_few(t)))


_WEIGHTS = ", ".join(f"({i}, {k}, {float(x)!r}::DOUBLE)" for i, row in enumerate(M.random_projection(64, 8)) for k, x in enumerate(row))


@query(f"SELECT vec_id, CAST(k AS INTEGER) AS component, {r('sum(CAST(embedding[i + 1] AS DOUBLE) * w)')} AS score FROM embeddings, (VALUES {_WEIGHTS}) v(i, k, w) GROUP BY vec_id, k")
def random_projection_long(t, spark):
    got = M.project(t("embeddings"), "embedding", M.random_projection(64, 8)).select("vec_id", F.posexplode("scores").alias("component", "score"))
    return rr(got, "score")


# ---- reshaping, and what else had no query


@query("SELECT CAST(feature AS INTEGER) AS vec_id, vec_id AS feature, value FROM (SELECT vec_id, k - 1 AS feature, embedding[k] AS value FROM embeddings, range(1, 65) t(k))")
def transposed(t, spark):
    return L.swap(cells(t), "vec_id", "feature").select("vec_id", "feature", F.col("value").cast("float").alias("value"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE b.n_nationkey - a.n_nationkey >= 2 UNION ALL SELECT n_nationkey, n_nationkey FROM nation")
def triangle_and_diagonal(t, spark):
    n = L.cross(t("nation").select(F.col("n_nationkey").alias("i")), t("nation").select(F.col("n_nationkey").alias("j")))
    return L.upper_triangle(n, k=2).unionByName(L.diagonal(n))


@query("SELECT conv_id, string_agg(role || ',' || turn, ';' ORDER BY turn) AS flat FROM conversations GROUP BY conv_id")
def flattened(t, spark):
    nested = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.array(F.concat_ws(",", "role", F.col("turn").cast("string"))).alias("a")))).alias("x"))
    return nested.select("conv_id", F.array_join(S.flat(F.transform("x", lambda s: s["a"])), ";").alias("flat"))


@query("SELECT CAST(min(feature) AS INTEGER) AS first FROM (SELECT k - 1 AS feature, embedding[k] AS value FROM embeddings, range(1, 65) t(k)) WHERE abs(value) > 0.2")
def first_column_above(t, spark):
    return spark.createDataFrame([(W.first_above(cells(t), "feature", "value", 0.2),)], "first int")


@query(f"""WITH s AS (SELECT event_id, user_id, event_type, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 20) AND event_type <> 'error')
SELECT event_id, {r('(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)')} AS value FROM s WINDOW w AS (PARTITION BY event_type, user_id)""")
def masked_betas(t, spark):
    e = t("events").select("event_id", F.col("user_id").alias("neuroid"), F.col("event_type").alias("session"), "value")
    loud = e.groupBy("neuroid").agg((F.max("value") > 20).alias("ok"))
    return rr(D.betas(X.drop_sentinel(e, "session", "error"), [(loud, ["neuroid"], "ok")]).select("event_id", "value"), "value")


@query("SELECT l_suppkey AS stimulus, l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY 1, 2")
def annotation_counts(t, spark):
    a = t("lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_returnflag").alias("category_id"))
    images = t("supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_suppkey").alias("stimulus"))
    names = t("lineitem").select(F.col("l_returnflag").alias("category_id"), F.col("l_returnflag").alias("category")).distinct()
    return D.annotation_counts(a, images, names)


@query(f"SELECT event_type AS channel, n // 4 AS n, {r('avg(value)')} AS value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events) GROUP BY 1, 2")
def averaged_signal(t, spark):
    e = W.occurrence(t("events"), ["event_type"], ["ts", "event_id"], "n").withColumnRenamed("event_type", "channel")
    return rr(D.averaged_signal(e, 4), "value")


@query("SELECT s.s_suppkey AS stimulus, n_name FROM supplier s JOIN nation ON n_nationkey = s_nationkey WHERE n_name NOT LIKE 'A%'")
def trials_without_catch(t, spark):
    named = J.lookup(t("supplier").select(F.col("s_suppkey").alias("stimulus"), F.col("s_nationkey").alias("n_nationkey")), t("nation").select("n_nationkey", "n_name"), "n_nationkey")
    return D.without_catch(named, "n_name", ["stimulus"], "A").select("stimulus", "n_name")
