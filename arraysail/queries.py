"""One query for each operator over the supplied tables, with the same result in DuckDB SQL.

Computed doubles are rounded to six places on both sides; every ranking has a
total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.functions import filters as G
from arraysail.functions import scalar as S
from arraysail.operators import aggregates as A
from arraysail.operators import joins as J
from arraysail.operators import layout as L
from arraysail.operators import sampling as P
from arraysail.operators import select as X
from arraysail.operators import setops as U
from arraysail.operators import windows as W
from arraysail.plans import catalog as C
from arraysail.plans import datasets as D
from arraysail.plans import linalg as M
from arraysail.plans import regression as R
from arraysail.plans import rsa as Q
from arraysail.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None):
    def wrap(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(lambda name: table(spark, folder, name), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def rounded(c: Column | str) -> Column:
    r = F.round((F.col(c) if isinstance(c, str) else c).cast("double"), PLACES)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def rr(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})


def r(sql: str) -> str:
    x = f"round(CAST({sql} AS DOUBLE), {PLACES})"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END"


LONG_SQL = "(SELECT vec_id, label, CAST(k - 1 AS INTEGER) AS feature, CAST(embedding[k] AS DOUBLE) AS value FROM embeddings, range(1, 65) AS t(k))"
LABEL_SQL = f"(SELECT label, feature, avg(value) AS value FROM {LONG_SQL} GROUP BY label, feature)"


def cells(t) -> DataFrame:
    return L.to_long(t("embeddings"), "embedding")


def label_cells(t) -> DataFrame:
    return A.pool(cells(t), ["label", "feature"], how="mean")


# ---- projections and filters


@query("SELECT p_partkey AS part_id, p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, 'parts' AS origin FROM part")
def scan_project_cast(t, spark):
    df = t("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return L.relabel(df, {"p_partkey": "part_id", "p_name": "name", "p_size": "size", "p_retailprice": "price"}, {"origin": "parts"}, {"size": "bigint"})


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_isin(t, spark):
    return X.filter_labels(t("orders"), "o_orderpriority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT coalesce(o_orderpriority IN ('1-URGENT', '5-LOW'), false)")
def filter_not_isin(t, spark):
    return X.filter_labels(t("orders"), "o_orderpriority", ["1-URGENT", "5-LOW"], exclude=True).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def filter_semi(t, spark):
    return X.filter_labels(t("orders"), "o_custkey", t("customer").where("c_acctbal < 0").select("c_custkey")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def filter_anti(t, spark):
    return X.filter_labels(t("orders"), "o_custkey", t("customer").where("c_acctbal < 0").select("c_custkey"), exclude=True).select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_discount > 0.05""")
def mask_conjunction(t, spark):
    size = t("part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("ok"))
    rich = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("ok"))
    rows = t("lineitem").where("l_discount > 0.05")
    return X.mask_rows(rows, (size, ["l_partkey"], "ok"), (rich, ["l_suppkey"], "ok")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING bool_and(value > 2)")
def all_sessions_valid(t, spark):
    return X.all_of(t("events"), ["user_id", "event_type"], F.col("value") > 2)


@query("SELECT user_id, bool_or((event_type = 'error' AND value > 150) OR event_type = 'absent') AS selected FROM events GROUP BY user_id")
def any_roi(t, spark):
    e = t("events").withColumn("high", F.col("value") > 150)
    return X.any_of(e, ["user_id"], X.selector([{"event_type": "error", "high": True}, {"event_type": "absent"}]))


@query("SELECT p_partkey, p_name FROM part WHERE NOT coalesce(starts_with(split_part(p_name, ' ', 1), 'sma'), false)")
def drop_prefix(t, spark):
    return X.drop_prefixed(t("part"), "p_name", "sma", " ").select("p_partkey", "p_name")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def drop_sentinel(t, spark):
    return X.drop_sentinel(t("events"), "event_type", "error").select("event_id", "event_type")


_ZERO_CELLS = "(SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS value FROM lineitem)"


def _zero_cells(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("value"))


@query(f"SELECT * FROM {_ZERO_CELLS} WHERE l_orderkey NOT IN (SELECT l_orderkey FROM {_ZERO_CELLS} WHERE value IS NULL)")
def dropna_any(t, spark):
    return X.drop_missing(_zero_cells(t), ["l_orderkey"])


@query(f"SELECT * FROM {_ZERO_CELLS} WHERE l_orderkey IN (SELECT l_orderkey FROM {_ZERO_CELLS} WHERE value IS NOT NULL)")
def dropna_all(t, spark):
    return X.drop_missing(_zero_cells(t), ["l_orderkey"], how="all")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def columns_by_name(t, spark):
    df = t("lineitem")
    return df.select("l_orderkey", *X.columns_with(df, "extended", 1))


@query("""SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem WHERE l_discount <> 0
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem WHERE l_tax <> 0""")
def nonzero_unpivot(t, spark):
    return X.nonzero(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("SELECT l_orderkey, max(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey HAVING max(l_tax) > 0")
def drop_zero_groups(t, spark):
    return X.drop_zero_groups(t("lineitem"), ["l_orderkey"], "l_tax")


@query("SELECT n_regionkey, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def label_masks(t, spark):
    volume, labels = t("nation").select("n_regionkey", "n_nationkey"), t("region").where("r_name <> 'ASIA'").withColumnRenamed("r_regionkey", "n_regionkey")
    return X.label_masks(volume, labels, "n_regionkey")


@query("SELECT event_id, coalesce(value BETWEEN 10 AND 20, false) AS inside FROM events")
def in_bounds(t, spark):
    return t("events").select("event_id", X.in_bounds("value", 10, 20).alias("inside"))


@query("""SELECT event_id, event_id % 7 * 20 + event_id % 5 * 4 + event_id % 4 AS flat, event_id // 20 AS x, event_id // 4 % 5 AS y, event_id % 4 AS z,
event_id // 750 AS session, event_id % 750 AS trial, 2 * (event_id % 750 // 125) + CASE WHEN event_id % 125 >= 63 THEN 1 ELSE 0 END AS run FROM events""")
def flat_ids(t, spark):
    e = F.col("event_id")
    x, y, z = L.unravel(e, [10_000, 5, 4])
    session, trial = L.div_mod(e, 750, 0)
    return t("events").select("event_id", L.flat_id([7, 5, 4], F.pmod(e, F.lit(7)), F.pmod(e, F.lit(5)), F.pmod(e, F.lit(4))).alias("flat"), x.alias("x"), y.alias("y"), z.alias("z"), session.alias("session"), trial.alias("trial"), L.run_label(trial).alias("run"))


@query("""SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)
LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) USING (lang, source)""")
def dense_grid_fill(t, spark):
    d = t("documents")
    return L.dense_grid(A.counts(d, "lang", "source"), [d.select("lang").distinct(), d.select("source").distinct()], ["lang", "source"]).fillna(0, ["n"])


# ---- joins


@query("""SELECT o_orderkey, o_custkey AS c_custkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def align_to_target(t, spark):
    target = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.align(t("customer").select("c_custkey", "c_name", "c_acctbal"), target, "c_custkey", "o_orderkey")


@query("SELECT n_regionkey AS regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_inner(t, spark):
    return J.merge(t("nation").select(F.col("n_regionkey").alias("regionkey"), "n_name"), t("region").select(F.col("r_regionkey").alias("regionkey"), "r_name"), "regionkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_lookup(t, spark):
    names = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.lookup(t("customer").select("c_custkey", "c_nationkey"), names, "c_nationkey").select("c_custkey", "n_name")


@query("""SELECT CAST(pos AS BIGINT) AS pos, event_id, o_orderkey FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, event_id FROM events)
JOIN (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey FROM orders) USING (pos)""")
def positional_join(t, spark):
    a = W.global_position(t("events").select("event_id", "ts"), "ts", "pos", ["event_id"])
    b = W.global_position(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "pos", ["o_orderkey"])
    return a.join(b, "pos").select("pos", "event_id", "o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 1 END AS "set" FROM customer""")
def membership(t, spark):
    k = t("customer").select("c_custkey")
    sets = U.concat({1: k.where("c_custkey % 5 = 0"), 2: k.where("c_custkey % 3 = 0")}, "set")
    return J.membership(k, sets, "c_custkey")


@query("""SELECT p.event_id AS event_id, s.event_id AS sample_id, """ + r("epoch_us(s.ts) / 1000000.0 - epoch_us(p.ts) / 1000000.0") + """ AS "offset"
FROM events p JOIN events s ON p.user_id = s.user_id AND s.ts >= p.ts - INTERVAL 6 HOUR AND s.ts <= p.ts + INTERVAL 18 HOUR WHERE p.event_type = 'purchase'""")
def epoch_join(t, spark):
    e = t("events")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    purchases = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("onset"))
    signal = e.select(F.col("event_id").alias("sample_id"), "user_id", "ts")
    got = J.interval(purchases, signal, ["user_id"], seconds("onset"), seconds("ts"), -6 * 3600, 18 * 3600)
    return rr(got.select("event_id", "sample_id", "offset"), "offset")


_VOLUME = "(SELECT x, y, CAST((x * 7 + y * 3) % 11 AS DOUBLE) AS v FROM range(0, 10) a(x), range(0, 8) b(y))"


def _volume(spark):
    return L.cross(spark.range(10).select(F.col("id").alias("x")), spark.range(8).select(F.col("id").alias("y"))).withColumn("value", ((F.col("x") * 7 + F.col("y") * 3) % 11).cast("double"))


def _points(t):
    return t("events").select("event_id", (F.col("event_id") % 113 / 10.0 - 0.53).alias("x"), (F.col("event_id") % 83 / 9.0 - 0.27).alias("y"))


@query(f"""WITH p AS (SELECT event_id, event_id % 113 / 10.0::DOUBLE - 0.53::DOUBLE AS px, event_id % 83 / 9.0::DOUBLE - 0.27::DOUBLE AS py FROM events)
SELECT event_id, v AS value FROM p JOIN {_VOLUME} ON x = CAST(round_even(least(greatest(px, 0), 9), 0) AS BIGINT) AND y = CAST(round_even(least(greatest(py, 0), 7), 0) AS BIGINT)""")
def resample_nearest(t, spark):
    return J.resample(_points(t), _volume(spark), [10, 8], ["x", "y"]).select("event_id", "value")


@query(f"""WITH p AS (SELECT event_id, least(greatest(event_id % 113 / 10.0::DOUBLE - 0.53::DOUBLE, 0), 9) AS px, least(greatest(event_id % 83 / 9.0::DOUBLE - 0.27::DOUBLE, 0), 7) AS py FROM events)
SELECT event_id, {r("sum(v * (1 - abs(px - x)) * (1 - abs(py - y)))")} AS value FROM p JOIN {_VOLUME} ON abs(px - x) < 1 AND abs(py - y) < 1 GROUP BY event_id""")
def resample_linear(t, spark):
    return rr(J.resample(_points(t), _volume(spark), [10, 8], ["x", "y"], order=1).select("event_id", "value"), "value")


@query("SELECT r_name, c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
def cross_product(t, spark):
    return L.cross(t("region").select("r_name"), t("customer").select("c_mktsegment").distinct())


# ---- sets


@query("SELECT event_id, value, event_type AS part FROM events WHERE event_type IN ('click', 'view')")
def union_parts(t, spark):
    e = t("events").select("event_id", "value", "event_type")
    return U.concat({k: e.where(F.col("event_type") == k).drop("event_type") for k in ("click", "view")}, "part")


@query("SELECT p_brand FROM part WHERE p_retailprice > 1500 GROUP BY p_brand HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part WHERE p_retailprice > 1500)")
def intersect_all_groups(t, spark):
    return U.shared(t("part").where("p_retailprice > 1500"), "p_brand", "p_type")


@query("""SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS repetition FROM events)
WHERE repetition = 9 GROUP BY user_id HAVING count(DISTINCT event_type) = 5""")
def shared_repeated(t, spark):
    e = W.occurrence(t("events"), ["user_id", "event_type"], ["ts", "event_id"])
    return U.shared_repeated(e, "user_id", "event_type", "repetition", 10)


@query("SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def setdiff(t, spark):
    return U.difference(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def distinct_concat(t, spark):
    return U.distinct_union([t(n).select(F.col(c).alias("k")) for n, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))])


@query(f"SELECT s_suppkey, {r('s_acctbal + k * 2.5')} AS y FROM supplier, (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE)) v(k)")
def simulate_errors(t, spark):
    return rr(U.simulate_errors(t("supplier").withColumn("e", F.lit(2.5)), "s_acctbal", "e").select("s_suppkey", "y"), "y")


# ---- aggregates


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_counts(t, spark):
    return A.counts(t("documents"), "lang", "source")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def count_pivot(t, spark):
    return A.count_matrix(t("events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def captions_list(t, spark):
    return A.lists(t("conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


_REPEATS = "(SELECT user_id, CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2)"


@query(f"""WITH f AS (SELECT sum(1.0::DOUBLE / n) / nullif(count(*), 0) AS fraction FROM {_REPEATS} WHERE n <= 3)
SELECT s_suppkey, {r("s * s / nullif(s * s + fraction, 0)")} AS noise_ceiling FROM (SELECT s_suppkey, s_acctbal / 10000 AS s FROM supplier), f""")
def noise_ceiling(t, spark):
    e = t("events").select(F.struct("user_id", F.floor("value").alias("bin")).alias("item"))
    signal = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("snr"))
    return rr(A.noise_ceiling(signal, "snr", A.noise_ceiling_fraction(e, "item")).drop("snr"), "noise_ceiling")


@query(f"SELECT label, feature, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std_samp, {r('stddev_pop(value)')} AS std_pop FROM {LONG_SQL} GROUP BY label, feature")
def std_samp_pop(t, spark):
    return rr(A.moments(cells(t), ["label", "feature"], "value"), "mean", "std_samp", "std_pop")


@query(f"SELECT event_type, {r('avg(value) FILTER (value > 5)')} AS mean, {r('coalesce(sum(value) FILTER (value > 5), 0)')} AS total FROM events GROUP BY event_type")
def nan_mean(t, spark):
    v = F.when(F.col("value") > 5, F.col("value")).otherwise(F.lit(float("nan")))
    return rr(t("events").groupBy("event_type").agg(A.nan_mean(v).alias("mean"), A.nan_sum(v).alias("total")), "mean", "total")


@query(f"SELECT label, feature, max(value) AS value FROM {LONG_SQL} GROUP BY label, feature")
def max_pool(t, spark):
    return A.pool(cells(t), ["label", "feature"])


@query(f"SELECT vec_id, {r('avg(value)')} AS value FROM {LONG_SQL} GROUP BY vec_id")
def mean_pool(t, spark):
    return rr(A.pool(cells(t), ["vec_id"], how="mean"), "value")


@query(f"SELECT vec_id, max(value) AS value FROM {LONG_SQL} WHERE feature // 8 % 2 = 1 GROUP BY vec_id")
def band_pool(t, spark):
    return A.band_pool(cells(t), ["vec_id"], "feature", 8, odd=True)


@query(f"SELECT l_returnflag, {r('covar_samp(l_quantity, l_extendedprice)')} AS covariance FROM lineitem GROUP BY l_returnflag")
def covariance(t, spark):
    return rr(t("lineitem").groupBy("l_returnflag").agg(A.covariance("l_quantity", "l_extendedprice").alias("covariance")), "covariance")


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query(f"SELECT l_returnflag, {r(corr_sql('l_quantity', 'l_extendedprice'))} AS r FROM lineitem GROUP BY l_returnflag")
def pearson(t, spark):
    return rr(A.pearson_r(t("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "r")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS i, '{b}' AS j, {r(corr_sql(a, b))} AS r FROM lineitem GROUP BY l_returnflag" for k, a in enumerate(_MEASURES) for b in _MEASURES[k + 1 :]))
def pearson_matrix(t, spark):
    return rr(A.pearson_matrix(t("lineitem"), _MEASURES, ["l_returnflag"]), "r")


@query(f"""SELECT p_brand, {r(corr_sql('a', 'b'))} AS rho FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS a,
row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part) GROUP BY p_brand""")
def spearman_ordinal(t, spark):
    return rr(A.spearman_r(t("part"), "p_size", "p_retailprice", "p_partkey", ["p_brand"]), "rho")


@query(f"SELECT l_returnflag, {r('1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / nullif(count(*) * var_pop(l_extendedprice), 0)')} AS r2 FROM lineitem GROUP BY l_returnflag")
def r2_score(t, spark):
    return rr(A.r2_score(t("lineitem").withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p", ["l_returnflag"]), "r2")


def _crossed(a: str, b: str) -> str:
    return f"(SELECT sum(c * c) AS s FROM (SELECT covar_pop(a.value, b.value) AS c FROM {a} a JOIN {b} b USING (vec_id) GROUP BY a.feature, b.feature))"


_HALVES = (f"(SELECT * FROM {LONG_SQL} WHERE feature < 32)", f"(SELECT * FROM {LONG_SQL} WHERE feature >= 32)")


@query(f"SELECT {r('xy.s / nullif(sqrt(xx.s) * sqrt(yy.s), 0)')} AS cka FROM {_crossed(*_HALVES)} xy, {_crossed(_HALVES[0], _HALVES[0])} xx, {_crossed(_HALVES[1], _HALVES[1])} yy")
def cka_linear(t, spark):
    c = cells(t)
    return rr(A.linear_cka(c.where("feature < 32"), c.where("feature >= 32"), "vec_id"), "cka")


@query(f"SELECT label, {r('avg(value * value)')} AS ms FROM {LONG_SQL} GROUP BY label")
def mean_square(t, spark):
    return rr(cells(t).groupBy("label").agg(A.mean_square("value").alias("ms")), "ms")


@query(f"SELECT event_id, {r('(value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0)')} AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def min_max(t, spark):
    return rr(A.min_max(t("events"), ["event_type"], "value", "scaled").select("event_id", "scaled"), "scaled")


@query(f"SELECT user_id, {r('avg(value)')} AS value FROM events GROUP BY user_id")
def layer_mean(t, spark):
    return rr(A.layer_mean(t("events"), ["user_id"]), "value")


# ---- windows


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS repetition FROM events")
def repetition_index(t, spark):
    return W.occurrence(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "repetition")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS INTEGER) AS rank FROM events")
def ordinal_rank(t, spark):
    return W.ordinal_rank(t("events"), ["event_type"], "value", ["event_id"]).select("event_id", "rank")


_W = "WINDOW w AS (PARTITION BY user_id)"


@query(f"SELECT event_id, {r('(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)')} AS z, {r('value / 300')} AS scaled FROM events {_W}")
def session_zscore(t, spark):
    e = W.scale_by(t("events"), ["user_id"], "value", 300, out="z")
    return rr(W.scale_by(e, ["user_id"], "value", 300, zscore=False, out="scaled").select("event_id", "z", "scaled"), "z", "scaled")


@query(f"SELECT event_id, {r('value - avg(value) OVER w')} AS centered FROM events {_W}")
def center(t, spark):
    return rr(W.center(t("events"), ["user_id"], out="centered").select("event_id", "centered"), "centered")


@query(f"SELECT event_id, {r('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)')} AS z FROM events {_W}")
def zscore_ddof(t, spark):
    return rr(W.z_score(t("events"), ["user_id"], out="z").select("event_id", "z"), "z")


@query(f"""WITH e AS (SELECT event_id, user_id, CASE WHEN value > 5 THEN value END AS v FROM events), m AS (SELECT *, avg(v) OVER w AS m, count(*) OVER w AS n FROM e {_W})
SELECT event_id, {r('(v - m) / nullif(sqrt(sum((v - m) ** 2) OVER w / nullif(n - 1, 0)), 0)')} AS z FROM m {_W}""")
def zscore_omit(t, spark):
    v = F.when(F.col("value") > 5, F.col("value")).otherwise(F.lit(float("nan")))
    z = W.z_score(t("events").withColumn("value", v), ["user_id"], nan_policy="omit", out="z")
    return rr(z.select("event_id", F.nanvl("z", F.lit(None).cast("double")).alias("z")), "z")


@query(f"""WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT event_id, {r('(value - m) / (s + 1e-6)')} AS z FROM events JOIN s USING (user_id) WHERE event_type <> 'view'""")
def zscore_by_reference(t, spark):
    e = t("events")
    return rr(W.z_score_by(e.where("event_type <> 'view'"), e.where("event_type = 'view'"), ["user_id"], out="z").select("event_id", "z"), "z")


@query(f"""SELECT event_id, pos, {r('mean')} AS mean FROM (SELECT event_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pos % 2 = 0""")
def sliding_mean(t, spark):
    return rr(W.sliding_mean(t("events"), ["user_id"], ["ts", "event_id"], 5, 2).select("event_id", "pos", "mean"), "mean")


@query(f"""WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, greatest(CAST(floor(count(*) OVER (PARTITION BY user_id) * 0.25) AS BIGINT), 1) AS n FROM events)
SELECT a.event_id, CAST(a.pos AS INTEGER) AS pos, {r('avg(b.value)')} AS mean FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos AND a.pos + a.n - 1 WHERE a.pos % 3 = 0 GROUP BY 1, 2""")
def sliding_mean_share(t, spark):
    return rr(W.sliding_mean(t("events"), ["user_id"], ["ts", "event_id"], 0.25, 3).select("event_id", "pos", "mean"), "mean")


@query(f"""WITH g AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS k, count(*) OVER () AS n FROM events GROUP BY event_type)
SELECT event_id, {r('value + (k - (n - 1) / 2.0::DOUBLE) * 0.25')} AS "offset" FROM events JOIN g USING (event_type)""")
def group_offset(t, spark):
    return rr(W.group_offset(t("events"), "event_type", "event_id", 0.25, "value").select("event_id", "offset"), "offset")


@query("SELECT vec_id, CAST(ntile(7) OVER (ORDER BY vec_id) - 1 AS INTEGER) AS fold FROM embeddings")
def folds_ntile(t, spark):
    return W.folds(t("embeddings").select("vec_id"), "vec_id", 7, shuffle=False)


@query("SELECT vec_id, CAST(ntile(7) OVER (ORDER BY md5('3-' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS INTEGER) AS fold FROM embeddings")
def folds_shuffled(t, spark):
    return W.folds(t("embeddings").select("vec_id"), "vec_id", 7, seed=3)


_FOLDS = "(SELECT *, CAST(ntile(5) OVER (PARTITION BY label ORDER BY md5('0-' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS INTEGER) AS fold FROM embeddings)"


@query(f"SELECT vec_id, label, fold FROM {_FOLDS}")
def folds_stratified(t, spark):
    return W.stratified_folds(t("embeddings").select("vec_id", "label"), "vec_id", "label", 5)


@query(f"""SELECT feature, CAST(sign(value) AS DOUBLE) AS sign FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY abs(value) DESC, vec_id) AS n FROM {LONG_SQL}) WHERE n = 1""")
def dominant_sign(t, spark):
    return W.dominant_sign(cells(t), "feature", "value", "vec_id")


# ---- sorting and sampling


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t, spark):
    return P.top_k(t("orders").select("o_orderkey", "o_totalprice"), 10, "o_totalprice", ["o_orderkey"])


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey FROM orders")
def multi_sort(t, spark):
    return W.global_position(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "pos", ["o_totalprice", "o_orderkey"]).select("pos", "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders) WHERE pos >= 1000")
def head_tail(t, spark):
    o = W.global_position(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "pos", ["o_orderkey"])
    return P.head_tail(o, "pos", 1000, head=False).select("o_orderkey")


@query("""SELECT draw, vec_id FROM (SELECT CAST(draw AS INTEGER) AS draw, vec_id, row_number() OVER (PARTITION BY draw ORDER BY md5('0-' || draw || '-' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY draw) AS n
FROM embeddings, range(0, 3) d(draw)) WHERE k <= floor(n * 0.9)""")
def subsample(t, spark):
    v = t("embeddings").select("vec_id").crossJoin(spark.range(3).select(F.col("id").cast("int").alias("draw")))
    return P.subsample(v, "vec_id", "draw", 0.9).select("draw", "vec_id")


@query("SELECT CAST(row_number() OVER (ORDER BY md5('5-' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS BIGINT) AS pos, c_custkey FROM customer")
def permuted(t, spark):
    return W.global_position(t("customer").select("c_custkey"), W.shuffle_key("c_custkey", 5), "pos", ["c_custkey"])


@query()
def derangements(t, spark):
    return P.derangements(spark, 8, 100)


# ---- scalars


@query(r"""SELECT page_id, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1') AS stem, string_split(path, '/')[-2] AS parent, nullif(split_part(path, '/', 3), '') AS third, array_to_string(string_split(path, '/')[2:], '/') AS rest
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)""")
def path_parts(t, spark):
    path = F.regexp_replace("url", "[?#].*$", "")
    return t("pages").select("page_id", S.stem(path).alias("stem"), S.parent_name(path).alias("parent"), F.nullif(S.take(path, "/", 2), F.lit("")).alias("third"), S.after_first(path, "/").alias("rest"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^([a-z]+)://', 1) AS protocol FROM pages")
def url_parts(t, spark):
    return t("pages").select("page_id", S.url_part("url", "HOST").alias("host"), S.url_part("url", "PATH").alias("path"), S.url_part("url", "PROTOCOL").alias("protocol"))


@query("""SELECT s_suppkey, 'sub-' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || '_' || s_name AS template, CASE WHEN s_suppkey % 2 = 0 THEN 'lh' ELSE 'rh' END AS hemisphere, substr(s_name, 10) AS number,
regexp_matches(s_name, '^[a-zA-Z0-9]+$') AS alphanumeric, regexp_matches(lower(s_name), '^[a-z0-9_]+$') AS header, regexp_matches(sha1(s_name), '^[a-f0-9]{40}$') AS digest FROM supplier""")
def string_functions(t, spark):
    side = F.when(F.col("s_suppkey") % 2 == 0, "left").otherwise("R")
    return t("supplier").select("s_suppkey", S.template("sub-{n}_{name}", n=S.padded("s_nationkey"), name="s_name").alias("template"), S.hemisphere(side).alias("hemisphere"), S.without_prefix("s_name", "Supplier#").alias("number"), S.is_alphanumeric("s_name").alias("alphanumeric"), S.is_header(F.lower("s_name")).alias("header"), S.is_sha1(S.sha1("s_name")).alias("digest"))


@query(f"""SELECT event_id, round_even(value * 4, 0) / 4 AS half, {r('sqrt(value)')} AS root, {r('ln(value + 1)')} AS log, {r('exp(-value / 100)')} AS decay, CAST(ceil(4 * ln(event_id + 2) / (0.1::DOUBLE ** 2 / 2 - 0.1::DOUBLE ** 3 / 3)) AS BIGINT) AS projection_limit,
event_id * 4 - 3 AS onset, {r('value * 1e6')} AS micro, {r('value / nullif(stddev_pop(value) OVER (), 0)')} AS over_std, CASE WHEN value - 50 < 0 THEN 'low' ELSE 'high' END AS side FROM events""")
def math_functions(t, spark):
    v = F.col("value")
    spread = t("events").agg(F.stddev_pop("value").alias("sd"))
    e = t("events").crossJoin(spread)
    side = F.when(S.recode(v - 50, -1.0, 1.0) < 0, "low").otherwise("high")
    out = e.select("event_id", (S.round_even(v * 4) / 4).alias("half"), F.sqrt(v).alias("root"), F.ln(v + 1).alias("log"), F.exp(-v / 100).alias("decay"), S.projection_limit(F.col("event_id") + 2).alias("projection_limit"), S.onset_ms("event_id").alias("onset"), S.rescaled(v, "original").alias("micro"), S.rescaled(v, "std", F.col("sd")).alias("over_std"), side.alias("side"))
    return rr(out, "root", "log", "decay", "micro", "over_std")


@query(f"SELECT vec_id, {r('list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))')} AS norm FROM embeddings")
def dot_product(t, spark):
    return rr(t("embeddings").select("vec_id", S.dot("embedding", "embedding").alias("norm")), "norm")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(t, spark):
    return t("events").select("event_id", S.json_field("props", "$.k", "int").alias("k"))


@query("SELECT page_id, sha1(html) AS sha1 FROM pages")
def sha1_hash(t, spark):
    return t("pages").select("page_id", S.sha1("html").alias("sha1"))


# ---- models


def _ridge_sql(a: float) -> str:
    slope = f"count(*) * covar_pop(l_quantity, l_extendedprice) / nullif(count(*) * var_pop(l_quantity) + {a}, 0)"
    return f"SELECT l_returnflag, {r(slope)} AS slope, {r(f'avg(l_extendedprice) - {slope} * avg(l_quantity)')} AS intercept FROM lineitem GROUP BY l_returnflag"


@query(_ridge_sql(0.0))
def ols_simple(t, spark):
    return rr(R.simple_ridge(t("lineitem"), "l_quantity", "l_extendedprice", 0, ("l_returnflag",)), "slope", "intercept")


@query(_ridge_sql(10.0))
def ridge_simple(t, spark):
    return rr(R.simple_ridge(t("lineitem"), "l_quantity", "l_extendedprice", 10, ("l_returnflag",)), "slope", "intercept")


@query(f"""WITH e AS (SELECT vec_id, fold, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM {_FOLDS}), f AS (SELECT DISTINCT fold AS f FROM e),
m AS (SELECT f, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f, e WHERE fold <> f GROUP BY f)
SELECT fold, {r('1 - sum((y - a * x - b) ** 2) / nullif(count(*) * var_pop(y), 0)')} AS r2 FROM e JOIN m ON f = fold GROUP BY fold""")
def ols_cv(t, spark):
    e = t("embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return rr(R.simple_cv(W.stratified_folds(e, "vec_id", "label", 5), "x", "y"), "r2")


@query("""WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment = 'BUILDING' AS b FROM customer), n AS (SELECT count(*) FILTER (b) AS n FROM c),
o AS (SELECT avg(c_acctbal) FILTER (b) - avg(c_acctbal) FILTER (NOT b) AS o FROM c),
d AS (SELECT draw, c_acctbal, row_number() OVER (PARTITION BY draw ORDER BY md5(draw || '-' || c_custkey), c_custkey) <= n AS b FROM c, n, range(0, 100) t(draw)),
z AS (SELECT draw, avg(c_acctbal) FILTER (b) - avg(c_acctbal) FILTER (NOT b) AS z FROM d GROUP BY draw)
SELECT """ + r("(count(*) FILTER (abs(o) <= abs(z)) + 1) / (count(*) + 1)") + " AS p FROM z, o")
def permutation_p(t, spark):
    c = t("customer").select("c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("b"))
    gap = F.avg(F.when(F.col("b"), F.col("c_acctbal"))) - F.avg(F.when(~F.col("b"), F.col("c_acctbal")))
    n = c.where("b").count()
    # a small file is one task, whose rows the draws multiply
    d = c.drop("b").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").crossJoin(spark.range(100).select(F.col("id").alias("draw")))
    order = F.md5(F.concat_ws("-", F.col("draw").cast("string"), F.col("c_custkey").cast("string")))
    d = P.first_of(d, ["draw"], order, ["c_custkey"], lambda _: F.lit(n), "b")
    return rr(Q.permutation_test(d.groupBy("draw").agg(gap.alias("z")), c.agg(gap.alias("o")), "z"), "p")


def rsm_sql(source: str) -> str:
    return f"(SELECT a.label AS i, b.label AS j, {corr_sql('a.value', 'b.value')} * count(*) / nullif(count(*) - 1, 0) AS r FROM {source} a JOIN {source} b ON a.feature = b.feature AND a.label < b.label GROUP BY a.label, b.label)"


@query(f"SELECT i, j, {r('r')} AS r FROM {rsm_sql(LABEL_SQL)}")
def rsm_labels(t, spark):
    return rr(Q.rsm(label_cells(t), "label"), "r")


@query(f"SELECT i, j, {r('nullif(r, 0)')} AS r FROM {rsm_sql(LABEL_SQL)}")
def rsm_clean(t, spark):
    return rr(Q.clean_rsm(Q.rsm(label_cells(t), "label"), t("embeddings").select("label").distinct()), "r")


_RSMS = tuple(rsm_sql(f"(SELECT * FROM {LABEL_SQL} WHERE feature {op} 32)") for op in ("<", ">="))


def _rsms(t):
    c = label_cells(t)
    return Q.rsm(c.where("feature < 32"), "label"), Q.rsm(c.where("feature >= 32"), "label")


@query(f"SELECT {r(corr_sql('a.r', 'b.r'))} AS r FROM {_RSMS[0]} a JOIN {_RSMS[1]} b USING (i, j)")
def rsa_correlation(t, spark):
    return rr(Q.rsa_correlation(*_rsms(t)), "r")


@query(f"SELECT {r(corr_sql('x', 'y'))} AS r FROM (SELECT row_number() OVER (ORDER BY a.r, i, j) AS x, row_number() OVER (ORDER BY b.r, i, j) AS y FROM {_RSMS[0]} a JOIN {_RSMS[1]} b USING (i, j))")
def rsa_spearman(t, spark):
    return rr(Q.rsa_correlation(*_rsms(t), correlation="spearman"), "r")


@query(f"""WITH s AS (SELECT CAST(draw AS INTEGER) AS draw, label FROM (SELECT draw, label, row_number() OVER (PARTITION BY draw ORDER BY md5('0-' || draw || '-' || label), label) AS k, count(*) OVER (PARTITION BY draw) AS n
FROM (SELECT DISTINCT label FROM embeddings), range(0, 5000) d(draw)) WHERE k <= floor(n * 0.9))
SELECT p.draw, {r(corr_sql('a.r', 'b.r'))} AS r FROM {_RSMS[0]} a JOIN {_RSMS[1]} b USING (i, j) JOIN s p ON p.label = i JOIN s q ON q.label = j AND q.draw = p.draw GROUP BY p.draw""")
def rsa_resampled(t, spark):
    return rr(Q.rsa_resampled(spark, *_rsms(t), t("embeddings").select("label").distinct(), n_draws=5000), "r")


@query(f"""WITH m AS (SELECT f, k, CASE WHEN ('0x' || h[9:9])::INT % 2 = 0 THEN 1 ELSE -1 END / sqrt(0.25::DOUBLE * 8) AS w FROM (SELECT f, k, md5('0-' || f || '-' || k) AS h FROM range(0, 64) a(f), range(0, 8) b(k)) WHERE ('0x' || h[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.25)
SELECT vec_id, k AS component, {r('sum(value * w)')} AS value FROM {LONG_SQL} JOIN m ON f = feature GROUP BY vec_id, k""")
def sparse_projection(t, spark):
    return rr(M.sparse_projection(spark, cells(t), ["vec_id"], 64, 8, 0.25), "value")


@query()
def pca_embeddings(t, spark):
    e = t("embeddings")
    return M.PCA(8).fit(e, "embedding").transform(e).select("vec_id", "scores")


@query()
def svd_embeddings(t, spark):
    return M.svd(t("embeddings"), "embedding", 8).u.select("vec_id", "u")


def _two(t):
    return t("embeddings").select("vec_id", "label", F.slice("embedding", 1, 48).alias("x"), F.slice("embedding", 49, 16).alias("y"))


@query()
def plssvd(t, spark):
    return M.PLSSVD(4).fit(_two(t), "x", "y").transform(_two(t)).select("vec_id", "x_scores", "y_scores")


@query()
def nmf(t, spark):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v)).alias("x"))
    return M.NMF(4, epochs=200).fit(e, "x").transform(e).select("vec_id", "factors")


@query()
def denoise_top_components(t, spark):
    e = t("embeddings")
    return M.remove_top_components(e, "embedding", e.where("label = 0"), 32).select("vec_id", "denoised")


@query()
def random_projection(t, spark):
    return M.project(t("embeddings"), "embedding", M.random_projection(64, 8)).select("vec_id", "scores")


def _cv(make):
    def f(t, spark):
        e = W.stratified_folds(_two(t), "vec_id", "label", 5)
        return R.regression_cv(e, "x", "y", make).select("vec_id", "fold", "prediction")

    return f


for _name, _make in {"linear_cv": R.LinearRegression, "ridge_cv": lambda: R.LinearRegression(l2_penalty=1.0), "pls_cv": lambda: R.PLSRegression(25), "sgd_cv": lambda: R.SGDLinearRegression(epochs=1000)}.items():
    _f = _cv(_make)
    _f.__name__ = _name
    query()(_f)


@query()
def ridge_gcv(t, spark):
    return R.RidgeGCV().fit(_two(t), "x", "y").predict(_two(t)).select("vec_id", "prediction")


@query(f"""WITH g AS (SELECT CAST(curvature AS DOUBLE) AS curvature, 2 * pi() * k / 8 AS theta, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, r - 4 AS x, 4 - c AS y FROM (VALUES (0.0), (0.1)) v(curvature), range(0, 8) a(k), range(0, 9) b(r), range(0, 9) d(c)),
b AS (SELECT *, x * cos(theta) + y * sin(theta) + curvature * (y * cos(theta) - x * sin(theta)) ** 2 AS bent, (y * cos(theta) - x * sin(theta)) / 5 AS across FROM g),
f AS (SELECT *, exp(-(bent ** 2 + across ** 2) * CAST(1.2 AS DOUBLE) ** 2 / 2) * (cos(CAST(1.2 AS DOUBLE) * bent) - exp(-0.5::DOUBLE)) AS v FROM b)
SELECT curvature, {r("theta")} AS theta, "row", col, {r("v - avg(v) OVER (PARTITION BY curvature, theta)")} AS value FROM f""")
def curved_filters(t, spark):
    return rr(G.curved_filters(spark, 8, (0.0, 0.1)).select("curvature", "theta", "row", "col", "value"), "theta", "value")


@query(f"""WITH u AS (SELECT CAST(o AS INTEGER) AS output, CAST(i AS INTEGER) AS input, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, ('0x' || md5('27-' || o || '-' || i || '-' || r || '-' || c)[1:8])::BIGINT / 4294967296.0::DOUBLE AS v
FROM range(0, 4) a(o), range(0, 3) b(i), range(0, 5) d(r), range(0, 5) e(c)) SELECT output, input, "row", col, {r("v - avg(v) OVER (PARTITION BY output, input)")} AS value FROM u""")
def random_filters(t, spark):
    return rr(G.random_filters(spark, 4, 3, 5), "value")


# ---- catalogue and flows


def _catalog(t):
    s = t("supplier")
    return s.select(
        F.concat(F.lit("set_"), F.floor(F.col("s_suppkey") / 2).cast("string")).alias("identifier"),
        F.when(F.col("s_suppkey") % 7 == 0, C.ASSEMBLY).when(F.col("s_suppkey") % 31 == 0, "other").otherwise(C.STIMULI).alias("lookup_type"),
        F.when(F.col("s_suppkey") % 11 == 0, "bad").otherwise(F.sha1("s_name")).alias("sha1"),
        F.lit("local").alias("location_type"), F.col("s_name").alias("location"), F.lit(None).cast("string").alias("stimulus_set_identifier"), F.lit("table").alias("class"),
    )


@query("""WITH c AS (SELECT 'set_' || s_suppkey // 2 AS identifier, CASE WHEN s_suppkey % 7 = 0 THEN 'assembly' WHEN s_suppkey % 31 = 0 THEN 'other' ELSE 'stimulus_set' END AS lookup_type, CASE WHEN s_suppkey % 11 = 0 THEN 'bad' ELSE sha1(s_name) END AS sha1 FROM supplier),
p AS (SELECT lookup_type, count(*) AS n FROM c GROUP BY identifier, lookup_type)
SELECT 'repeated columns' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'missing columns', 0 UNION ALL SELECT 'bad column names', 0
UNION ALL SELECT 'bad sha1', count(*) FILTER (NOT regexp_matches(sha1, '^[a-f0-9]{40}$')) FROM c UNION ALL SELECT 'repeated sha1', count(sha1) - count(DISTINCT sha1) FROM c
UNION ALL SELECT 'bad lookup type', count(*) FILTER (lookup_type NOT IN ('assembly', 'stimulus_set')) FROM c
UNION ALL SELECT 'assemblies without one row', count(*) FILTER (lookup_type = 'assembly' AND n <> 1) FROM p UNION ALL SELECT 'stimulus sets without two rows', count(*) FILTER (lookup_type = 'stimulus_set' AND n <> 2) FROM p""")
def catalog_validate(t, spark):
    return C.catalog_violations(_catalog(t))


@query("SELECT 'set_' || s_suppkey // 2 AS identifier, s_name AS location FROM supplier WHERE s_suppkey // 2 = 5 AND s_suppkey % 7 <> 0 AND s_suppkey % 31 <> 0")
def catalog_lookup(t, spark):
    return _catalog(t).where((F.col("identifier") == "set_5") & (F.col("lookup_type") == C.STIMULI)).select("identifier", "location")


@query("""WITH m AS (SELECT c_name AS f FROM customer WHERE c_custkey % 10 <> 0)
SELECT 'bad stimulus id' AS rule, count(*) FILTER (NOT regexp_matches(c_name, '^[a-zA-Z0-9]+$')) AS n FROM customer UNION ALL SELECT 'repeated stimulus id', count(*) - count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'repeated file name', count(*) - count(DISTINCT c_name) FROM customer UNION ALL SELECT 'file not in archive', count(*) FROM customer WHERE c_name NOT IN (SELECT f FROM m)""")
def stimulus_set_validate(t, spark):
    c = t("customer").select(F.col("c_name").alias("stimulus_id"), F.col("c_name").alias("filename"), "c_custkey")
    return C.stimulus_set_violations(c.drop("c_custkey"), c.where("c_custkey % 10 <> 0").select("filename"))


@query("""WITH u AS (SELECT o_custkey AS stimulus, o_orderkey % 30000 + 1 AS trial_number FROM orders WHERE o_orderkey % 30000 + 1 <> 0),
p AS (SELECT stimulus, CAST((trial_number - 1) // 750 AS BIGINT) AS session, (trial_number - 1) % 750 AS trial FROM u)
SELECT stimulus, session, trial, CAST(row_number() OVER (ORDER BY session, trial, stimulus) - 1 AS BIGINT) AS presentation,
CAST(row_number() OVER (PARTITION BY stimulus ORDER BY session, trial) - 1 AS INTEGER) AS repetition, CAST(2 * (trial // 125) + CASE WHEN trial % 125 >= 63 THEN 1 ELSE 0 END AS BIGINT) AS run FROM p""")
def flow_presentations(t, spark):
    wide = t("orders").select(F.col("o_custkey").alias("stimulus"), (F.col("o_orderkey") % 30000 + 1).alias("subject0_rep0"))
    return D.presentations(wide, "stimulus", ["subject0_rep0"])


@query(f"""WITH s AS (SELECT event_id, user_id, event_type, ts, value FROM events), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS repetition FROM s WHERE event_type <> 'error'),
b AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS d FROM s WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id, user_id, repetition, {r('(value - m) / (d + 1e-6)')} AS value FROM r JOIN b USING (user_id)""")
def flow_spontaneous_scores(t, spark):
    e = t("events").select("event_id", "user_id", "event_type", "ts", "value")
    return rr(D.scored_by_spontaneous(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "repetition", "value"), "value")


from arraysail import queries_io, queries_models  # noqa: E402, F401  (they add to QUERIES and SQL)
