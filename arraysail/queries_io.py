"""Queries for readers, archives, kept results and the catalogue: a table goes out to the shared folder and is read back."""

from __future__ import annotations

import io
import uuid
import zipfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arraysail.operators import layout as L
from arraysail.operators import setops as U
from arraysail.plans import catalog as C
from arraysail.plans import materialize as Z
from arraysail.queries import query
from arraysail.session import shared_folder
from arraysail.sources import binary as B
from arraysail.sources import constants as K
from arraysail.sources import text as T


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()


@query("SELECT CAST(c_custkey AS VARCHAR) AS customer, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def read_csv_strings(t, spark):
    path = _place(spark)
    t("customer").select("c_custkey", "c_name", "c_nationkey").write.csv(path, header=True)
    return T.read_csv(spark, path, columns=["c_custkey", "c_name", "c_nationkey"], rename={"c_custkey": "customer"})


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def read_csv_schema(t, spark):
    path, rows = _place(spark), t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows.write.csv(path, header=True)
    return T.read_csv(spark, path, ", ".join(f"{n} {k}" for n, k in rows.dtypes))


@query("SELECT p_partkey, p_name, p_size FROM part")
def read_tsv(t, spark):
    path, rows = _place(spark), t("part").select("p_partkey", "p_name", "p_size")
    rows.write.csv(path, header=True, sep="\t")
    return T.read_tsv(spark, path, ", ".join(f"{n} {k}" for n, k in rows.dtypes))


@query("SELECT vec_id, CAST(k - 1 AS INTEGER) AS feature, round(CAST(embedding[k] AS DOUBLE), 6) AS value FROM embeddings, range(1, 65) t(k)")
def read_vectors(t, spark):
    path, cells = _place(spark), F.transform("embedding", lambda x: x.cast("double").cast("string"))
    t("embeddings").select(F.array_join(F.concat(F.array(F.col("vec_id").cast("string")), cells), "\t")).write.text(path)
    rows = T.read_vectors(spark, path, 65).select(F.col("features")[0].cast("bigint").alias("vec_id"), F.slice("features", 2, 64).alias("x"))
    return L.to_long(rows, "x").select("vec_id", "feature", F.round("value", 6).alias("value"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS label, replace(n_name, ' ', '_') AS name FROM nation")
def read_label_table(t, spark):
    path = _place(spark)
    lines = t("nation").select(F.concat(F.lit("  "), F.col("n_nationkey").cast("string"), F.lit("   "), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("  0 0 0")))
    lines.union(spark.createDataFrame([("# label name r g b",), ("",)], "value string")).write.text(path)
    return T.read_label_table(spark, path)


@query("SELECT p_partkey || '.v1' AS stem FROM part")
def read_stems(t, spark):
    path = _place(spark)
    t("part").select(F.concat(F.lit("images/"), F.col("p_partkey").cast("string"), F.lit(".v1.jpg"))).write.text(path)
    return T.read_stems(spark, path)


@query("SELECT 's' || s_suppkey AS stimulus, 'a/s' || s_suppkey || '.png' AS path FROM supplier")
def read_keyed_lines(t, spark):
    path = _place(spark)
    t("supplier").select(F.concat(F.lit("a/s"), F.col("s_suppkey").cast("string"), F.lit(".png"))).write.text(path)
    return T.read_keyed_lines(spark, path)


@query("SELECT n_nationkey AS id, n_name AS caption FROM nation")
def read_annotations(t, spark):
    path, rows = _place(spark), t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("caption"))
    whole = rows.agg(F.to_json(F.struct(F.lit(1).alias("info"), F.collect_list(F.struct("id", "caption")).alias("annotations"))))
    whole.write.text(path)
    return T.read_annotations(spark, path, f"annotations array<struct<id: {dict(rows.dtypes)['id']}, caption: string>>", "annotations")


@query("SELECT x, y, z, CAST(2 * (x * 6 + y * 2 + z) + 1 AS DOUBLE) AS value FROM (SELECT CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, CAST(c AS INTEGER) AS z FROM range(0, 4) t(a), range(0, 3) u(b), range(0, 2) v(c))")
def read_nifti(t, spark):
    path = _place(spark)
    _put(spark, f"{path}/volume.nii", B.encode_nifti(np.arange(24, dtype="f4").reshape(4, 3, 2), 2.0, 1.0))
    return B.read_nifti(spark, path).drop("path")


@query("SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CAST(a * 5 + b AS DOUBLE) AS value FROM range(0, 7) t(a), range(0, 5) u(b)")
def read_npy(t, spark):
    path, out = _place(spark), io.BytesIO()
    np.save(out, np.arange(35).reshape(7, 5))
    _put(spark, f"{path}/a.npy", out.getvalue())
    return B.read_npy(spark, path).select(F.col("index")[0].alias("i"), F.col("index")[1].alias("j"), "value")


def _named(t) -> list:
    return t("nation").select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("n"), F.col("n_regionkey").cast("string").alias("r"), F.encode("n_name", "UTF-8").alias("c")).collect()


@query("SELECT replace(n_name, ' ', '_') AS stimulus, 'r' || n_regionkey AS category, replace(n_name, ' ', '_') || '.png' AS filename, CAST(length(n_name) AS BIGINT) AS length, sha1(n_name) AS sha1 FROM nation")
def read_images(t, spark):
    path = _place(spark)
    for r in _named(t):
        _put(spark, f"{path}/r{r['r']}/{r['n']}.png", bytes(r["c"]))
    return B.read_images(spark, path).drop("path")


@query("SELECT 'r' || n_regionkey || '.zip' AS archive, replace(n_name, ' ', '_') AS member, CAST(length(n_name) AS BIGINT) AS size FROM nation")
def archive_members(t, spark):
    path, rows = _place(spark), _named(t)
    for region in {r["r"] for r in rows}:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in rows:
                if r["r"] == region:
                    z.writestr(r["n"], bytes(r["c"]))
        _put(spark, f"{path}/r{region}.zip", out.getvalue())
    return B.members(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "member", "size")


@query("SELECT CAST(s AS INTEGER) AS subject, CAST(n AS INTEGER) AS n_sessions, CAST(750 * n AS INTEGER) AS n_trials FROM (VALUES (0, 40), (1, 40), (2, 32), (3, 30), (4, 40), (5, 32), (6, 40), (7, 30)) v(s, n)")
def constant_sessions(t, spark):
    return K.sessions(spark)


@query("SELECT CAST(a AS INTEGER) AS subject, CAST(b AS INTEGER) AS session, CAST(c AS INTEGER) AS run FROM range(1, 4) t(a), range(1, 13) u(b), range(1, 11) v(c)")
def constant_runs(t, spark):
    return K.run_grid(spark)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def kept_result(t, spark):
    make = lambda: t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    path = _place(spark)
    Z.materialize(spark, make, path, "normal")
    return Z.materialize(spark, lambda: make().limit(0), path, "readonly")


@query("SELECT s_suppkey, CAST(s_nationkey AS INTEGER) AS s_nationkey FROM supplier")
def appended_result(t, spark):
    path, s = _place(spark), t("supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("s_nationkey"))
    for k in (0, 1):
        Z.append(s.where(F.col("s_suppkey") % 2 == k), path, "s_nationkey")
    return spark.read.parquet(path)


@query("SELECT p_partkey, p_retailprice FROM part")
def catalog_package_and_load(t, spark):
    c = C.Catalog(spark, "arrays", _place(spark))
    rows = t("part").select("p_partkey", "p_retailprice")
    c.package(rows.limit(0), "prices")
    c.package(rows, "prices", force=True)
    c.package(rows.limit(0), "prices")  # there already
    return c.load("prices")


@query("SELECT 'kept' AS identifier, 'assembly' AS lookup_type")
def catalog_append_and_delete(t, spark):
    c = C.Catalog(spark, "arrays", _place(spark))
    entry = {"lookup_type": C.ASSEMBLY, "location_type": "local", "location": "none", "class": "table"}
    c.append({"identifier": "kept", "sha1": "a" * 40} | entry)
    c.append({"identifier": "gone", "sha1": "b" * 40} | entry)
    c.delete("gone", C.ASSEMBLY)
    return c.table.select("identifier", "lookup_type")


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS orders_in_customers, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) = 0 AS customers_in_orders")
def subset_test(t, spark):
    o, c = t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k"))
    return spark.createDataFrame([(U.is_subset(o, c, ["k"]), U.is_subset(c, o, ["k"]))], "orders_in_customers boolean, customers_in_orders boolean")
