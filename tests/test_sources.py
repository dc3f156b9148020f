"""Readers, archives, materialisation, the catalogue and streams, on small files."""

import hashlib
import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraysail.errors import CatalogError
from arraysail.operators import windows as W
from arraysail.plans import catalog as C
from arraysail.plans import materialize as Z
from arraysail.sources import binary as B
from arraysail.sources import constants as K
from arraysail.sources import text as T
from arraysail.streaming import occurrence as O


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    assert rows(T.read_csv(spark, str(tmp_path / "a.csv"), columns=["id", "name"]), "id", "name") == [("1", "x"), ("2", "y")]
    assert T.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string", rename={"id": "k"}).dtypes == [("k", "int"), ("name", "string")]
    (tmp_path / "b.tsv").write_text("id\tv\n1\t2.5\n")
    assert rows(T.read_tsv(spark, str(tmp_path / "b.tsv"), "id int, v double"), "id", "v") == [(1, 2.5)]
    (tmp_path / "v.tsv").write_text("1\t2\n3\tx\n\n5\t6\n")
    assert [(r["line"], r["features"]) for r in T.read_vectors(spark, str(tmp_path / "v.tsv"), 2).orderBy("line").collect()] == [(0, [1.0, 2.0]), (1, [3.0, None]), (3, [5.0, 6.0])]
    (tmp_path / "l.ctab").write_text("# a comment\n  1   V1  0 0\n2 V2\n")
    assert rows(T.read_label_table(spark, str(tmp_path / "l.ctab")), "label", "name") == [(1, "V1"), (2, "V2")]
    (tmp_path / "s.txt").write_text("d/one.two.jpg\nthree.png\n")
    assert rows(T.read_stems(spark, str(tmp_path / "s.txt")), "stem") == [("one.two",), ("three",)]
    assert rows(T.read_keyed_lines(spark, str(tmp_path / "s.txt")), "stimulus", "path")[0] == ("one.two", "d/one.two.jpg")
    (tmp_path / "n.json").write_text(json.dumps({"info": 1, "annotations": [{"id": 1, "caption": "a"}, {"id": 2, "caption": "b"}]}, indent=1))
    assert rows(T.read_annotations(spark, str(tmp_path / "n.json"), "annotations array<struct<id: int, caption: string>>", "annotations"), "id", "caption") == [(1, "a"), (2, "b")]


def test_arrays(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    got = {tuple(r["index"]): r["value"] for r in B.read_npy(spark, str(tmp_path)).collect()}
    assert got == {i: a[i] for i in np.ndindex(a.shape)}
    np.save(tmp_path / "bad.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        B.read_npy(spark, str(tmp_path / "bad.npy")).collect()
    volumes = tmp_path / "v"
    volumes.mkdir()
    (volumes / "m.nii").write_bytes(B.encode_nifti(a.astype("f4"), 2.0, 1.0))
    import gzip

    (volumes / "z.nii.gz").write_bytes(gzip.compress(B.encode_nifti(a.astype("f4"))))
    got = {(r["path"].rsplit("/", 1)[1], r["x"], r["y"], r["z"]): r["value"] for r in B.read_nifti(spark, str(volumes)).collect()}
    assert len(got) == 48 and all(got["m.nii", *i] == a[i] * 2 + 1 and got["z.nii.gz", *i] == a[i] for i in np.ndindex(a.shape))
    with pytest.raises(ValueError):
        B.decode_nifti(b"\0" * 400)


def test_images_and_archives(spark, tmp_path):
    (tmp_path / "i" / "dog").mkdir(parents=True)
    (tmp_path / "i" / "dog" / "d1.jpg").write_bytes(b"pixels")
    (r,) = B.read_images(spark, str(tmp_path / "i")).collect()
    assert (r["stimulus"], r["category"], r["length"], r["sha1"]) == ("d1", "dog", 6, hashlib.sha1(b"pixels").hexdigest())
    z, t = tmp_path / "z" / "a.zip", tmp_path / "z" / "b.tar"
    z.parent.mkdir()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("one.txt", "1")
    with tarfile.open(t, "w") as f:
        info = tarfile.TarInfo("two.txt")
        info.size = 2
        f.addfile(info, io.BytesIO(b"22"))
    assert rows(B.members(spark, str(z.parent)), "member", "size") == [("one.txt", 1), ("two.txt", 2)]
    assert B.unzip(str(z), str(tmp_path / "out"), remove=False) == ["one.txt"] and z.exists()
    assert B.unzip(str(z), str(tmp_path / "out")) == ["one.txt"] and not z.exists()
    assert B.untar(str(t), str(tmp_path / "out")) == ["two.txt"] and (tmp_path / "out" / "two.txt").read_text() == "22"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../evil.txt", "1")
    with pytest.raises(ValueError):
        B.unzip(str(z), str(tmp_path / "out"))


def test_constants(spark):
    assert K.sessions(spark).agg(F.sum("n_trials")).first()[0] == 284 * 750
    assert K.epochs(spark).count() == 2 and K.run_grid(spark).count() == 360


def test_materialisation_modes(spark, tmp_path):
    path, calls = str(tmp_path / "m"), []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    run = lambda mode: Z.materialize(spark, make, path, mode).count()
    assert run("readonly") == 1 and not Z.exists(spark, path)
    assert run("normal") == 2 and run("normal") == 2 and run("readonly") == 2 and len(calls) == 2
    assert run("overwrite") == 3 and run("ignore") == 4 and run("normal") == 3
    assert run("delete") == 5 and not Z.exists(spark, path)
    with pytest.raises(ValueError):
        run("other")
    df = Z.replace(spark, spark.range(3), path)
    assert Z.replace(spark, df.union(df), path).count() == 6  # a plan that reads what it replaces
    Z.append(spark.range(2).withColumn("node", F.lit("a")), str(tmp_path / "p"), "node")
    Z.append(spark.range(3).withColumn("node", F.lit("b")), str(tmp_path / "p"), "node")
    assert spark.read.parquet(str(tmp_path / "p")).where("node = 'b'").count() == 3


def test_cache_decorator(spark, tmp_path):
    calls = []

    @Z.cached("numbers/n={n}")
    def numbers(session, n, scale=1):
        calls.append(n)
        return session.range(n)

    assert numbers(spark, 3).count() == 3 and numbers(spark, 3).count() == 3 and len(calls) == 2  # no home: nothing is kept
    spark.conf.set(Z.HOME, str(tmp_path))
    try:
        assert numbers(spark, 4).count() == numbers(spark, n=4).count() == 4 and calls.count(4) == 1
        assert numbers(spark, 5).count() == 5
    finally:
        spark.conf.unset(Z.HOME)


def test_catalog(spark, tmp_path):
    c = C.Catalog(spark, "mine", str(tmp_path))
    assert c.table.count() == 0
    assert c.package(spark.range(4), "one") and not c.package(spark.range(5), "one")
    assert c.load("one").count() == 4
    assert c.package(spark.range(5), "one", force=True) and c.load("one").count() == 5
    stimuli = spark.createDataFrame([("s1", "a.png"), ("s2", "b.png")], "stimulus_id string, filename string")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.zip").write_bytes(b"zip")
    assert c.package_stimulus_set(stimuli, str(tmp_path / "files"), "pictures") and not c.package_stimulus_set(stimuli, "", "pictures")
    c.validate()
    assert c.load("pictures", C.STIMULI).count() == 2
    with pytest.raises(CatalogError):
        c.package_stimulus_set(stimuli.union(stimuli), str(tmp_path / "files"), "twice")
    spark.range(9).write.mode("overwrite").parquet(c.lookup("one", C.ASSEMBLY).collect()[0]["location"])
    with pytest.raises(CatalogError):
        c.load("one")
    c.drop("one")
    with pytest.raises(CatalogError):
        c.load("one")
    c.append({"identifier": "x", "lookup_type": "none", "sha1": "z"})
    with pytest.raises(CatalogError):
        C.Catalog(spark, "mine", str(tmp_path))
    assert C.assembly_violations({"identifier": "a", "stimulus_set_identifier": 3}) == ["stimulus_set_identifier"]
    bad = {r["rule"]: r["n"] for r in C.catalog_violations(spark.createDataFrame([(1, 2)], "Identifier int, sha1 int")).collect()}
    assert bad == {"repeated columns": 0, "missing columns": 6, "bad column names": 1}
    (tmp_path / "src.txt").write_text("x")
    assert C.fetch(str(tmp_path / "src.txt"), str(tmp_path / "to")).endswith("to/src.txt")


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.where("event_id % 2 = 0 or event_id > 500").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = run(O.running_occurrence(source(), ["user_id"], "ts", "event_id"), "occurrences")
    want = W.occurrence(spark.read.parquet(str(tmp_path / "in")), ["user_id"], ["ts", "event_id"])
    assert rows(got, "event_id", "repetition") == rows(want, "event_id", "repetition")
    means = run(O.windowed_mean(source(), ["event_type"], "ts", "value", "2 days", "1 day", "1 hour"), "means")
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy("event_type", F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"))
    assert 0 < means.count() <= batch.count() and set(rows(means, "event_type", "start", "n")) <= set(rows(batch, "event_type", "window.start", "n"))
    assert run(O.deduplicated(source(), "event_id", "ts", "1 hour"), "unique").count() == want.count()
