"""A catalogue of artefacts with its validators (SNK06-13, SNK15)."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.errors import CatalogError
from arraysail.functions.scalar import is_alphanumeric, is_header, is_sha1
from arraysail.plans.materialize import delete, exists, replace

COLUMNS = ("identifier", "lookup_type", "sha1", "location_type", "location", "stimulus_set_identifier", "class")
ASSEMBLY, STIMULI = "assembly", "stimulus_set"
SCHEMA = ", ".join(f"`{c}` string" for c in COLUMNS)


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """(rule, n) of every rule of a catalogue, two aggregates over all rows."""
    names = catalog.columns
    spark = catalog.sparkSession
    fixed = [("repeated columns", len(names) - len({n.lower() for n in names})), ("missing columns", len(set(COLUMNS) - set(names)))]
    fixed.append(("bad column names", spark.createDataFrame([(n,) for n in names], "n string").where(~is_header("n")).count()))
    rules = spark.createDataFrame(fixed, "rule string, n long")
    if set(COLUMNS) - set(names):
        return rules
    bad = catalog.agg(
        F.count_if(~F.coalesce(is_sha1("sha1"), F.lit(False))).alias("bad sha1"),
        (F.count("sha1") - F.count_distinct("sha1")).alias("repeated sha1"),
        F.count_if(~F.coalesce(F.col("lookup_type").isin(ASSEMBLY, STIMULI), F.lit(False))).alias("bad lookup type"),
    )
    per = catalog.groupBy("identifier", "lookup_type").agg(F.count("*").alias("n"))
    wrong = per.agg(
        F.count_if((F.col("lookup_type") == ASSEMBLY) & (F.col("n") != 1)).alias("assemblies without one row"),
        F.count_if((F.col("lookup_type") == STIMULI) & (F.col("n") != 2)).alias("stimulus sets without two rows"),
    )
    both = bad.crossJoin(wrong)
    return rules.unionByName(both.unpivot([], both.columns, "rule", "n"))


def stimulus_set_violations(stimuli: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(rule, n) of a stimulus set; ``members`` are the file names of its archive."""
    bad = stimuli.agg(
        F.count_if(~F.coalesce(is_alphanumeric("stimulus_id"), F.lit(False))).alias("bad stimulus id"),
        (F.count("*") - F.count_distinct("stimulus_id")).alias("repeated stimulus id"),
        (F.count("*") - F.count_distinct("filename")).alias("repeated file name"),
    )
    if members is not None:
        bad = bad.crossJoin(stimuli.join(members.select(F.col(members.columns[0]).alias("filename")), "filename", "left_anti").agg(F.count("*").alias("file not in archive")))
    return bad.unpivot([], bad.columns, "rule", "n")


def assembly_violations(properties: dict, required: Sequence[str] = ("identifier", "stimulus_set_identifier")) -> list[str]:
    """Required properties that are missing or no strings."""
    return [k for k in required if not isinstance(properties.get(k), str)]


class Catalog:
    """A table of artefacts below a folder; created where it is missing, checked where it is opened."""

    def __init__(self, spark: SparkSession, identifier: str, folder: str, validate: bool = True):
        self.spark, self.identifier = spark, identifier
        self.path, self.cache = f"{folder}/{identifier}", f"{folder}/{identifier}-artefacts"
        if not exists(spark, self.path):
            replace(spark, spark.createDataFrame([], SCHEMA), self.path)
        if validate:
            self.validate()

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def validate(self) -> None:
        wrong = catalog_violations(self.table).where("n > 0").collect()
        if wrong:
            raise CatalogError(", ".join(f"{r['rule']}: {r['n']}" for r in wrong))

    def lookup(self, identifier: str, lookup_type: str) -> DataFrame:
        return self.table.where((F.col("identifier") == identifier) & (F.col("lookup_type") == lookup_type))

    def append(self, entry: dict) -> None:
        replace(self.spark, self.table.unionByName(self.spark.createDataFrame([tuple(entry.get(c) for c in COLUMNS)], SCHEMA)), self.path)

    def delete(self, identifier: str, lookup_type: str) -> None:
        gone = (F.col("identifier") == identifier) & (F.col("lookup_type") == lookup_type)
        replace(self.spark, self.table.where(~F.coalesce(gone, F.lit(False))), self.path)

    def package(self, df: DataFrame, identifier: str, stimulus_set_identifier: str | None = None, force: bool = False) -> bool:
        """Writes an assembly and its entry; nothing where it is there already, unless ``force``. True where it wrote."""
        if not self.lookup(identifier, ASSEMBLY).isEmpty():
            if not force:
                return False
            self.delete(identifier, ASSEMBLY)
        location = f"{self.cache}/{identifier}"
        replace(self.spark, df, location)
        self.append({"identifier": identifier, "lookup_type": ASSEMBLY, "sha1": content_sha1(self.spark, location), "location_type": "local", "location": location, "stimulus_set_identifier": stimulus_set_identifier, "class": "table"})
        return True

    def package_stimulus_set(self, stimuli: DataFrame, archive: str, identifier: str, force: bool = False) -> bool:
        """A stimulus table and its archive of files, two entries."""
        if not self.lookup(identifier, STIMULI).isEmpty():
            if not force:
                return False
            self.delete(identifier, STIMULI)
        wrong = stimulus_set_violations(stimuli).where("n > 0").collect()
        if wrong:
            raise CatalogError(", ".join(f"{r['rule']}: {r['n']}" for r in wrong))
        location = f"{self.cache}/{identifier}"
        replace(self.spark, stimuli, location)
        for kind, place in (("table", location), ("archive", archive)):
            self.append({"identifier": identifier, "lookup_type": STIMULI, "sha1": content_sha1(self.spark, place), "location_type": "local", "location": place, "stimulus_set_identifier": identifier, "class": kind})
        return True

    def load(self, identifier: str, lookup_type: str = ASSEMBLY, check: bool = True) -> DataFrame:
        """The table of an entry; its files must still have their digest."""
        rows = self.lookup(identifier, lookup_type).where(F.col("class") == "table").collect()
        if len(rows) != 1:
            raise CatalogError(f"{len(rows)} entries of {identifier} as {lookup_type}")
        if check and content_sha1(self.spark, rows[0]["location"]) != rows[0]["sha1"]:
            raise CatalogError(f"{identifier} has another digest than its entry")
        return self.spark.read.parquet(rows[0]["location"])

    def drop(self, identifier: str, lookup_type: str = ASSEMBLY) -> None:
        for r in self.lookup(identifier, lookup_type).collect():
            delete(self.spark, r["location"])
        self.delete(identifier, lookup_type)


def content_sha1(spark: SparkSession, path: str) -> str:
    """One digest of the names and contents of all files below a path.

    Files are dealt to a fixed number of bins by their names; a bin's digest is
    that of its sorted names and digests, the result that of the bins.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    name = F.element_at(F.split("path", re.escape(root), 2), -1)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("n"), F.sha1("content").alias("d"))
    joined = lambda c: F.sha1(F.array_join(F.sort_array(F.collect_list(c)), ","))
    bins = d.groupBy(F.pmod(F.xxhash64("n"), F.lit(4096)).alias("b")).agg(joined(F.concat_ws(" ", "n", "d")).alias("d"))
    return bins.agg(joined(F.concat_ws(" ", F.col("b").cast("string"), "d")).alias("d")).first()[0]


def fetch(source: str, folder: str, force: bool = False) -> str:
    """A local copy of a local file (SNK14)."""
    to = os.path.join(folder, os.path.basename(source))
    if force or not os.path.exists(to):
        os.makedirs(folder, exist_ok=True)
        shutil.copy2(source, to)
    return to
