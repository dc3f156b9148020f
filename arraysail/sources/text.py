"""Delimited text, line lists and nested JSON with fixed schemas (SRC01-08)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.functions.scalar import stem


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] = (), sep: str = ",", rename: Mapping[str, str] | None = None) -> DataFrame:
    """A headered file; without a schema all ``columns`` are strings, nothing is inferred."""
    schema = schema or ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, header=True, schema=schema, sep=sep, enforceSchema=False).withColumnsRenamed(dict(rename or {}))


def read_tsv(spark: SparkSession, path: str, schema: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", rename=rename)


def read_vectors(spark: SparkSession, path: str, width: int, sep: str = "\t", name: str = "features") -> DataFrame:
    """(file, line, array) of headerless numbers; the place of a line is its order in the file, read whole for that."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    parts = F.transform(F.split("value", sep), lambda x: x.try_cast("double"))
    return lines.select("file", "line", parts.alias(name)).where(F.size(name) == width)


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """(label, name) of a table in columns apart by white space, comments after #."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    return rows.select(F.get(p, F.lit(0)).try_cast("int").alias("label"), F.get(p, F.lit(1)).alias("name")).where(F.col("label").isNotNull())


def read_stems(spark: SparkSession, path: str) -> DataFrame:
    """(stem) of the file names in a list."""
    return spark.read.text(path).where(F.trim("value") != "").select(stem(F.trim("value")).alias("stem"))


def read_keyed_lines(spark: SparkSession, path: str, name: str = "path", key: str = "stimulus") -> DataFrame:
    """A headerless column of paths with their stems as keys."""
    rows = spark.read.csv(path, schema=f"`{name}` string")
    return rows.select(stem(name).alias(key), name)


def read_annotations(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The records of an array field of a nested JSON file."""
    return spark.read.json(path, schema=schema, multiLine=True).select(F.inline(field))
