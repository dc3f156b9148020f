"""A corpus pipeline in five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arraysail.llm import decontamination, near_dedup, pieces, quality_classifier, quality_rules
from arraysail.llm._common import checkpoint_dir, delete, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps.

    Null and empty texts compete without evidence, repeated rows and ties stay or
    go together, an empty table stays empty, other columns are untouched.
    """
    return quality_classifier.keep(spark, docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no outliers of their language and source.

    Null languages and sources are groups of their own, null and empty texts are
    near the centre, repeated rows are judged alike, an empty table stays empty.
    """
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id.

    Null ids and texts without a word stay, repeated rows of an id become one,
    an empty table stays empty.
    """
    return near_dedup.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark, their characters counted anew.

    Null texts stay null, repeated rows are cleaned alike, an empty table or an
    empty benchmark changes nothing.
    """
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each document; null and empty texts have no ids, an empty table gives none."""
    return pieces.encode(docs)


STAGES = [("quality classifier", quality), ("quality rules", rules), ("near dedup", dedup), ("decontamination", decontaminate), ("pieces", encode)]

#: Models that are trained and searches over text have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are a table in the shared folder.

    A table is deleted when the next one is written; that before the last stage,
    which the result reads, stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                delete(spark, f"{folder}/{i - 1}")
    return docs
