"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arraysail.llm import cross_parsing, decontamination, html_extraction, near_dedup, pieces, quality_classifier, quality_rules, token_counts, tool_chat, toxicity
from arraysail.llm._common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op3_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(spark, table(spark, sf_dir, "pages"))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.select(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.select(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash_near_dedup, op3_tool_chat, op4_html_extraction, op5_cross_parsing, op6_token_counts, op7_sentencepiece, op8_quality_classifier, op9_decontamination, op10_quality_rules, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_tool_chat": tool_chat.PLAIN_SQL}
