"""Queries of the training-data operators over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import history, leakage, lines, neighbours, packing, spam, subjects, truncation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, d, "preprocessed_articles"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "preprocessed_articles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return history.first_reports(table(spark, d, "corpus_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "preprocessed_articles"))


def p4_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, d, "preprocessed_articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, d, "article_encodings"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p4_by_source, p5_found, p7_packed, p8_found, p9_found)
}
ORACLES: dict[str, str] = {}
