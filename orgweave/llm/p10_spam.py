"""Problem 10: documents that are keyword piles, link lists or product tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orgweave.llm.spam_pages import find_spam
from orgweave.tables import table


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The spam documents with the share of their text that is, and how redundant and how stuffed they are."""
    return find_spam(table(spark, folder, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The spam documents."""
    return p10_scores(spark, folder).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores}
