"""Problem 5: the main body of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orgweave.llm import main_text
from orgweave.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Page and number of every line of the page's main body."""
    pages = table(spark, folder, "clean_individual_html")
    learned = main_text.learn_weights(pages, "content", "org_name")
    return main_text.extract_main(pages, "page_id", "content", "org_name", learned)


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every page as text, markup removed."""
    pages = table(spark, folder, "clean_individual_html")
    learned = main_text.learn_weights(pages, "content", "org_name")
    return main_text.extract_bodies(pages, "page_id", "content", "org_name", learned)
