"""Problem 3: organisation and AS names that were decoded with the wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm.encoding_repair import Trained, not_ascii, repair
from orgweave.session import Scratch
from orgweave.tables import table


def name_fields(families: DataFrame) -> DataFrame:
    """``snap_month, alias_id, asn, field_name, text`` of every name of every entry; null lists, entries and names give none."""
    entries = families.select("snap_month", "alias_id", F.explode("asn_entries").alias("e"))
    pair = F.explode(
        F.array(
            F.struct(F.lit("as_name").alias("field_name"), F.col("e.as_name").alias("text")),
            F.struct(F.lit("org_name").alias("field_name"), F.col("e.org_name").alias("text")),
        )
    ).alias("f")
    named = entries.select("snap_month", "alias_id", F.col("e.asn").alias("asn"), pair)
    return named.select("snap_month", "alias_id", "asn", "f.field_name", "f.text").where("text is not null")


def garbled_names(spark: SparkSession, folder: str) -> DataFrame:
    """``text, restored, chain``: each distinct garbled name of the whole table."""
    scratch = Scratch(spark, "p3")
    names = scratch.cut(name_fields(table(spark, folder, "saint_org_families")).select("text").distinct())
    return scratch.cut(repair(names, "text", Trained(names, "text"), scratch))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every name field of an entry that holds wrongly decoded text."""
    fields = name_fields(table(spark, folder, "saint_org_families")).where(not_ascii("text")).distinct()
    return fields.join(garbled_names(spark, folder).select("text"), "text", "left_semi").drop("text").distinct()


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct garbled name with the original where it can be had, and the chain that gave it."""
    return garbled_names(spark, folder).withColumnRenamed("text", "garbled")


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
