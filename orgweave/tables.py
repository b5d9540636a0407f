"""Table access: one Parquet table (file or folder) per name under a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` under ``folder``; columns are pruned by the caller's plan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views over the tables, for ``spark.sql`` users."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
