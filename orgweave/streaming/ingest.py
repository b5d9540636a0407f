"""Incremental ingestion: new files once, new rows once, late months kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.text import content_key


def ingest_available(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Process the files of a folder that no earlier run has, append the result, end."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert_stream(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str, keys: list[str]) -> None:
    """As ``ingest_available``, appending only rows whose content key the target lacks: a retried batch adds nothing."""

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("id", content_key(*(F.col(k) for k in keys))).dropDuplicates(["id"])
        # Only a missing table is empty; one that can't be read fails the batch.
        out = fresh.join(spark.read.parquet(target).select("id"), "id", "left_anti") if exists(spark, target) else fresh
        out.write.mode("append").parquet(target)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, group: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and group; events later than ``late`` behind the newest are left out (streams only)."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, window).alias("w"), group).count().select(F.col("w.start").alias("start"), group, "count")
