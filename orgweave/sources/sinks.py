"""Sinks: bundles, snippet store, tables, public records, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import content_key


def write_bundle(df: DataFrame, path: str, registry: str = "rir") -> None:
    """A registry's objects, partitioned by registry."""
    df.write.mode("overwrite").partitionBy(registry).parquet(path)


def upsert_snippets(store: DataFrame | None, fresh: DataFrame, key_columns: list[str]) -> DataFrame:
    """The store with the fresh rows whose content key it lacks; within the fresh rows repeats count once."""
    keyed = fresh.withColumn("id", content_key(*(F.col(c) for c in key_columns))).dropDuplicates(["id"])
    return keyed if store is None else store.unionByName(keyed.join(store.select("id"), "id", "left_anti").select(store.columns))


def append_unseen(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The store with the distinct fresh keys that it lacks."""
    return store.unionByName(fresh.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(store.columns))


def insert_missing(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """First write wins: as ``append_unseen``, one row for each key (the smallest)."""
    rest = [c for c in store.columns if c != key]
    first = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
    return store.unionByName(first.join(store.select(key), key, "left_anti").select(store.columns))


def relational_tables(families: DataFrame) -> dict[str, DataFrame]:
    """as_table, org_alias_table and alias_relationships of nested family rows (all parents, not only the first)."""
    entries = families.select("alias_id", F.explode("asn_entries").alias("e"))
    as_table = entries.select("e.asn", "e.as_name", "e.rir", "e.org_name", "alias_id").distinct()
    alias = families.select("org_family_id", "alias_id").distinct()
    links = families.select(F.col("alias_id").alias("child_alias_id"), F.explode("parent").alias("parent_alias_id")).distinct()
    return {"as_table": as_table, "org_alias_table": alias, "alias_relationships": links}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def public_records(as_table: DataFrame, alias: DataFrame, links: DataFrame) -> DataFrame:
    """Nested public records again: one row per alias group, an alias group without numbers with an empty list."""
    entry = F.struct(F.col("asn").cast("bigint").alias("asn"), "as_name", "org_name", "rir")
    entries = as_table.groupBy("alias_id").agg(F.array_sort(F.collect_set(entry)).alias("asn_entries"))
    parents = links.groupBy(F.col("child_alias_id").alias("alias_id")).agg(F.array_sort(F.collect_set("parent_alias_id")).alias("parent"))
    children = links.groupBy(F.col("parent_alias_id").alias("alias_id")).agg(F.array_sort(F.collect_set("child_alias_id")).alias("children"))
    out = alias.join(entries, "alias_id", "left").join(parents, "alias_id", "left").join(children, "alias_id", "left")
    out = out.withColumn("_id", F.substring(F.sha2(F.concat_ws("/", "org_family_id", "alias_id"), 256), 1, 24))
    kind = as_table.schema
    empty = F.array().cast(f"array<struct<asn:bigint,as_name:{kind['as_name'].dataType.simpleString()},org_name:string,rir:string>>")
    none = F.array().cast("array<bigint>")
    return out.select("_id", "alias_id", "org_family_id", F.coalesce("asn_entries", empty).alias("asn_entries"), F.coalesce(F.col("parent").cast("array<bigint>"), none).alias("parent"), F.coalesce(F.col("children").cast("array<bigint>"), none).alias("children"))


def archive(df: DataFrame, path: str, month: str) -> None:
    """A month's table; refuses to overwrite."""
    df.withColumn("month", F.lit(month)).write.mode("errorifexists").partitionBy("month").parquet(f"{path}/{month}")
