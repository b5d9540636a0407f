"""Problem 6: alias groups that name the same organisation, however it is spelled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm import names as N
from orgweave.llm.encoding_repair import quick_repair
from orgweave.llm.merge_rematch import EVIDENCE, evidence_of, placeholders, resolve
from orgweave.session import Scratch
from orgweave.tables import table


SALT = 16


def read_entries(entries: DataFrame, generic: frozenset[str]) -> DataFrame:
    """Evidence (EVIDENCE) of (rid, as_name, org_name) rows; null names say nothing."""
    shared = entries.sparkSession.sparkContext.broadcast(generic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, code, name in zip(*(c.to_pylist() for c in batch.columns)):
                code, name = quick_repair(code), quick_repair(name)
                rows += [(rid, *e) for e in evidence_of([name] if name else [], [code] if code else [], [], shared.value)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rid", "key", "trust", "country", "cc", "rest"])

    return entries.mapInArrow(run, EVIDENCE)


def name_clusters(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """``alias_id, cluster``: alias groups that name one organisation share a cluster.

    Records are the alias groups, with the names of all their entries in any
    snapshot, and the registry's organisations with their own and other names
    (aka), which tie spellings together and are left out of the result.
    """
    entries = table(spark, folder, "saint_org_families").select("alias_id", F.explode("asn_entries").alias("e"))
    named = entries.select((F.col("alias_id") * 2).alias("rid"), F.col("e.as_name").alias("as_name"), F.col("e.org_name").alias("org_name"))
    registry = table(spark, folder, "org").select("org_key", F.concat(F.array("org_name"), F.coalesce("aka", F.array())).alias("n"))
    other = registry.select((F.col("org_key") * 2 + 1).alias("rid"), F.lit(None).cast("string").alias("as_name"), F.explode("n").alias("org_name"))
    # Rows of a name meet in few tasks, where it is read once; the salt splits a hot name.
    both = named.unionByName(other).where("rid is not null").withColumn("salt", F.pmod("rid", F.lit(SALT)))
    rows = scratch.cut(both.repartition("org_name", "salt").distinct().drop("salt"))
    names = scratch.cut(rows.select("org_name").distinct())
    generic = N.generic_words(names.where("org_name is not null"), "org_name")
    empty = placeholders(rows, F.lower("as_name"), "org_name", generic, names.count())
    generic |= {N.read_code(code)[0] for code in empty}
    clusters = resolve(read_entries(rows, generic), scratch)
    return clusters.where(F.col("rid") % 2 == 0).select(F.shiftright("rid", 1).alias("alias_id"), "cluster")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of alias groups that name the same organisation."""
    members = name_clusters(spark, folder, Scratch(spark, "p6"))
    a = members.select(F.col("alias_id").alias("alias_id_a"), "cluster")
    b = members.select(F.col("alias_id").alias("alias_id_b"), "cluster")
    return a.join(b, "cluster").where("alias_id_a < alias_id_b").select("alias_id_a", "alias_id_b")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every alias group with the smallest alias_id of its organisation."""
    members = name_clusters(spark, folder, Scratch(spark, "p6"))
    first = members.groupBy("cluster").agg(F.min("alias_id").alias("first_alias_id"))
    return members.join(first, "cluster").select("alias_id", "first_alias_id")


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
