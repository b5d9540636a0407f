"""Registry objects to an organisation map: conflict resolution, enrichment, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions.text import normalize_name, starts_with_letter
from orgweave.operators.aggregates import cardinality_violations, group_organisations
from orgweave.operators.joins import enrich, latest_block, violations


def resolve_conflicts(objects: DataFrame, blocks: DataFrame) -> DataFrame:
    """One object per number: that of the registry which the latest containing block names, then the latest change.

    Numbers in no block keep the object changed last; null times are oldest and
    further ties go to the registry's name.
    """
    keyed = objects.select("asn").distinct()
    owner = latest_block(keyed, "asn", "asn", blocks.select("low", "high", F.col("changed_time").alias("block_time"), "assigned_to"), "low", "high", "block_time")
    known = objects.join(owner.select("asn", "assigned_to"), "asn", "left")
    right = F.coalesce(F.col("rir") == F.col("assigned_to"), F.lit(False))
    order = Window.partitionBy("asn").orderBy(right.desc(), F.col("changed_time").desc_nulls_last(), "rir")
    return known.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "assigned_to")


def attach_registry_org(objects: DataFrame, orgs: DataFrame, use: bool = False) -> DataFrame:
    """The objects with their registry organisation's name; without ``use`` the name stays null, as the map is built from feeds."""
    if not use:
        return objects.withColumn("registry_name", F.lit(None).cast("string"))
    first = orgs.select(F.try_element_at("org_id", F.lit(1)).alias("oid"), F.try_element_at("org_name", F.lit(1)).alias("registry_name")).where("oid is not null")
    first = first.groupBy("oid").agg(F.min("registry_name").alias("registry_name"))
    keyed = objects.withColumn("oid", F.try_element_at("org_id", F.lit(1)))
    return keyed.join(first, "oid", "left").drop("oid")


def map_organisations(objects: DataFrame, caida: DataFrame, peer_org: DataFrame, peer_net: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(organisations, as_to_org): names by feed, then peering database, then description or AS name.

    Peering rows add other names, notes and web sites; the first row of a key counts.
    """
    named = objects.join(caida.select(F.col("asn").cast("bigint").alias("asn"), normalize_name(F.col("org_name")).alias("feed_name")), "asn", "left")
    nets = enrich(peer_net, peer_org.withColumnsRenamed({"id": "org_id", "name": "peer_name", "website": "org_website"}), "org_id", "peer_name", ["peer_name", "org_website"])
    full = enrich(named, nets.withColumnsRenamed({"name": "net_name", "aka": "net_aka", "notes": "net_notes", "website": "net_website"}), "asn", "net_name",
                  ["peer_name", "net_aka", "net_notes", "net_website", "org_website"])
    described = F.try_element_at("description", F.lit(1))
    fallback = F.coalesce(F.when((F.col("rir") == "apnic") & starts_with_letter(described), described), F.try_element_at("as_name", F.lit(1)))
    name = normalize_name(F.coalesce("feed_name", "registry_name" if "registry_name" in full.columns else F.lit(None), "peer_name", fallback))
    other = F.when(F.col("peer_name") != name, F.col("peer_name"))
    rows = full.withColumn("name", name).where("name <> ''")
    lists = rows.select(
        F.col("name").alias("org_name"), "org_id", F.array_compact(F.array(other, "net_aka")).alias("aka"),
        F.array_compact(F.array("net_notes")).alias("notes"), F.array_compact(F.array("net_website", "org_website")).alias("website"),
    )
    organisations = group_organisations(lists, "org_name", ["org_id", "aka", "notes", "website"])
    return organisations, rows.select("asn", "as_name", F.col("name").alias("org_name"), "rir")


def check_mapping(organisations: DataFrame, as_to_org: DataFrame) -> DataFrame:
    """``problem, value`` of a map that isn't one to one or names unknown organisations; no rows if all is well."""
    many = cardinality_violations(as_to_org, "asn", "org_name").select(F.lit("number of several organisations").alias("problem"), F.col("asn").cast("string").alias("value"))
    lost = violations(organisations, as_to_org, "org_name", "organisations", "numbers")
    return many.unionByName(lost.select(F.concat(F.lit("missing in "), F.col("missing_in")).alias("problem"), F.col("org_name").alias("value")))
