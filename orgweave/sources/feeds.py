"""Reference feeds, baselines, snapshots and folders of files, all through Spark's own readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.text import normalize_name
from orgweave.operators.graph import connected_components
from orgweave.session import Scratch

CAIDA = "type string, asn string, organizationId string, name string"
PEERING = "org struct<data: array<struct<id: bigint, name: string, website: string>>>, net struct<data: array<struct<asn: bigint, name: string, org_id: bigint, notes: string, aka: string, website: string>>>"


def caida_names(spark: SparkSession, path: str) -> DataFrame:
    """``asn, org_name`` of a JSON-lines feed of two record types; the last line of an id counts.

    Deleted ids (``@del``), names with a plus-minus sign in front and lines that don't parse are left out.
    """
    lines = spark.read.schema(CAIDA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = lines.where("_corrupt_record is null")
    rows = rows.withColumn("at", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))  # the place in the files
    orgs = rows.where("type = 'Organization'").where(~F.col("organizationId").startswith("@del") & ~F.col("name").startswith("±"))
    last_org = orgs.groupBy("organizationId").agg(F.max_by("name", "at").alias("org_name"))
    last_asn = rows.where("type = 'ASN'").groupBy("asn").agg(F.max_by("organizationId", "at").alias("organizationId"))
    return last_asn.join(last_org, "organizationId").select("asn", "org_name")


def peering_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(organisations, networks) of a peering database dump; names are normalised."""
    dump = spark.read.schema(PEERING).option("multiLine", True).json(path)
    org = dump.select(F.explode("org.data").alias("o")).select("o.id", normalize_name(F.col("o.name")).alias("name"), "o.website")
    net = dump.select(F.explode("net.data").alias("n")).select("n.asn", normalize_name(F.col("n.name")).alias("name"), "n.org_id", "n.notes", "n.aka", "n.website")
    return org, net


def folder_texts(spark: SparkSession, path: str) -> DataFrame:
    """``org, file, text`` of a folder with one folder per organisation."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("p"), F.col("value").alias("text"))
    parts = F.split("p", "/")
    return rows.select(F.element_at(parts, -2).alias("org"), F.element_at(parts, -1).alias("file"), "text")


def aligned_lines(spark: SparkSession, texts: str, metas: str) -> DataFrame:
    """``text, mentions`` of two files, or two folders of files of the same stem, read side by side by line number; lines with an empty side are left out."""
    def numbered(path: str, name: str) -> DataFrame:
        stem = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1)
        whole = spark.read.text(path, wholetext=True).select(stem.alias("stem"), F.split("value", "\n").alias("l"))
        numbered_ = whole.select("stem", F.posexplode("l").alias("at", name))
        return numbered_ if many else numbered_.drop("stem")

    many = spark.read.format("binaryFile").load(texts).select("path").limit(2).count() > 1
    both = numbered(texts, "text").join(numbered(metas, "meta"), ["stem", "at"] if many else ["at"]).where("trim(text) <> '' and trim(meta) <> ''")
    return both.select("text", F.filter(F.transform(F.split("meta", r"\|"), F.trim), lambda x: x != "").alias("mentions"))


def judgements(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All judgement files of a folder; unreadable ones are left out."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def snapshot_members(families: DataFrame) -> DataFrame:
    """``cluster, asn`` of family rows with nested entries."""
    return families.select(F.col("org_family_id").alias("cluster"), F.explode("asn_entries.asn").alias("asn")).where("asn is not null").distinct()


def baseline_registry(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, asn`` of a JSON-lines registry baseline: one cluster per organisation id."""
    rows = spark.read.schema(CAIDA).json(path).where("type = 'ASN'")
    return rows.select(F.col("organizationId").alias("cluster"), F.col("asn").cast("bigint").alias("asn")).distinct()


def baseline_lists(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, asn`` of a JSON array of arrays of numbers."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<bigint>>").alias("v"))
    return rows.select(F.posexplode("v").alias("cluster", "l")).select(F.col("cluster").cast("string").alias("cluster"), F.explode("l").alias("asn")).distinct()


def baseline_groups(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, asn`` of a JSON array of {asn, group_id}."""
    return spark.read.schema("asn bigint, group_id string").option("multiLine", True).json(path).select(F.col("group_id").alias("cluster"), "asn").distinct()


def baseline_siblings(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """``cluster, asn`` of {data: {asn: {"Sibling ASNs": [asn]}}}: components of the sibling links."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.data"), "map<string, struct<`Sibling ASNs`: array<bigint>>>").alias("m"))
    pairs = rows.select(F.explode("m").alias("a", "s")).select(F.col("a").cast("bigint").alias("src"), F.explode(F.concat(F.col("s.`Sibling ASNs`"), F.array(F.col("a").cast("bigint")))).alias("dst"))
    return connected_components(pairs, scratch).select(F.col("component").cast("string").alias("cluster"), F.col("node").alias("asn"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``org, asn`` of {org: [asn]} or {org: {asns: [asn]}}."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("org", "v"))
    listed = F.coalesce(F.from_json("v", "array<bigint>"), F.from_json(F.get_json_object("v", "$.asns"), "array<bigint>"))
    return rows.select("org", F.explode(listed).alias("asn")).distinct()


#: Queries that are made for an organisation, each with a suffix.
SEARCH_SUFFIXES = ["", " Wikipedia", " subsidiaries", " parent company"]


def search_results(queries: DataFrame, provider: Callable[[str, int], list[str]], attempts: int = 2) -> DataFrame:
    """``query, urls``: a provider asked once a query (again on failure); encyclopedia queries take one hit, which must be on it."""

    def ask(query: str) -> list[str]:
        wiki = "Wikipedia" in query
        for attempt in range(attempts):
            try:
                hits = list(provider(query, 1 if wiki else 4))
                return [] if wiki and hits and "wikipedia.org" not in hits[0] else hits
            except Exception:  # noqa: BLE001 - a provider may fail in any way
                if attempt + 1 == attempts:
                    return []
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query": b["query"], "urls": [ask(q) for q in b["query"]]})

    return queries.select("query").distinct().mapInPandas(run, "query string, urls array<string>")


def fetched_pages(urls: DataFrame, fetch: Callable[[str], str | None], attempts: int = 2) -> DataFrame:
    """``url, html`` by a fetcher that the caller supplies; offline a table of pages stands in for this source."""

    def get(url: str) -> str | None:
        for _ in range(attempts):
            try:
                page = fetch(url)
                if page:
                    return page
            except Exception:  # noqa: BLE001, S112 - tried again
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "html": [get(u) for u in b["url"]]})

    return urls.select("url").distinct().mapInPandas(run, "url string, html string")


def month_of(date: F.Column) -> F.Column:
    """Month bucket of a run date."""
    return F.date_format(F.trunc(date, "MM"), "yyyy-MM")
