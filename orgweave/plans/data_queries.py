"""Queries and SQL of the general training-data operators (problems 4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.operators import hierarchy, snapshots
from orgweave.session import Scratch
from orgweave.tables import table


def latest_families(spark: SparkSession, folder: str) -> DataFrame:
    """Of the last snapshot each alias_id's row with the latest loaded_at: its two link lists."""
    rows = table(spark, folder, "saint_org_families").select("snap_month", "alias_id", "loaded_at", "parent", "children")
    last = rows.agg(F.max("snap_month")).first()[0]
    return (
        rows.where((F.col("snap_month") == F.lit(last)) & F.col("alias_id").isNotNull())
        .groupBy("alias_id")
        .agg(F.max(F.struct("loaded_at", "parent", "children")).alias("r"))
        .select("alias_id", "r.parent", "r.children")
    )


def _links(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    return scratch.cut(hierarchy.counted_links(latest_families(spark, folder), "alias_id", "parent", "children"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and path of every linked alias group of the last snapshot."""
    scratch = Scratch(spark, "p4")
    resolved = hierarchy.resolve_hierarchy(_links(spark, folder, scratch), scratch)
    return resolved.select(
        F.col("node").alias("alias_id"),
        F.col("root").alias("root_id"),
        F.col("depth").cast("int").alias("depth"),
        F.coalesce(F.array_join(F.col("path").cast("array<string>"), "/"), F.lit("cycle")).alias("path"),
    )


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of an alias group and one of its descendants, with their distance."""
    scratch = Scratch(spark, "p4")
    return hierarchy.descendants(hierarchy.resolve_hierarchy(_links(spark, folder, scratch), scratch))


def p4_loops(spark: SparkSession, folder: str) -> DataFrame:
    """Alias groups whose chain of parents never ends: on the loop or below it."""
    scratch = Scratch(spark, "p4")
    links = _links(spark, folder, scratch)
    return hierarchy.loops(links, hierarchy.resolve_hierarchy(links, scratch), scratch)


def p4_unfollowed(spark: SparkSession, folder: str) -> DataFrame:
    """Counted links that no path follows, since the child names a smaller parent too."""
    return hierarchy.unfollowed_links(_links(spark, folder, Scratch(spark, "p4")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Alias groups added, removed or changed in each monthly snapshot."""
    rows = table(spark, folder, "saint_org_families")
    return snapshots.snapshot_changes(rows, "alias_id", "snap_month", "loaded_at", ["org_family_id", "asn_entries"])


QUERIES = {"p4_found": p4_found, "p4_descendants": p4_descendants, "p4_loops": p4_loops, "p4_unfollowed": p4_unfollowed, "p7_found": p7_found}

_LINKS_SQL = """
with recursive latest as (
    select alias_id, arg_max({'p': parent, 'c': children}, loaded_at) as r
    from saint_org_families
    where snap_month = (select max(snap_month) from saint_org_families)
    group by alias_id),
named as (
    select distinct parent, child from (
        select unnest(r.p) as parent, alias_id as child from latest
        union all select alias_id, unnest(r.c) from latest)),
links as (
    select parent, child from named
    where parent in (select alias_id from latest) and child in (select alias_id from latest)),
nodes as (select parent as alias_id from links union select child from links),
walk as (
    select alias_id, alias_id as root_id, 0 as depth, cast(alias_id as varchar) as path, [alias_id] as ids
    from nodes where alias_id not in (select child from links)
    union all
    select l.child, w.root_id, w.depth + 1, w.path || '/' || cast(l.child as varchar), list_append(w.ids, l.child)
    from walk w join links l on l.parent = w.alias_id)
"""

ORACLE = {
    "p4_found": _LINKS_SQL
    + """
select n.alias_id, coalesce(w.root_id, -1) as root_id, cast(coalesce(w.depth, -1) as integer) as depth,
       coalesce(w.path, 'cycle') as path
from nodes n left join walk w on w.alias_id = n.alias_id""",
    "p4_descendants": _LINKS_SQL
    + """
select ancestor, descendant, distance from (
    select alias_id as descendant, unnest(ids) as ancestor, depth - (generate_subscripts(ids, 1) - 1) as distance from walk)
where distance > 0""",
    "p4_loops": _LINKS_SQL
    + """
, lost as (select alias_id from nodes where alias_id not in (select alias_id from walk)),
up as (
    select l.child as origin, l.parent as above from links l where l.child in (select alias_id from lost)
    union
    select u.origin, l.parent from up u join links l on l.child = u.above)
select alias_id as node, alias_id in (select origin from up where origin = above) as on_loop from lost""",
    "p4_unfollowed": _LINKS_SQL
    + """
, first as (select child, min(parent) as followed from links group by child)
select l.parent, l.child, f.followed from links l join first f using (child) where l.parent <> f.followed""",
    "p7_found": """
with latest as (
    select snap_month, alias_id,
           arg_max({'f': org_family_id, 'e': list_sort(list_distinct(coalesce(asn_entries, [])))}, loaded_at) as r
    from saint_org_families group by snap_month, alias_id),
steps as (
    select snap_month, lag(snap_month) over (order by snap_month) as prev
    from (select distinct snap_month from saint_org_families)),
n as (select s.snap_month, alias_id, r from latest join steps s using (snap_month) where prev is not null),
o as (select s.snap_month, alias_id, r from latest l join steps s on l.snap_month = s.prev)
select snap_month, alias_id,
       case when o.r is null then 'added' when n.r is null then 'removed' else 'changed' end as change_kind
from n full outer join o using (snap_month, alias_id)
where o.r is null or n.r is null or o.r.f is distinct from n.r.f or o.r.e is distinct from n.r.e""",
}
