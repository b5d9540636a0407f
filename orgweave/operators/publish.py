"""Final tables and their validators; every validator returns violations, none prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.operators.aggregates import duplicates
from orgweave.operators.graph import loop_nodes
from orgweave.operators.joins import violations
from orgweave.operators.snapshots import union_all
from orgweave.session import Scratch


def check_tables(as_table: DataFrame, alias: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``problem, value``: repeated keys, unknown alias groups, one-sided families and ownership loops."""
    text = lambda c: F.col(c).cast("string").alias("value")
    out = [
        duplicates(as_table, "asn").select(F.lit("number repeated").alias("problem"), text("asn")),
        duplicates(alias, "alias_id").select(F.lit("alias group repeated").alias("problem"), text("alias_id")),
        violations(as_table, alias, "alias_id", "as_table", "org_alias_table").select(F.concat(F.lit("alias group missing in "), F.col("missing_in")).alias("problem"), text("alias_id")),
    ]
    ends = links.select(F.explode(F.array("child_alias_id", "parent_alias_id")).alias("alias_id")).distinct()
    out.append(ends.join(alias, "alias_id", "left_anti").select(F.lit("link to unknown alias group").alias("problem"), text("alias_id")))
    edges = links.select(F.col("parent_alias_id").alias("src"), F.col("child_alias_id").alias("dst"))
    out.append(loop_nodes(edges, scratch).select(F.lit("on an ownership loop").alias("problem"), text("node")))
    family = alias.select("alias_id", "org_family_id")
    both = links.join(family.withColumnsRenamed({"alias_id": "child_alias_id", "org_family_id": "cf"}), "child_alias_id").join(family.withColumnsRenamed({"alias_id": "parent_alias_id", "org_family_id": "pf"}), "parent_alias_id")
    out.append(both.where("cf <> pf").select(F.lit("link across families").alias("problem"), text("child_alias_id")))
    return union_all(out)


def check_links(families: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``problem, value`` (and the columns ``by`` within which links are compared): links that only one end names; null ends are no links."""
    up = families.select(*by, F.explode("parent").alias("p"), F.col("alias_id").alias("c")).where("p is not null").distinct()
    down = families.select(*by, F.col("alias_id").alias("p"), F.explode("children").alias("c")).where("c is not null").distinct()
    keys = [*by, "p", "c"]
    value = F.concat_ws(">", "p", "c").alias("value")
    one = up.join(down, keys, "left_anti").select(*by, F.lit("parent doesn't name child").alias("problem"), value)
    return one.unionByName(down.join(up, keys, "left_anti").select(*by, F.lit("child doesn't name parent").alias("problem"), value))


def require_none(found: DataFrame) -> None:
    """Strict mode: raises with the first violations."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("; ".join(f"{r.problem}: {r.value}" for r in rows))
