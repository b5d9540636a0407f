"""Organisations to alias groups and ownership families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.predicates import blocked, reported, score_matches, usable_attribute
from orgweave.functions.text import registrable_domain
from orgweave.functions.wordlists import BRAND_ATTRIBUTES
from orgweave.operators.aggregates import best_cluster, best_parent, group_edges, supported, three_way
from orgweave.operators.graph import clique_cover, connected_components, shared_attribute_families, weak_components
from orgweave.operators.joins import jaccard_pairs, unordered
from orgweave.session import Scratch


def node_attributes(orgs: DataFrame, relations: DataFrame) -> DataFrame:
    """``org_name, attribute``: alias names of each organisation: its answers' aliases, its own name and brand extras."""
    own = orgs.select("org_name", F.lower("org_name").alias("attribute"))
    told = relations.select(F.col("base").alias("org_name"), F.explode("alias_list").alias("a")).select("org_name", F.lower("a").alias("attribute"))
    extra = F.array_compact(F.flatten(F.array(*(F.when(F.lower("org_name").contains(k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in BRAND_ATTRIBUTES.items()))))
    brands = orgs.select("org_name", F.explode(extra).alias("attribute"))
    return own.unionByName(told).unionByName(brands).distinct()


def main_attributes(attributes: DataFrame, scratch: Scratch, threshold: float = 0.5) -> DataFrame:
    """``org_name, attribute, main``: usable attributes in clusters of two or more alike ones; the greatest cluster is main."""
    usable = attributes.where(usable_attribute(F.col("attribute"), F.col("org_name")))
    keyed = usable.select("org_name", "attribute", F.concat_ws("\x1f", "org_name", "attribute").alias("id"))
    pairs = jaccard_pairs(keyed, "id", "attribute", threshold, "org_name")
    comps = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch).withColumnRenamed("node", "id")
    member = keyed.join(comps, "id")
    clusters = member.groupBy("org_name", "component").agg(F.collect_set("attribute").alias("members"))
    best = best_cluster(clusters, "org_name", "members", "org_name").select("org_name", F.col("component").alias("best"))
    return member.join(best, "org_name").select("org_name", "attribute", (F.col("component") == F.col("best")).alias("main"))


def main_alias_groups(orgs: DataFrame, attributes: DataFrame, scratch: Scratch) -> DataFrame:
    """``org_name, alias_id``: organisations that share a main attribute, a web site's domain or another name."""
    marked = main_attributes(attributes, scratch).where("main").select("org_name", "attribute")
    sites = orgs.select("org_name", F.explode("website").alias("w")).select("org_name", registrable_domain(F.col("w")).alias("attribute"))
    other = orgs.select("org_name", F.explode("aka").alias("a")).select("org_name", F.lower("a").alias("attribute"))
    names = other.unionByName(orgs.select("org_name", F.lower("org_name").alias("attribute")))
    keys = marked.unionByName(sites).unionByName(names).where("trim(attribute) <> ''")
    found = shared_attribute_families(keys, "org_name", "attribute", scratch)
    return found.select(F.col("node").alias("org_name"), F.col("component").alias("alias_id"))


def secondary_alias_groups(groups: DataFrame, attributes: DataFrame, scratch: Scratch, ratio: float = 0.75) -> DataFrame:
    """``alias_id, merged_id``: alias groups that share a secondary attribute which most of their members have."""
    rest = main_attributes(attributes, scratch).where("not main").select("org_name", "attribute")
    votes = supported(groups.join(rest, "org_name", "left"), "alias_id", "org_name", "attribute", ratio)
    keyed = groups.select("alias_id").distinct().join(votes.select("alias_id", "attribute"), "alias_id", "left")
    found = shared_attribute_families(keyed, "alias_id", "attribute", scratch)
    return found.select(F.col("node").alias("alias_id"), F.col("component").alias("merged_id"))


def ownership_votes(groups: DataFrame, aliases: DataFrame, parents: DataFrame, ratio: float = 0.5) -> DataFrame:
    """``child, parent``: per alias group the other group whose aliases most of its parent names hit (ties: smallest)."""
    wanted = supported(groups.join(parents, "org_name", "left"), "alias_id", "org_name", "attribute", ratio).select(F.col("alias_id").alias("child"), "attribute")
    have = groups.join(aliases, "org_name").select(F.col("alias_id").alias("parent"), "attribute").distinct()
    counts = wanted.join(have, "attribute").where("child <> parent").groupBy("child", "parent").agg(F.count("*").alias("n"))
    best = counts.groupBy("child").agg(F.min(F.struct((-F.col("n")).alias("m"), "parent")).alias("b"))
    return best.select("child", F.col("b.parent").alias("parent"))


def recluster_aliases(orgs: DataFrame, judged: DataFrame, scratch: Scratch) -> DataFrame:
    """``org_name, alias_id``: disjoint cliques over matching judgements; organisations in no clique stay alone.

    The latest judgement of a pair counts; blocked and reported pairs never match.
    """
    a, b = F.col("org_a_name"), F.col("org_b_name")
    hit = score_matches(F.trim("score")) & ~blocked(a, b) & ~reported(a, b)
    last = judged.select(*unordered("org_a_name", "org_b_name"), "judged_at", "judge_id", hit.alias("hit")).where("org_a_name <> org_b_name")
    last = last.groupBy("org_a_name", "org_b_name").agg(F.max(F.struct("judged_at", "judge_id", "hit")).alias("l")).where("l.hit")
    cliques = clique_cover(last.select(F.col("org_a_name").alias("src"), F.col("org_b_name").alias("dst")), scratch)
    named = orgs.select("org_name").distinct().join(cliques.withColumnRenamed("node", "org_name"), "org_name", "left")
    return named.select("org_name", F.coalesce("clique", "org_name").alias("alias_id"))


def recluster_parents(groups: DataFrame, judged: DataFrame, scratch: Scratch, vote_before_pruning: bool = True) -> DataFrame:
    """``alias_id, family_id, parents``: families of alias groups linked by ownership judgements ``a, b, a_over_b, b_over_a, none``."""
    side = three_way(F.col("a_over_b"), F.col("b_over_a"), F.col("none"), need_positive=True)
    score = F.greatest("a_over_b", "b_over_a")
    links = judged.select(F.when(side == "A", F.col("b")).when(side == "B", F.col("a")).alias("child"), F.when(side == "A", F.col("a")).when(side == "B", F.col("b")).alias("parent"), score.alias("score")).where("child is not null")
    if not vote_before_pruning:
        links = best_parent(links, "child", "parent", "score")
    members = groups.select(F.col("org_name").alias("member"), F.col("alias_id").alias("group"))
    edges = group_edges(links, members, 0.5)
    comps = weak_components(edges.select(F.col("parent_group").alias("src"), F.col("child_group").alias("dst")), scratch)
    all_ = groups.select("alias_id").distinct().join(comps.withColumnRenamed("node", "alias_id"), "alias_id", "left")
    return all_.select("alias_id", F.coalesce("component", "alias_id").alias("family_id"), "parents")
