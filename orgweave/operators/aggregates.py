"""Grouped aggregates and votes of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_set(c: Column) -> Column:
    """Aggregate: sorted distinct values of an array or scalar column, blanks dropped."""
    return F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c))))


def group_organisations(rows: DataFrame, name: str, lists: list[str]) -> DataFrame:
    """One row per organisation name: per list column its distinct values that aren't blank.

    Values are exploded and deduplicated before they are gathered, so repeats of
    a hot name are combined map-side; the gathered lists are the distinct values.
    """
    named = rows.where(F.col(name).isNotNull())
    out = named.select(name).distinct()
    for c in lists:
        flat = named.select(name, F.explode(c).alias("_v")).select(name, F.trim("_v").alias("_v")).where("_v <> ''").distinct()
        out = out.join(flat.groupBy(name).agg(F.array_sort(F.collect_list("_v")).alias(c)), name, "left")
    return out.select(name, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists))


def cardinality_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n``: keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def supported(df: DataFrame, group: str, member: str, keyword: str, ratio: float) -> DataFrame:
    """``group, keyword, supporters, members``: keywords that at least ``ratio`` of a group's members have."""
    size = df.groupBy(group).agg(F.count_distinct(member).alias("members"))
    votes = df.where(F.col(keyword).isNotNull()).groupBy(group, keyword).agg(F.count_distinct(member).alias("supporters"))
    return votes.join(size, group).where(F.col("supporters") >= ratio * F.col("members"))


def best_cluster(df: DataFrame, owner: str, cluster: str, name: str, prefer_name: bool = True) -> DataFrame:
    """Per owner its greatest cluster (array): ties by holding the owner's name, then the smallest; or simply the greatest sorted one."""
    members = F.array_sort(F.col(cluster))
    ranked = df.withColumn("_m", members)
    if prefer_name:
        order = [F.size("_m").desc(), F.array_contains("_m", F.lower(F.col(name))).desc(), F.col("_m").asc()]
    else:
        order = [F.size("_m").desc(), F.col("_m").desc()]
    return ranked.withColumn("_k", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where("_k = 1").drop("_k", "_m")


def top_vote(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """``key, choice, n``: the most frequent choice of each key, ties to the smallest."""
    counts = votes.groupBy(key, choice).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(choice).alias("c"))).alias("s")).select(
        key, F.col("s.c").alias(choice), (-F.col("s.m")).alias("n")
    )


def best_parent(scored: DataFrame, child: str, parent: str, score: str) -> DataFrame:
    """Per child the parent of the best score, ties to the smallest; null scores lose."""
    best = F.min(F.struct((-F.coalesce(F.col(score), F.lit(float("-inf")))).alias("m"), F.col(parent).alias("p"), F.col(score).alias("s")))
    return scored.groupBy(child).agg(best.alias("b")).select(child, F.col("b.p").alias(parent), F.col("b.s").alias(score))


def three_way(a: Column, b: Column, none: Column, need_positive: bool = False) -> Column:
    """``A``, ``B`` or ``none``: ties favour A, then B; with ``need_positive`` all-zero scores give none."""
    top = F.greatest(a, b, none)
    choice = F.when(a == top, "A").when(b == top, "B").otherwise("none")
    return F.when(top <= 0, "none").otherwise(choice) if need_positive else choice


def group_edges(links: DataFrame, members: DataFrame, ratio: float = 0.5, vote_ratio: float | None = None) -> DataFrame:
    """``parent_group, child_group``: enough children of one group have enough parents in the other.

    ``links(child, parent)``, ``members(member, group)``.  A child counts if its
    parents cover at least ``ratio`` of the parent group, and the group if at
    least ``vote_ratio`` (as ``ratio`` if not given) of its members count.  With one best parent per child a
    parent group of three or more is never covered; pass links before pruning.
    """
    size = members.groupBy("group").agg(F.count("*").alias("n"))
    c = members.select(F.col("member").alias("child"), F.col("group").alias("child_group"))
    p = members.select(F.col("member").alias("parent"), F.col("group").alias("parent_group"))
    each = links.select("child", "parent").distinct().join(c, "child").join(p, "parent").where("child_group <> parent_group")
    cover = each.groupBy("child_group", "parent_group", "child").agg(F.count("*").alias("m"))
    pn = size.select(F.col("group").alias("parent_group"), F.col("n").alias("pn"))
    enough = cover.join(pn, "parent_group").where(F.col("m") >= ratio * F.col("pn"))
    votes = enough.groupBy("child_group", "parent_group").agg(F.count("*").alias("k"))
    cn = size.select(F.col("group").alias("child_group"), F.col("n").alias("cn"))
    return votes.join(cn, "child_group").where(F.col("k") >= (ratio if vote_ratio is None else vote_ratio) * F.col("cn")).select("parent_group", "child_group")


def cluster_loss(weights: DataFrame, members: DataFrame) -> DataFrame:
    """``inside, across, loss``: 1 - w over pairs in one cluster plus w over pairs across; ``weights(a, b, w)``, ``members(member, cluster)``."""
    a = members.select(F.col("member").alias("a"), F.col("cluster").alias("ca"))
    b = members.select(F.col("member").alias("b"), F.col("cluster").alias("cb"))
    both = weights.join(a, "a").join(b, "b")
    same = F.col("ca") == F.col("cb")
    inside, across = F.sum(F.when(same, 1 - F.col("w")).otherwise(0.0)), F.sum(F.when(~same, F.col("w")).otherwise(0.0))
    return both.agg(F.coalesce(inside, F.lit(0.0)).alias("inside"), F.coalesce(across, F.lit(0.0)).alias("across")).withColumn("loss", F.col("inside") + F.col("across"))


def one_group_each(members: DataFrame, member: str, group: str) -> DataFrame:
    """Every member in the largest of its groups (sizes as given), ties to the smallest group."""
    size = members.select(member, group).distinct().groupBy(group).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col(group).alias("g")))
    return members.select(member, group).distinct().join(size, group).groupBy(member).agg(best.alias("b")).select(member, F.col("b.g").alias(group))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def contiguous_split(df: DataFrame, order: str, parts: int = 2) -> DataFrame:
    """Rows dealt into contiguous parts of equal size by ``order``: range-partitioned, counted, never sorted in one task."""
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    running, all_ = F.sum("_n").over(Window.orderBy("_p")), F.sum("_n").over(Window.partitionBy(F.lit(1)))
    offsets = counts.select("_p", (running - F.col("_n")).alias("_before"), all_.alias("_total"))  # a row per partition
    at = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_before")
    placed = ranged.join(F.broadcast(offsets), "_p").withColumn("_at", at)
    chunk = F.ceil(F.col("_total") / parts)
    return placed.withColumn("part", F.floor(F.col("_at") / chunk).cast("int")).drop("_p", "_before", "_at", "_total")


def keyword_counts(rows: DataFrame, keyword: str) -> DataFrame:
    """``keyword, n``: how many rows hold each keyword; nulls and blanks don't count."""
    return rows.where(F.trim(keyword) != "").groupBy(keyword).agg(F.count("*").alias("n"))


def missing_names(named: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """``key``: names that should have a file (a row of ``held``) and have none, each once; what a recovery writes again."""
    return named.select(key).where(F.col(key).isNotNull()).distinct().join(held.select(key).distinct(), key, "left_anti")


def without_generic_names(groups: DataFrame, group: str, name: str, most: int = 1) -> DataFrame:
    """The rows of ``groups`` without names that stand in more than ``most`` groups: those don't tell one group from another."""
    wide = groups.groupBy(name).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") > most).select(name)
    return groups.join(wide, name, "left_anti")
