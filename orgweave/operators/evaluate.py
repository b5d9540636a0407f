"""Evaluation: partitions against each other, recall, stability, classification quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.operators.joins import covered


def signatures(members: DataFrame, cluster: str, member: str) -> DataFrame:
    """``cluster, sig, n``: a hash of each cluster's member set that doesn't depend on order, and its size.

    Two sums of independent hashes and the size: nothing is gathered, so a cluster may be of any size.
    """
    flat = members.select(F.col(cluster).alias("cluster"), F.col(member).alias("m")).distinct()
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "m").cast("decimal(20,0)")).cast("string")
    return flat.groupBy("cluster").agg(F.concat_ws("/", part(1), part(2), F.count("*").cast("string")).alias("sig"), F.count("*").alias("n"))


def beside(rows: list[DataFrame]) -> DataFrame:
    """Frames of one row each, side by side."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def compare_partitions(ours: DataFrame, theirs: DataFrame, cluster: str, member: str) -> DataFrame:
    """One row of counts over the members that both partitions have.

    clusters and multi-member clusters of either, identical multi-member
    clusters, clusters of theirs that a larger one of ours covers (multi, single,
    their members), the other way round, and the mean sizes.
    """
    common = ours.select(member).intersect(theirs.select(member))
    a = ours.select(cluster, member).distinct().join(common, member, "left_semi")
    b = theirs.select(cluster, member).distinct().join(common, member, "left_semi")
    sa, sb = signatures(a, cluster, member), signatures(b, cluster, member)
    sizes = lambda s, p: s.agg(F.count("*").alias(f"{p}_clusters"), F.sum((F.col("n") > 1).cast("long")).alias(f"{p}_multi"), F.round(F.avg("n"), 6).alias(f"{p}_mean"))
    same = sa.join(sb.select("sig"), "sig", "left_semi").agg(F.sum((F.col("n") > 1).cast("long")).alias("identical_multi"))

    def cover(x: DataFrame, y: DataFrame, sx: DataFrame, name: str) -> DataFrame:
        larger = covered(x, y, cluster, member).join(sx.select(F.col("cluster").alias("ours"), F.col("n").alias("size")), "ours").where("size > n")
        return larger.agg(
            F.count_distinct("ours").alias(f"{name}_covering"), F.sum((F.col("n") > 1).cast("long")).alias(f"{name}_multi_covered"),
            F.sum((F.col("n") == 1).cast("long")).alias(f"{name}_single_covered"), F.sum("n").alias(f"{name}_members_covered"),
        )

    rows = [common.agg(F.count("*").alias("common")), sizes(sa, "our"), sizes(sb, "their"), same, cover(a, b, sa, "our"), cover(b, a, sb, "their")]
    out = beside(rows)
    return out.select(*(F.coalesce(c, F.lit(0)).alias(c) if "mean" not in c else F.col(c) for c in out.columns))


def best_cluster_recall(truth: DataFrame, clusters: DataFrame, org: str, cluster: str, member: str) -> DataFrame:
    """``org, truth_size, best_cluster, overlap, recall``: per true organisation the cluster with most of its members (ties: smallest)."""
    size = truth.select(org, member).distinct().groupBy(org).agg(F.count("*").alias("truth_size"))
    shared = truth.select(org, member).distinct().join(clusters.select(cluster, member).distinct(), member).groupBy(org, cluster).agg(F.count("*").alias("m"))
    best = shared.groupBy(org).agg(F.min(F.struct((-F.col("m")).alias("neg"), F.col(cluster).alias("c"))).alias("b"))
    joined = size.join(best, org, "left")
    overlap = F.coalesce(-F.col("b.neg"), F.lit(0))
    return joined.select(org, "truth_size", F.col("b.c").alias("best_cluster"), overlap.alias("overlap"), F.round(overlap / F.col("truth_size"), 6).alias("recall"))


def recall_summary(per_org: DataFrame) -> DataFrame:
    """``macro, micro``: mean of the recalls, and found members over all true members."""
    return per_org.agg(F.round(F.avg("recall"), 6).alias("macro"), F.round(F.sum("overlap") / F.sum("truth_size"), 6).alias("micro"))


def stability(before: DataFrame, after: DataFrame, cluster: str, member: str) -> DataFrame:
    """One row: families of either snapshot over common members, identical ones, Jaccard of the sets of families, changed members."""
    common = before.select(member).intersect(after.select(member))
    a = before.select(cluster, member).distinct().join(common, member, "left_semi")
    b = after.select(cluster, member).distinct().join(common, member, "left_semi")
    sa, sb = signatures(a, cluster, member), signatures(b, cluster, member)
    ia, ib = sa.select("sig").distinct(), sb.select("sig").distinct()
    same = ia.intersect(ib)
    changed = a.join(sa.select(F.col("cluster").alias(cluster), "sig"), cluster).join(same, "sig", "left_anti").agg(F.count_distinct(member).alias("changed_members"))
    counts = [common.agg(F.count("*").alias("common")), ia.agg(F.count("*").alias("families_a")), ib.agg(F.count("*").alias("families_b")), same.agg(F.count("*").alias("identical")), changed]
    out = beside(counts)
    union = F.col("families_a") + F.col("families_b") - F.col("identical")
    return out.withColumn("jaccard", F.round(F.col("identical") / F.nullif(union, F.lit(0)), 6))


def confusion(pairs: DataFrame, gold: str, predicted: str, latency: str | None = None, concurrency: int = 1) -> DataFrame:
    """One row of precision, recall, F1, accuracy (percent) over valid predictions, failures and throughput.

    ``gold`` and ``predicted`` are booleans; a null prediction failed and is left out of the four.
    """
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g, p = F.col(gold), F.col(predicted)
    n = pairs.agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"), count(~g & ~p).alias("tn"), count(p.isNull()).alias("failed"),
                  F.count("*").alias("total"), (F.avg(latency) if latency else F.lit(None).cast("double")).alias("mean_latency"))
    pct = lambda a, b: F.round(100 * a / F.nullif(b, F.lit(0)), 2)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select(
        "tp", "fp", "fn", "tn", pct(tp, tp + fp).alias("precision"), pct(tp, tp + fn).alias("recall"), pct(2 * tp, 2 * tp + fp + fn).alias("f1"),
        pct(tp + tn, tp + fp + fn + tn).alias("accuracy"), pct(F.col("failed"), F.col("total")).alias("failure_rate"), F.round("mean_latency", 4).alias("mean_latency"),
        F.round(F.lit(concurrency) / F.nullif(F.col("mean_latency"), F.lit(0.0)), 4).alias("pairs_per_second"),
    )
