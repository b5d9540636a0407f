"""Joins that the optimizer has no plan of its own for, each rewritten to equi-joins."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions.text import jaccard, tokens


def interval_join(points: DataFrame, point: str, blocks: DataFrame, low: str, high: str, bin_size: int = 1 << 16) -> DataFrame:
    """Rows of ``points`` beside every block with low <= point <= high.

    Short blocks are listed under each bin they touch and joined on the bin.
    Blocks over more than 64 bins go to coarser bins, 16 times as wide for each
    level, so no block is listed more than 65 times.  Null points and ends match nothing.
    """
    span = F.greatest(F.col(high) - F.col(low), F.lit(1)).cast("double") / bin_size
    level = F.greatest(F.lit(0), F.ceil(F.log(span / 64) / F.log(F.lit(16.0)))).cast("int")
    width = lambda lv: (F.lit(bin_size) * F.pow(F.lit(16), lv)).cast("bigint")
    leveled = blocks.where(F.col(low) <= F.col(high)).withColumn("_lv", level)
    listed = leveled.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width(F.col("_lv"))), F.floor(F.col(high) / width(F.col("_lv"))))))
    levels = sorted(r["_lv"] for r in leveled.select("_lv").distinct().collect())  # at most 12 for 64-bit ends
    keyed = points.withColumn("_lv", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    keyed = keyed.withColumn("_bin", F.floor(F.col(point) / width(F.col("_lv"))))
    return keyed.join(listed, ["_lv", "_bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_lv", "_bin")


def latest_block(points: DataFrame, key: str, point: str, blocks: DataFrame, low: str, high: str, when: str, bin_size: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each point with its containing block of the latest ``when`` (ties: greatest low, then high, then ``ties``); points in no block are left out."""
    found = interval_join(points, point, blocks, low, high, bin_size)
    order = Window.partitionBy(key).orderBy(F.col(when).desc_nulls_last(), F.col(low).desc(), F.col(high).desc(), *(F.col(c).desc_nulls_last() for c in ties))
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def jaccard_pairs(df: DataFrame, id_: str, text: str, threshold: float = 0.5, group: str | None = None, link_empty: bool = True) -> DataFrame:
    """``a, b, similarity`` (a < b) of distinct rows whose token sets are alike, within ``group`` if given.

    Prefix filter: a set of n tokens can only reach the threshold if one of its
    n - ceil(t n) + 1 rarest tokens is shared, so only those are joined on and
    frequent tokens hardly ever are.  Two sets without tokens are alike by
    definition; each is linked to the smallest such id of its group only
    (``link_empty``), which keeps their component whole without all pairs.
    """
    g = F.col(group) if group else F.lit(0)
    sets = df.select(F.col(id_).alias("id"), g.alias("g"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks")).distinct()
    flat = sets.select("id", "g", F.explode("toks").alias("tok"))
    freq = flat.groupBy("tok").agg(F.count("*").alias("df"))
    ranked = flat.join(freq, "tok").groupBy("id", "g").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
    n = F.size("o")
    prefix = ranked.select("id", "g", n.alias("n"), F.explode(F.slice("o", F.lit(1), n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1)).alias("p"))
    # Sizes that are alike share one of two neighbouring bands, so a set meets only those of its own size or so; each pair is looked up once.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold)) + 1e-9) if threshold < 1 else F.col("n")
    left = prefix.select(F.col("id").alias("a"), "g", F.col("n").alias("na"), F.col("p.tok").alias("tok"), band.alias("band"))
    near_bands = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    right = prefix.select(F.col("id").alias("b"), "g", F.col("n").alias("nb"), F.col("p.tok").alias("tok"), band.alias("own"), near_bands.alias("step"))
    right = right.select("b", "g", "nb", "tok", (F.col("own") + F.col("step")).alias("band"))
    near = (F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    pairs = left.join(right, ["tok", "g", "band"]).where(near).select("a", "b").distinct()
    held = sets.groupBy("id").agg(F.first("toks").alias("toks")) if group is None else sets.select("id", "toks").distinct()
    whole = pairs.join(held.withColumnsRenamed({"id": "a", "toks": "ta"}), "a").join(held.withColumnsRenamed({"id": "b", "toks": "tb"}), "b")
    scored = whole.withColumn("similarity", jaccard(F.col("ta"), F.col("tb"))).where(F.col("similarity") >= threshold)
    out = scored.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    if not link_empty:
        return out
    none = sets.where(F.size("toks") == 0)
    first = none.groupBy("g").agg(F.min("id").alias("a"))
    return out.unionByName(none.join(first, "g").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def nearest_vectors(queries: DataFrame, rows: DataFrame, id_: str, vector: str, k: int = 10, metric: str = "l2", cell_rows: int = 4000) -> DataFrame:
    """``query, neighbour, score, rank``: exact k nearest of ``rows`` for each query, itself left out.

    Queries and rows are dealt into blocks; each cell of the grid multiplies two
    bounded matrices and keeps k per query, and the cells' results are merged.
    ``metric``: squared "l2" (ascending) or "cosine" (descending); ties by id.
    Null vectors and vectors of another length than most of a cell are left out.
    """
    nq = max(1, -(-queries.count() // cell_rows))
    nr = max(1, -(-rows.count() // cell_rows))
    deal = lambda df, name, mine, other, n_mine, n_other: df.where(F.col(vector).isNotNull()).select(
        F.col(id_).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"),
        F.pmod(F.xxhash64(id_), F.lit(n_mine)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
    )
    q = deal(queries, "query", "qb", "rb", nq, nr)
    r = deal(rows, "neighbour", "rb", "qb", nr, nq)
    sign = 1.0 if metric == "l2" else -1.0

    def cell(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "score": []}).astype({"query": "int64", "neighbour": "int64"})
        size = left["v"].map(len).mode()[0]
        left, right = left[left["v"].map(len) == size], right[right["v"].map(len) == size]
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        if metric == "l2":
            score = np.stack([((row - b) ** 2).sum(axis=1) for row in a])
        else:
            norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            score = (a @ b.T) / np.where(norm == 0, 1, norm)
        qi, ri = left["query"].to_numpy(), right["neighbour"].to_numpy()
        out = []
        for row, me in zip(score, qi):
            order = np.lexsort((ri, sign * row))
            order = order[ri[order] != me][:k]
            out.append(pd.DataFrame({"query": me, "neighbour": ri[order], "score": row[order]}))
        return pd.concat(out)

    cells = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(cell, "query long, neighbour long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score") * sign, "neighbour")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_pairs_lsh(df: DataFrame, id_: str, vector: str, threshold: float, bucket: float = 1.0, tables: int = 16, seed: int = 7) -> DataFrame:
    """``a, b, distance`` of vectors within a Euclidean distance, found by random projections and rechecked exactly.

    For self joins beyond what blocks can do; recall is below 1 and must be measured.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    vectors = df.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(vectors)
    found = model.approxSimilarityJoin(vectors, vectors, threshold, "distance")
    return found.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), "distance").where("a < b")


def lookup_mentions(postings: DataFrame, wanted: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Of each wanted key its first k postings by ``order`` (a top-k report)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return postings.join(wanted.select(key).distinct(), key, "left_semi").withColumn("rank", rank).where(F.col("rank") <= k)


def merge_context(target: DataFrame, base: DataFrame, pair: list[str], content: str, order: str, k: int = 10) -> DataFrame:
    """Per pair at most k distinct snippets: those of the target first, then those of the base."""
    both = target.select(*pair, content, order, F.lit(0).alias("side")).unionByName(base.select(*pair, content, order, F.lit(1).alias("side")))
    first = both.groupBy(*pair, content).agg(F.min(F.struct("side", order)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy("_first", content))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select(*pair, content, "_first.side", "rank")


def unordered(a: str, b: str) -> list:
    """Columns of a pair whose order doesn't matter."""
    return [F.least(a, b).alias(a), F.greatest(a, b).alias(b)]


def resume_pairs(wanted: DataFrame, done: DataFrame, a: str, b: str) -> DataFrame:
    """Wanted pairs of which no judgement exists in either order."""
    return wanted.select(*unordered(a, b)).distinct().join(done.select(*unordered(a, b)).distinct(), [a, b], "left_anti")


def pairs_within(df: DataFrame, id_: str, group: str) -> DataFrame:
    """All pairs a < b of members of one group; the result has as many rows as it says."""
    a = df.select(F.col(group), F.col(id_).alias("a")).distinct()
    return a.join(a.withColumnRenamed("a", "b"), group).where("a < b").select(group, "a", "b")


def pairs_across(members: DataFrame, id_: str, group: str, edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct ordered pairs (parent member, child member) over linked groups."""
    p = members.select(F.col(group).alias(parent), F.col(id_).alias("parent_member"))
    c = members.select(F.col(group).alias(child), F.col(id_).alias("child_member"))
    return edges.join(p, parent).join(c, child).where("parent_member <> child_member").select("parent_member", "child_member").distinct()


def enrich(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left join on the first row of each key by ``order``."""
    first = right.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in columns))
    return left.join(first, key, "left")


def violations(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """``key, missing_in`` of keys that one side has and the other lacks."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    missing = F.when(F.col("_b").isNull(), right_name).when(F.col("_a").isNull(), left_name)
    return a.join(b, key, "full_outer").withColumn("missing_in", missing).where("missing_in is not null").select(key, "missing_in")


def covered(ours: DataFrame, theirs: DataFrame, cluster: str, member: str) -> DataFrame:
    """``ours, theirs`` cluster ids where every member of theirs is in ours, by counting shared members."""
    a = ours.select(F.col(cluster).alias("ours"), member)
    b = theirs.select(F.col(cluster).alias("theirs"), member)
    size = b.groupBy("theirs").agg(F.count("*").alias("n"))
    shared = a.join(b, member).groupBy("ours", "theirs").agg(F.count("*").alias("m"))
    return shared.join(size, "theirs").where("m = n").select("ours", "theirs", "n")


