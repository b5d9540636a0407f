"""Parent-child links to full hierarchies: path, depth, root, descendants, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.operators.snapshots import union_all
from orgweave.session import Scratch

STRIPS_PER_CUT = 4


def counted_links(nodes: DataFrame, node: str, parents: str, children: str) -> DataFrame:
    """Distinct links (parent, child) named by either end, both ends being nodes.

    Null lists, null elements and repeats are harmless; a link to oneself stays.
    """
    me = F.col(node)
    up = nodes.select(F.explode(parents).alias("parent"), me.alias("child"))
    down = nodes.select(me.alias("parent"), F.explode(children).alias("child"))
    named = up.unionByName(down).where("parent is not null and child is not null").distinct()
    ids = nodes.select(me.alias("_id")).where("_id is not null").distinct()
    kept = named.join(ids.withColumnRenamed("_id", "parent"), "parent", "left_semi")
    return kept.join(ids.withColumnRenamed("_id", "child"), "child", "left_semi").select("parent", "child")


def resolve_hierarchy(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root, depth, path`` (array from root to node) of every linked node.

    Roots are the first frontier; each level joins the frontier with the links
    and extends path and depth.  Nodes that no frontier reaches hang on a loop:
    their root and depth are -1 and their path is null.

    A node named under several parents follows the smallest of them, so every
    node has one path.  A link to oneself is a loop.  No links, no rows.  Each
    level is one join that AQE splits if a parent holds most of the children; its
    frontier is cut to a table, so the plan of a level doesn't grow with depth,
    and reached nodes leave the tree, so deep levels read only what is left.
    """
    tree = scratch.cut(links.groupBy("child").agg(F.min("parent").alias("parent")))
    nodes = links.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    roots = (
        links.select(F.col("parent").alias("node"))
        .distinct()
        .join(tree.select(F.col("child").alias("node")), "node", "left_anti")
    )
    start = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    frontier = scratch.cut(start)
    reached, taken = [frontier], []
    left = held = tree.count()
    while left and not frontier.isEmpty():
        below = frontier.select(F.col("node").alias("parent"), "root", "depth", "path").join(tree, "parent")
        frontier = scratch.cut(
            below.select(
                F.col("child").alias("node"), "root", (F.col("depth") + 1).alias("depth"),
                F.concat("path", F.array("child")).alias("path"),
            )
        )
        reached.append(frontier)
        taken.append(frontier.select(F.col("node").alias("child")))
        left -= frontier.count()
        if left * 2 <= held:
            # What was reached is taken out whenever it is half of what a level reads, so all writes are at most twice the tree.
            last, tree = tree, scratch.cut(tree.join(union_all(taken), "child", "left_anti"))
            scratch.drop(last)
            taken, held = [], left
    done = union_all(reached)
    lost = nodes.join(done.select("node"), "node", "left_anti")
    minus = F.lit(-1)
    kind = dict(links.dtypes)["parent"]
    return done.unionByName(
        lost.select("node", minus.cast(kind).alias("root"), minus.alias("depth"), F.lit(None).cast(f"array<{kind}>").alias("path"))
    )


def unfollowed_links(links: DataFrame) -> DataFrame:
    """``parent, child, followed``: counted links that no path follows, since the child has a smaller parent, and that parent."""
    first = links.groupBy("child").agg(F.min("parent").alias("followed"))
    return links.join(first, "child").where("parent <> followed").select("parent", "child", "followed")


def descendants(resolved: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` for all pairs on the resolved paths (a node is not its own)."""
    return (
        resolved.where("depth > 0")
        .select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
        .where("at < depth")
        .select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))
    )


def loops(links: DataFrame, resolved: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, on_loop`` of the unreached nodes: on a loop itself, or hanging below one.

    Leaves of the unreached part are stripped in rounds; what stays is the loops.
    """
    tree = links.groupBy("child").agg(F.min("parent").alias("parent"))
    lost = scratch.cut(resolved.where("depth < 0").select("node"))
    left = scratch.cut(
        tree.join(lost.select(F.col("node").alias("child")), "child", "left_semi")
        .join(lost.select(F.col("node").alias("parent")), "parent", "left_semi")
        .select("parent", "child")
    )
    n = left.count()
    while n:
        kept = left
        for _ in range(STRIPS_PER_CUT):
            kept = kept.join(kept.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child")
        kept = scratch.cut(kept)
        m = kept.count()
        scratch.drop(left)
        left = kept
        if m == n:
            break
        n = m
    on = left.select(F.col("child").alias("node"), F.lit(True).alias("_on"))
    return lost.join(on, "node", "left").select("node", F.coalesce("_on", F.lit(False)).alias("on_loop"))
