"""Graph operators on edge tables: components, cliques, loops, bipartite links, name merge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node linked to it) for ``edges(src, dst)``, by large-star and small-star rounds.

    Every round links each node's larger neighbours, then its smaller ones, to
    the smallest, which halves the distance to the root; rounds are cut to
    tables and stop when the edges stay as they are.  Edges to oneself and
    repeats are harmless; null ends are dropped; no edges, no rows.
    """
    clean = edges.select("src", "dst").where("src is not null and dst is not null")
    loops = clean.where("src = dst").select(F.col("src").alias("node"))
    state = scratch.cut(clean.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        small_low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(small_low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small_low.select("src", F.col("m").alias("dst")))
        turned = small.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        fresh = scratch.cut(turned)
        sums = fresh.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        scratch.drop(state)
        state = fresh
        if tuple(sums) == before:
            break
        before = tuple(sums)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = state.select(F.col("dst").alias("node")).distinct()
    found = state.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    lone = loops.distinct().join(found, "node", "left_anti")
    return found.distinct().unionByName(lone.select("node", F.col("node").alias("component")))


def shared_attribute_families(rows: DataFrame, id_: str, attribute: str, scratch: Scratch) -> DataFrame:
    """``node, component``: rows that share attributes, directly or over others.

    Each attribute links its rows to the smallest of them (a star), so a hot
    attribute costs its rows and not their pairs.  Rows without attribute stay alone.
    """
    ids = rows.select(F.col(id_).alias("src")).where("src is not null").distinct()
    flat = rows.select(F.col(id_).alias("src"), F.col(attribute).alias("attr")).where("src is not null and attr is not null").distinct()
    hub = flat.groupBy("attr").agg(F.min("src").alias("dst"))
    edges = flat.join(hub, "attr").select("src", "dst").distinct()
    return connected_components(edges.unionByName(ids.select("src", F.col("src").alias("dst"))), scratch)


def bipartite_edges(rows: DataFrame, id_: str, attribute: str, canonical: DataFrame | None = None) -> DataFrame:
    """``concrete, virtual`` edges between rows and attributes, or the canonical attribute of each."""
    flat = rows.select(F.col(id_).alias("concrete"), F.col(attribute).alias("virtual")).where("virtual is not null")
    if canonical is None:
        return flat.distinct()
    named = flat.join(canonical.withColumnsRenamed({"node": "virtual", "component": "_c"}), "virtual", "left")
    return named.select("concrete", F.coalesce("_c", "virtual").alias("virtual")).distinct()


def greedy_cliques(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Disjoint maximal cliques of a graph, taken in order of size (greatest first), then names; singletons are left out."""
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found: list[list[str]] = []
    stack = [(frozenset(), set(near), set())]
    while stack:
        clique, maybe, done = stack.pop()
        if not maybe and not done:
            found.append(sorted(clique))
            continue
        pivot = max(maybe | done, key=lambda x: (len(near[x] & maybe), x))
        for v in sorted(maybe - near[pivot]):
            stack.append((clique | {v}, maybe & near[v], done & near[v]))
            maybe = maybe - {v}
            done = done | {v}
    taken: set[str] = set()
    out = []
    for clique in sorted(found, key=lambda c: (-len(c), c)):
        if len(clique) > 1 and not taken & set(clique):
            taken |= set(clique)
            out.append(clique)
    return out


def clique_cover(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``clique, node``: disjoint cliques over ``edges(src, dst)``; clique is its smallest node.

    A clique never spans components, so each component is covered by itself, in
    one task: enumeration has no distributed form, and its cost follows the
    component's density.  No edges, no rows; repeats are harmless.
    """
    comps = scratch.cut(connected_components(edges, scratch))
    keyed = edges.select("src", "dst").where("src <> dst").join(comps.withColumnRenamed("node", "src"), "src")
    kind = dict(edges.dtypes)["src"]

    def cover(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cliques = greedy_cliques(list(zip(group["src"], group["dst"])))
        return pd.DataFrame([(c[0], n) for c in cliques for n in c], columns=["clique", "node"])

    return keyed.groupBy("component").applyInPandas(cover, f"clique {kind}, node {kind}")


def _stripped(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges that are left when nodes without a way in or out are taken away until none is left."""
    state, n = edges, edges.count()
    while n:
        kept = state.join(state.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = scratch.cut(kept.join(state.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        m = kept.count()
        state = kept
        if m == n:
            break
        n = m
    return state


def loop_nodes(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` of ``edges(src, dst)`` that reach themselves; those only between loops don't.

    What has no way in or out is stripped.  Then every node takes the smallest
    node that reaches it as its colour, and whoever of a colour reaches the
    colour's own node is one strong component with it; components are taken out
    and the rest goes on.  Every turn takes a node at least out of each colour,
    so turns end; no step grows pairs.  Null ends are dropped, repeats harmless.
    """
    clean = scratch.cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = [clean.where("src = dst").select(F.col("src").alias("node"))]
    left = _stripped(scratch.cut(clean.where("src <> dst")), scratch)
    while not left.isEmpty():
        colour = scratch.cut(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            told = left.join(colour.withColumnsRenamed({"node": "src", "c": "from"}), "src").groupBy(F.col("dst").alias("node")).agg(F.min("from").alias("from"))
            fresh = scratch.cut(colour.join(told, "node", "left").select("node", F.least("c", "from").alias("c"), (F.col("from") < F.col("c")).alias("moved")))
            scratch.drop(colour)
            colour = fresh
            if colour.where("moved").isEmpty():
                break
        colour = colour.select("node", "c")
        inside = left.join(colour.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"node": "dst", "c": "cd"}), "dst")
        inside = scratch.cut(inside.where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        reached = frontier = scratch.cut(colour.where("node = c"))
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
            frontier = scratch.cut(back.join(reached.select("node"), "node", "left_anti"))
            reached = scratch.cut(reached.unionByName(frontier))
        sizes = reached.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        found.append(scratch.cut(reached.join(sizes, "c").select("node")))
        gone = reached.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _stripped(scratch.cut(rest.select("src", "dst")), scratch)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def weak_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component, parents`` of directed ``edges(src parent, dst child)``; parents is the sorted list of a node's predecessors."""
    comps = connected_components(edges, scratch)
    parents = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
    return comps.join(parents, "node", "left")


def merge_by_name(families: DataFrame, family: str, name_key: str, scratch: Scratch) -> DataFrame:
    """``node, component``: families that share a name, directly or over others, are one."""
    return shared_attribute_families(families, family, name_key, scratch)
