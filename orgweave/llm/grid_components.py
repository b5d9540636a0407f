"""Consolidating pairwise matches into groups on a two-dimensional grid.

Vertices are hashed into blocks and every edge goes to the cell (block, block)
of its ends, so the edges of a name that occurs in a third of all pairs lie in a
whole row of cells.  Each task runs union-find over its cells and says for each
vertex it saw the smallest vertex it is linked to; the exchange of these row and
column representatives gives parents and a smaller graph between
representatives.  Levels repeat until no two representatives of a vertex differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.session import Scratch

#: Edges of one grid cell in a task; a task holds about 40 bytes for each.
EDGES_PER_CELL = 2_000_000
#: Below so many edges a cell, a task costs more than its work.
LEAST_EDGES = 200_000
#: Components larger than this are named through a broadcast table, which then has at most (vertices / this) rows.
HOT_COMPONENT = 1_000_000


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (u, v) and the smallest vertex linked to each.

    Hooking to the smaller root and path halving, on whole arrays.
    """
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return ids, ids[parent]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the batches of a partition into one forest; memory follows its vertices, not its edges."""
    held, ids, reps, buffered = [], np.empty(0, np.int64), np.empty(0, np.int64), 0

    def fold():
        u = np.concatenate([ids, *(h[0] for h in held)])
        v = np.concatenate([reps, *(h[1] for h in held)])
        return union_find(u, v)

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        buffered += batch.num_rows
        if buffered > max(200_000, len(ids)):
            ids, reps = fold()
            held, buffered = [], 0
    if held:
        ids, reps = fold()
    for at in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 100_000]), pa.array(reps[at : at + 100_000])], ["v", "rep"])


def grid_side(edges: int, tasks: int, edges_per_cell: int) -> int:
    """Blocks on a side of the grid: at least 2, a cell for every task, and no more edges in a cell than one task holds."""
    side = 2
    while side * (side + 1) // 2 < max(tasks, -(-edges // edges_per_cell)):
        side += 1
    return side


def grid_components(edges: DataFrame, scratch: Scratch, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """``v, root``: of every vertex of ``edges(u bigint, v bigint)`` the smallest vertex it is linked to.

    Repeated edges, either order and edges to oneself are harmless; edges with a
    null end are dropped; no edges, no rows.

    Every level puts its edges on a grid, of two blocks a side at least; the
    greatest vertex of a component is no representative after it, so levels end.
    """
    tasks = scratch.spark.sparkContext.defaultParallelism
    level = scratch.cut(edges.where("u is not null and v is not null").select("u", "v"))
    parents: list[DataFrame] = []
    n = level.count()
    while n or not parents:
        side = grid_side(n, min(tasks, -(-n // LEAST_EDGES)), edges_per_cell)
        bu, bv = (F.pmod(F.xxhash64(F.lit(len(parents)), c), F.lit(side)) for c in ("u", "v"))
        # The cell (row, column) of the upper triangle, numbered along the columns; each is a partition of its own.
        row, column = F.least(bu, bv), F.greatest(bu, bv)
        cell = (column * (column + 1) / 2 + row).cast("int")
        spread = level.repartitionById(side * (side + 1) // 2, cell)
        seen = spread.select("u", "v").mapInArrow(_local, "v bigint, rep bigint")
        # A vertex lies in at most ``side`` cells, so the set of its representatives is bounded.
        met = scratch.cut(seen.groupBy("v").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("reps")))
        parents.append(met)
        level = met.where("size(reps) > 1").select(F.explode("reps").alias("u"), F.col("p").alias("v")).where("u <> v").distinct()
        n = met.agg(F.sum(F.size("reps") - 1)).first()[0] or 0  # repeats included, so at least as many as the next level has
    labels = parents.pop().select("v", F.col("p").alias("root"))
    for above, below in enumerate(reversed(parents), 1):
        upper = labels.select(F.col("v").alias("p"), "root")
        labels = below.select("v", "p").join(upper, "p", "left").select("v", F.coalesce("root", "p").alias("root"))
        if above % 3 == 0:
            labels = scratch.cut(labels)
    return scratch.cut(labels)


def injective_ids(names: DataFrame, column: str, tries: int = 8) -> tuple[DataFrame, int]:
    """``id, name`` of the distinct names, and the hash seed under which no two share an id.

    One aggregation finds a clash; it is rare below some billion names (64 bits), and then
    another seed is tried.
    """
    for seed in range(tries):
        keyed = names.select(F.xxhash64(F.lit(seed), column).alias("id"), F.col(column).alias("name")).distinct()
        if keyed.groupBy("id").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").isEmpty():
            return keyed, seed
    raise RuntimeError("no seed gives distinct 64-bit ids; key the vertices otherwise")


def name_groups(pairs: DataFrame, a: str, b: str, scratch: Scratch, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """``name, group_name``: of each name in matched pairs the smallest name (by bytes) linked to it.

    Null ends are dropped; a pair of a name with itself names a group of one; no pairs, no rows.
    """
    linked = scratch.cut(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null"))
    names, seed = injective_ids(linked.select(F.explode(F.array("x", "y")).alias("name")).distinct(), "name")
    ends = [F.xxhash64(F.lit(seed), c).alias(i) for c, i in (("x", "u"), ("y", "v"))]
    roots = grid_components(linked.select(*ends), scratch, edges_per_cell)
    placed = scratch.cut(names.join(roots.withColumnRenamed("v", "id"), "id").select("name", "root"))
    first = scratch.cut(placed.groupBy("root").agg(F.min("name").alias("group_name"), F.count("*").alias("n")))
    big = first.where(F.col("n") > HOT_COMPONENT).select("root", "group_name")
    rest = first.where(F.col("n") <= HOT_COMPONENT).select("root", "group_name")
    if big.isEmpty():
        return placed.join(rest, "root").select("name", "group_name")
    hot = placed.join(F.broadcast(big), "root", "left")
    done = hot.where("group_name is not null").select("name", "group_name")
    cold = hot.where("group_name is null").select("name", "root").join(rest, "root").select("name", "group_name")
    return done.unionByName(cold)
