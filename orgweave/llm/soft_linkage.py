"""Matching entities across sources without keys: soft-logic linkage.

Weighted rules over the truth y (0 to 1) of every candidate pair of records:

* similarity: a pair is as true as its records are alike, and nothing matches without reason;
* transitivity: if a matches b and b matches c, then a matches c;
* exclusivity: of two records that contradict each other a third matches one at most.

Each broken rule costs its weight times the distance from being kept:

    sum w_s s max(0, s - y) + w_n y + sum w max(0, y_ab + y_bc - 1 - y_ac)

where y_ac is 0 for contradicting records.  This convex hinge-loss problem is
solved by alternating directions.  Every rule moves a copy of its truths of its
own in closed form, the copies are averaged to the consensus, and the
differences are carried on, until no copy is further from the consensus
than a tolerance (primal) and no consensus moves further in a round (dual).

The problem falls apart into the connected components of the candidate pairs,
so these are dealt to tasks, each of which solves all of its own in arrays.  A
component with more rules than a task should hold is solved by the same steps as
aggregations over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.grid_components import grid_components
from orgweave.session import Scratch

SIMILARITY, NOTHING, TRANSITIVITY, EXCLUSIVITY = 1.0, 0.25, 1.0, 2.0
STEP = 1.0
#: No truth may be further from any of its copies, nor from its last value, when rounds end.
TOLERANCE = 1e-3
#: Rounds after which a problem that should have settled long ago is reported as an error.
TOO_MANY = 200_000
#: Possible rules of a component that one task solves, and of all components that are dealt to one task.
RULES_PER_COMPONENT, RULES_PER_TASK = 1_000_000, 200_000

TRUTH = "a bigint, b bigint, confidence double"


def wedges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rules over pairs (a, b): per rule the numbers of its two first pairs and of the third (-1: none), and its weight."""
    n = len(a)
    ends = pd.DataFrame({"mid": np.concatenate([a, b]), "far": np.concatenate([b, a]), "k": np.tile(np.arange(n), 2)})
    many = ends[ends.groupby("mid")["mid"].transform("size") > 1]
    both = many.merge(many, on="mid")
    both = both[both["far_x"] < both["far_y"]]
    third = both.merge(pd.DataFrame({"far_x": np.minimum(a, b), "far_y": np.maximum(a, b), "k3": np.arange(n)}), on=["far_x", "far_y"], how="left")
    at = np.stack([third["k_x"], third["k_y"], third["k3"].fillna(-1)], axis=1).astype(np.int64).reshape(-1, 3)
    return at, np.where(at[:, 2] >= 0, TRANSITIVITY, EXCLUSIVITY)


def objective(y: np.ndarray, sim: np.ndarray, at: np.ndarray, weight: np.ndarray) -> float:
    """What the truths ``y`` cost."""
    third = np.where(at[:, 2] >= 0, y[at[:, 2]], 0.0) if len(at) else np.empty(0)
    broken = np.maximum(0, y[at[:, 0]] + y[at[:, 1]] - 1 - third) if len(at) else np.empty(0)
    return float((SIMILARITY * sim * np.maximum(0, sim - y) + NOTHING * y).sum() + (weight * broken).sum())


def admm(sim: np.ndarray, at: np.ndarray, weight: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(truths, multipliers of the rules) of the problem with similarities ``sim`` and rules ``at, weight``."""
    n = len(sim)
    z, u = sim.astype(float).copy(), np.zeros(n)
    coef = np.tile([1.0, 1.0, -1.0], (len(at), 1)) * (at >= 0)
    where, size = np.where(at >= 0, at, n), (coef**2).sum(axis=1)
    duals, copies = np.zeros(at.shape), 1 + np.bincount(where.ravel(), minlength=n + 1)[:n]
    gain = SIMILARITY * sim - NOTHING
    for _ in range(TOO_MANY):
        v = z - u
        up, down = v + gain / STEP, v - NOTHING / STEP
        x = np.where(up <= sim, up, np.where(down >= sim, down, sim))
        mine = np.append(z, 0.0)[where] - duals
        step = np.clip(((coef * mine).sum(axis=1) - 1) / np.maximum(size, 1), 0, weight / STEP)
        moved = mine - coef * step[:, None]
        told = np.bincount(where.ravel(), (moved + duals).ravel(), n + 1)[:n]
        last, z = z, np.clip((x + u + told) / copies, 0, 1)
        off, rule_off = x - z, (moved - np.append(z, 0.0)[where]) * (at >= 0)
        u, duals = u + off, duals + rule_off
        if max(np.abs(off).max(initial=0), np.abs(rule_off).max(initial=0), np.abs(z - last).max(initial=0)) < tolerance:
            return z, step * STEP
    raise RuntimeError("soft linkage did not settle")


def _solve_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sim) of whole components -> (a, b, confidence)."""
    held = [b for b in batches if b.num_rows]
    if held:
        a, b, sim = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in range(3))
        at, weight = wedges(a, b)
        y = admm(sim, at, weight)[0]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(y)], ["a", "b", "confidence"])


def solve_spread(pairs: DataFrame, scratch: Scratch, tolerance: float = TOLERANCE) -> DataFrame:
    """``a, b, confidence`` of pairs ``a, b, sim`` (a < b), every step an aggregation over copies; for components of any size."""
    ends = pairs.select(F.col("a").alias("mid"), F.col("b").alias("far")).unionByName(pairs.select(F.col("b").alias("mid"), F.col("a").alias("far")))
    other = ends.withColumnRenamed("far", "far2")
    rules = ends.join(other, "mid").where("far < far2")
    third = pairs.select(F.col("a").alias("far"), F.col("b").alias("far2"), F.lit(True).alias("known"))
    rules = rules.join(third, ["far", "far2"], "left").select("mid", "far", "far2", F.coalesce("known", F.lit(False)).alias("known"))
    pair = lambda p, q, c: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.lit(c).alias("c"))
    terms = F.array(pair("mid", "far", 1.0), pair("mid", "far2", 1.0), F.when(F.col("known"), pair("far", "far2", -1.0)))
    listed = rules.select("mid", "far", "far2", F.when(F.col("known"), TRANSITIVITY).otherwise(EXCLUSIVITY).alias("w"), F.explode(F.array_compact(terms)).alias("t"))
    key = ["mid", "far", "far2"]
    copies = scratch.cut(listed.select(*key, "w", "t.a", "t.b", "t.c", F.lit(0.0).alias("d")))
    truth = scratch.cut(pairs.select("a", "b", F.col("sim").cast("double"), F.col("sim").cast("double").alias("z"), F.lit(0.0).alias("u")))
    for _ in range(TOO_MANY):
        mine = copies.join(truth.select("a", "b", "z"), ["a", "b"]).withColumn("v", F.col("z") - F.col("d"))
        push = mine.groupBy(*key).agg((F.sum(F.col("c") * F.col("v")) - 1).alias("t"), F.sum(F.col("c") * F.col("c")).alias("size"), F.max("w").alias("top"))
        push = push.select(*key, F.greatest(F.lit(0.0), F.least(F.col("t") / F.col("size"), F.col("top") / STEP)).alias("step"))
        moved = scratch.cut(mine.join(push, key).select(*key, "w", "a", "b", "c", "d", (F.col("v") - F.col("c") * F.col("step")).alias("x")))
        told = moved.groupBy("a", "b").agg(F.sum(F.col("x") + F.col("d")).alias("told"), F.count("*").alias("n"))
        v = F.col("z") - F.col("u")
        up, down = v + (SIMILARITY * F.col("sim") - NOTHING) / STEP, v - NOTHING / STEP
        x = F.when(up <= F.col("sim"), up).when(down >= F.col("sim"), down).otherwise(F.col("sim"))
        mean = (F.col("x") + F.col("u") + F.coalesce("told", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))
        fresh = truth.withColumn("x", x).join(told, ["a", "b"], "left").withColumn("y", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))
        off = F.greatest(F.abs(F.col("x") - F.col("y")), F.abs(F.col("y") - F.col("z")))
        fresh = scratch.cut(fresh.select("a", "b", "sim", F.col("y").alias("z"), (F.col("u") + F.col("x") - F.col("y")).alias("u"), off.alias("off")))
        carried = moved.join(fresh.select("a", "b", "z"), ["a", "b"]).withColumn("off", F.col("x") - F.col("z"))
        carried = scratch.cut(carried.select(*key, "w", "a", "b", "c", (F.col("d") + F.col("off")).alias("d"), F.abs("off").alias("off")))
        for old in (copies, truth, moved):
            scratch.drop(old)
        copies, truth = carried.drop("off"), fresh.drop("off")
        copies._scratch_path, truth._scratch_path = carried._scratch_path, fresh._scratch_path
        worst = [t.agg(F.max("off")).first()[0] or 0.0 for t in (fresh, carried)]
        if max(worst) < tolerance:
            return truth.select("a", "b", F.col("z").alias("confidence"))
    raise RuntimeError("soft linkage did not settle")


def solve(pairs: DataFrame, scratch: Scratch, rules_per_component: int = RULES_PER_COMPONENT) -> DataFrame:
    """``a, b, confidence`` for candidate pairs ``a, b, sim`` (a < b, each once): records and their similarity.

    Pairs that aren't candidates contradict each other wherever two candidates
    meet in a record.  No pairs, no rows.
    """
    pairs = scratch.cut(pairs.select("a", "b", F.col("sim").cast("double").alias("sim")))
    roots = grid_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    placed = scratch.cut(pairs.join(roots.select(F.col("v").alias("a"), "root"), "a"))
    degree = placed.select("root", F.explode(F.array("a", "b")).alias("mid")).groupBy("root", "mid").agg(F.count("*").alias("n"))
    rules = scratch.cut(degree.groupBy("root").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("rules"), F.sum("n").alias("ends")))
    total = rules.agg(F.sum(F.col("rules") + F.col("ends"))).first()[0] or 0
    large = rules.where(F.col("rules") > rules_per_component).select("root")
    tasks = max(1, int(total / RULES_PER_TASK), min(scratch.spark.sparkContext.defaultParallelism, int(total / 5000)))
    small = placed.join(large, "root", "left_anti").repartition(tasks, "root").select("a", "b", "sim").mapInArrow(_solve_tasks, TRUTH)
    if large.isEmpty():
        return scratch.cut(small)
    return scratch.cut(small.unionByName(solve_spread(placed.join(large, "root", "left_semi").select("a", "b", "sim"), scratch)))
