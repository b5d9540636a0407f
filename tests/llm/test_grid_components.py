"""Grid components and name groups against plain union-find."""

import random

import pytest
from pyspark.sql import functions as F

from orgweave.llm import grid_components as G
from orgweave.llm import p1_groups


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


@pytest.mark.parametrize("cell", [7, 40, 10_000])
def test_grid(spark, scratch, cell):
    rng = random.Random(cell)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(500, n) for n in range(300, 340)] + [(n, n + 1) for n in range(700, 740)] + [(900, 900)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3)], "u bigint, v bigint").withColumn("root", F.lit(1))
    assert {r.v: r.root for r in G.grid_components(df, scratch, cell).collect()} == plain(edges)


def test_the_grid_has_two_blocks_a_side_at_least():
    assert G.grid_side(1, 1, 2_000_000) == 2 and G.grid_side(10**9, 12, 2_000_000) * (G.grid_side(10**9, 12, 2_000_000) + 1) // 2 >= 500
    assert G.grid_side(0, 12, 10) * (G.grid_side(0, 12, 10) + 1) // 2 >= 12


def test_a_million_edges_settle(spark, scratch):
    # A random graph, a path and a star of a million edges together (ten million were run by hand); the path and the star are one component each.
    n = 400_000
    part = lambda u, v, rows: spark.range(rows).select(u.cast("long").alias("u"), v.cast("long").alias("v"))
    i = F.col("id")
    random_ = part(F.pmod(F.xxhash64(i), F.lit(n)), F.pmod(F.xxhash64(i, F.lit(7)), F.lit(n)), 600_000)
    path, star = part(i + 10_000_000, i + 10_000_001, 200_000), part(F.lit(20_000_000), i + 20_000_001, 200_000)
    edges = scratch.cut(random_.unionByName(path).unionByName(star))
    roots = scratch.cut(G.grid_components(edges, scratch))
    count = lambda low, high: [tuple(r) for r in roots.where(F.col("v").between(low, high)).groupBy("root").count().collect()]
    assert count(10_000_000, 12_000_000) == [(10_000_000, 200_001)] and count(20_000_000, 22_000_000) == [(20_000_000, 200_001)]
    both = edges.join(roots.select(F.col("v").alias("u"), F.col("root").alias("a")), "u").join(roots.select("v", F.col("root").alias("b")), "v")
    assert both.where("a <> b").isEmpty() and roots.where("root > v").isEmpty()


def test_no_edges(spark, scratch):
    assert G.grid_components(spark.createDataFrame([], "u bigint, v bigint"), scratch).count() == 0


def test_large_component_is_named_apart(spark, scratch, monkeypatch):
    monkeypatch.setattr(G, "HOT_COMPONENT", 3)
    pairs = spark.createDataFrame([("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), (None, "q")], "a string, b string")
    got = {r.name: r.group_name for r in G.name_groups(pairs, "a", "b", scratch).collect()}
    assert got == {"b": "b", "c": "b", "d": "b", "e": "b", "x": "x", "y": "x"}


JUDGED = "judge_id bigint, org_a_name string, org_b_name string, score string, judged_at int, hit int"


def test_verdicts(spark):
    data = [
        (1, " A ", "b", "0.9", 1, 0), (2, "B", "a", "0.1", 2, 0), (2, "B", "a", "0.1", 2, 0),
        (3, "c", "d", " 0.61 ", 1, 0), (4, "e", "f", "0,9", 1, 0), (5, "g", "h", "0.6", 1, 0), (6, "i", "I ", "1", 1, 0), (7, None, "x", "1", 1, 0), (8, " ", "x", "1", 1, 0),
        (9, "k", "l", "0.9", 5, 0), (10, "l", "k", "0.2", 5, 0), (11, "m", "n", None, None, 0), (12, "m", "n", "1.", None, 0), (13, "o", "p", "1e0", 1, 0), (14, "q", "r", "+.7", 1, 0),
    ]
    got = sorted(tuple(r) for r in p1_groups.matched_pairs(spark.createDataFrame(data, JUDGED)).collect())
    assert got == [("c", "d"), ("m", "n"), ("q", "r")]
    assert p1_groups.matched_pairs(spark.createDataFrame([], JUDGED)).count() == 0
