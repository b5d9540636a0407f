"""Components, cliques, loops."""

import itertools
import random

import pytest

from orgweave.operators import graph as G


def components(edges):
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = {}
    for n in root:
        out.setdefault(find(n), set()).add(n)
    return {n: min(c) for c in out.values() for n in c}


@pytest.mark.parametrize("n, m, seed", [(40, 25, 1), (60, 90, 2)])
def test_components(spark, scratch, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 130)] + [(200, 200)]
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1)], "src bigint, dst bigint")
    assert {r.node: r.component for r in G.connected_components(df, scratch).collect()} == components(edges)


def test_no_edges(spark, scratch):
    assert G.connected_components(spark.createDataFrame([], "src bigint, dst bigint"), scratch).count() == 0


def test_greedy_cliques():
    assert G.greedy_cliques([("a", "b"), ("b", "c"), ("c", "d")]) == [["a", "b"], ["c", "d"]]
    assert G.greedy_cliques([]) == []
    rng = random.Random(4)
    for _ in range(20):
        names = "abcdefg"
        edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(9)}
        near = lambda c: all(p in edges for p in itertools.combinations(c, 2))
        cliques = [c for k in range(2, 8) for c in itertools.combinations(names, k) if near(c)]
        maximal = [c for c in cliques if not any(set(c) < set(d) for d in cliques)]
        taken, want = set(), []
        for c in sorted(maximal, key=lambda c: (-len(c), c)):
            if not taken & set(c):
                taken |= set(c)
                want.append(list(c))
        assert G.greedy_cliques(list(edges)) == want


def test_clique_cover_and_loops(spark, scratch):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert sorted(tuple(r) for r in G.clique_cover(e, scratch).collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")]
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "src int, dst int")
    assert {r.node for r in G.loop_nodes(d, scratch).collect()} == {1, 2, 3}


def test_loops_of_any_length_and_between(spark, scratch):
    chain = [(k, k + 1) for k in range(60)]
    edges = chain + [(100, 101), (101, 100), (101, 102), (102, 103), (103, 104), (104, 103), (7, 7), (None, 3), (200, 201), (201, 202), (202, 200), (202, 203), (203, 201)]
    found = {r.node for r in G.loop_nodes(spark.createDataFrame(edges, "src int, dst int"), scratch).collect()}
    assert found == {7, 100, 101, 103, 104, 200, 201, 202, 203}, "a chain is no loop, nor is 102 between two"
    assert G.loop_nodes(spark.createDataFrame([], "src int, dst int"), scratch).count() == 0


def test_shared_attributes(spark, scratch):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, None)], "id int, at string")
    assert {r.node: r.component for r in G.shared_attribute_families(rows, "id", "at", scratch).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
