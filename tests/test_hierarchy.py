"""Hierarchies: paths, loops, descendants; odd input."""

import random

import pytest

from orgweave.operators import hierarchy as H

NODES = "alias_id bigint, parent array<bigint>, children array<bigint>, root int"


def resolved(spark, scratch, data):
    links = H.counted_links(spark.createDataFrame(data, NODES), "alias_id", "parent", "children")
    return links, H.resolve_hierarchy(links, scratch)


def test_paths_loops_and_clashing_column(spark, scratch, rows):
    data = [(1, None, [2, 2, None], 7), (2, [1], [], 7), (3, [2], None, 7), (4, [5], None, 7), (5, [4], None, 7), (6, [5], [], 7), (7, [99], None, 7), (8, [8], None, 7), (9, None, None, 7)]
    links, done = resolved(spark, scratch, data)
    assert rows(done.select("node", "root", "depth", "path")) == sorted(
        [(1, 1, 0, [1]), (2, 1, 1, [1, 2]), (3, 1, 2, [1, 2, 3]), (4, -1, -1, None), (5, -1, -1, None), (6, -1, -1, None), (8, -1, -1, None)], key=repr
    )
    assert rows(H.descendants(done)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert rows(H.loops(links, done, scratch)) == [(4, True), (5, True), (6, False), (8, True)]


def test_empty_and_unlinked(spark, scratch):
    _, done = resolved(spark, scratch, [(1, None, None, 0)])
    assert done.count() == 0
    links, done = resolved(spark, scratch, [])
    assert done.count() == 0 and H.loops(links, done, scratch).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walking_up(spark, scratch, seed):
    rng = random.Random(seed)
    parent = {n: rng.randrange(40) for n in range(1, 40) if rng.random() < 0.8}
    data = [(n, [parent[n]] if n in parent and n % 2 else None, [c for c, p in parent.items() if p == n and c % 2 == 0], 0) for n in range(40)]
    _, done = resolved(spark, scratch, data)
    for r in done.collect():
        at, path = r.node, [r.node]
        while at in parent and len(path) < 60:
            at = parent[at]
            path.append(at)
        endless = len(path) >= 60
        assert (r.root, r.depth) == ((-1, -1) if endless else (at, len(path) - 1))
        assert r.path is None if endless else r.path == path[::-1]
