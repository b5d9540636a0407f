"""Joins against brute force."""

import random

import numpy as np

from orgweave.operators import joins as J


def test_interval_join(spark):
    rng = random.Random(3)
    points = [(n, rng.randrange(2000)) for n in range(150)] + [(900, None)]
    blocks = [(lo, lo + rng.choice([0, 3, 40, 5000]), n) for n, lo in enumerate(rng.sample(range(2000), 60))] + [(None, 5, 99), (9, 2, 98)]
    p, b = spark.createDataFrame(points, "id int, x bigint"), spark.createDataFrame(blocks, "lo bigint, hi bigint, b int")
    got = sorted((r.id, r.b) for r in J.interval_join(p, "x", b, "lo", "hi", bin_size=4).collect())
    assert got == sorted((i, n) for i, x in points for lo, hi, n in blocks if x is not None and lo is not None and lo <= x <= hi)
    assert J.interval_join(p, "x", b.limit(0), "lo", "hi").count() == 0


def test_jaccard_pairs(spark):
    rng = random.Random(5)
    texts = sorted({" ".join(rng.sample("a b c d e f g".split(), rng.randrange(1, 5))) for _ in range(40)}) + ["名", "称"]
    df = spark.createDataFrame([(t, 1) for t in texts] + [(None, 1)], "t string, similarity int").where("t is not null")
    sets = {t: {w for w in t.split() if w.isascii()} for t in texts}
    want = {(a, b) for a in texts for b in texts if a < b and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.5}
    assert {(r.a, r.b) for r in J.jaccard_pairs(df, "t", "t", 0.5).collect()} == want


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = v[8]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None)], "id long, v array<double>")
    got = J.nearest_vectors(df.where("id % 20 = 0"), df, "id", "v", 3, cell_rows=16).collect()
    for q in (0, 20, 40):
        d = ((v - v[q]) ** 2).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(60), d)) if i != q][:3]
        assert [r.neighbour for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == order


def test_lsh_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(50, 8))
    v = np.concatenate([base, base + rng.normal(scale=0.01, size=base.shape)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    found = {(r.a, r.b) for r in J.near_pairs_lsh(df, "id", "v", 0.2).collect()}
    true = {(i, i + 50) for i in range(50)}
    assert len(found & true) / len(true) >= 0.9


def test_pairs(spark):
    done = spark.createDataFrame([("b", "a")], "a string, b string")
    wanted = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "c")], "a string, b string")
    assert [tuple(r) for r in J.resume_pairs(wanted, done, "a", "b").collect()] == [("a", "c")]
    m = spark.createDataFrame([(1, "g"), (2, "g"), (2, "g"), (3, "h")], "id int, g string")
    assert [tuple(r) for r in J.pairs_within(m, "id", "g").collect()] == [("g", 1, 2)]
    e = spark.createDataFrame([("g", "h")], "p string, c string")
    assert sorted(tuple(r) for r in J.pairs_across(m, "id", "g", e, "p", "c").collect()) == [(1, 3), (2, 3)]


def test_merge_context(spark):
    t = spark.createDataFrame([(1, "x", 5), (1, "y", 6)], "p int, s string, o int")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 2)], "p int, s string, o int")
    assert [(r.s, r.side) for r in J.merge_context(t, b, ["p"], "s", "o", 2).orderBy("rank").collect()] == [("x", 0), ("y", 0)]
