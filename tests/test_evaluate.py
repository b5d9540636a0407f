"""Aggregates and evaluation on literal cases."""

from pyspark.sql import functions as F

from orgweave.operators import aggregates as A
from orgweave.operators import evaluate as E


def members(spark, clusters):
    return spark.createDataFrame([(n, m) for n, c in enumerate(clusters) for m in c], "cluster int, asn int")


def test_compare(spark):
    r = E.compare_partitions(members(spark, [{1, 2, 3}, {4}]), members(spark, [{1, 2}, {3}, {4}]), "cluster", "asn").first()
    assert (r.identical_multi, r.our_covering, r.our_multi_covered, r.our_single_covered, r.our_members_covered, r.their_covering) == (0, 1, 1, 1, 3, 0)


def test_recall(spark):
    truth = spark.createDataFrame([("o", m) for m in (1, 2, 3, 4)], "org string, asn int")
    per = E.best_cluster_recall(truth, members(spark, [{1, 2, 9}, {3}]), "org", "cluster", "asn")
    assert (per.first().overlap, per.first().recall) == (2, 0.5) and tuple(E.recall_summary(per).first()) == (0.5, 0.5)


def test_stability(spark):
    r = E.stability(members(spark, [{1, 2}, {3}]), members(spark, [{1, 2, 3}]), "cluster", "asn").first()
    assert (r.identical, r.jaccard, r.changed_members) == (0, 0.0, 3)


def test_confusion_matches_published_arithmetic(spark):
    rows = [(True, True)] * 191 + [(False, True)] * 5 + [(True, False)] * 9 + [(False, False)] * 195
    r = E.confusion(spark.createDataFrame(rows, "g boolean, p boolean"), "g", "p").first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (97.45, 95.5, 96.46, 96.5)


def test_votes(spark):
    v = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, c string")
    assert sorted(tuple(r) for r in A.top_vote(v, "k", "c").collect()) == [(1, "a", 1), (2, "c", 1)]
    s = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (2, 3, None)], "c int, p int, s double")
    assert sorted(tuple(r) for r in A.best_parent(s, "c", "p", "s").collect()) == [(1, 4, 0.5), (2, 3, None)]
    three = lambda *x, **k: spark.range(1).select(A.three_way(*map(F.lit, x), **k)).first()[0]
    assert three(0.0, 0.0, 0.0) == "A" and three(0.0, 0.0, 0.0, need_positive=True) == "none" and three(0.1, 0.5, 0.5) == "B"


def test_group_edges_need_votes_before_pruning(spark):
    m = spark.createDataFrame([("p1", "P"), ("p2", "P"), ("p3", "P"), ("c1", "C")], "member string, group string")
    pruned = spark.createDataFrame([("c1", "p1")], "child string, parent string")
    whole = spark.createDataFrame([("c1", "p1"), ("c1", "p2")], "child string, parent string")
    assert A.group_edges(pruned, m).count() == 0 and [tuple(r) for r in A.group_edges(whole, m).collect()] == [("P", "C")]


def test_split_and_groups(spark):
    s = A.contiguous_split(spark.createDataFrame([(c,) for c in "edcba"], "n string"), "n", 2)
    assert {r.n: r.part for r in s.collect()} == dict(zip("abcde", [0, 0, 0, 1, 1]))
    g = A.group_organisations(spark.createDataFrame([("x", ["b", " a", ""]), ("x", None), ("y", None)], "n string, l array<string>"), "n", ["l"])
    assert {r.n: r.l for r in g.collect()} == {"x": ["a", "b"], "y": []}
