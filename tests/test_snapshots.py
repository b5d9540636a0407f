"""Changes between snapshots: nulls, order, repeats, stale rows."""

from orgweave.operators.snapshots import snapshot_changes

SCHEMA = "m string, k bigint, t int, f bigint, e array<struct<a: bigint, b: string>>, change_kind string"


def changes(spark, data):
    return sorted(tuple(r) for r in snapshot_changes(spark.createDataFrame(data, SCHEMA), "k", "m", "t", ["f", "e"]).collect())


def test_kinds(spark):
    data = [
        ("1", 1, 1, 5, [(1, "x"), (2, None)], "z"), ("2", 1, 1, 5, [(2, None), (1, "x"), (1, "x")], "z"),
        ("1", 2, 1, 5, None, "z"), ("2", 2, 1, 5, [], "z"),
        ("1", 3, 1, 5, [(1, None)], "z"), ("2", 3, 1, 5, [(None, "1")], "z"),
        ("1", 4, 1, None, None, "z"), ("2", 4, 1, 0, None, "z"),
        ("1", 5, 1, 1, None, "z"), ("2", 6, 1, 1, None, "z"), ("2", 6, 1, 1, None, "z"),
        ("1", 7, 1, 1, None, "z"), ("1", 7, 2, 2, None, "z"), ("2", 7, 1, 2, None, "z"), ("2", 7, None, 9, None, "z"),
        ("1", 8, 1, 1, [(1, "")], "z"), ("2", 8, 1, 1, [(1, None)], "z"),
        (None, 9, 1, 1, None, "z"), ("2", None, 1, 1, None, "z"),
    ]
    assert changes(spark, data) == [("2", 3, "changed"), ("2", 4, "changed"), ("2", 5, "removed"), ("2", 6, "added"), ("2", 8, "changed")]


def test_gap_and_empty(spark):
    assert changes(spark, [("1", 1, 1, 1, None, ""), ("2", 2, 1, 1, None, ""), ("3", 1, 1, 1, None, "")]) == [("2", 1, "removed"), ("2", 2, "added"), ("3", 1, "added"), ("3", 2, "removed")]
    assert changes(spark, []) == [] and changes(spark, [("1", 1, 1, 1, None, "")]) == []
