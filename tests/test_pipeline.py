"""Composite stages on small literal data."""

import json

from pyspark.sql import functions as F

from orgweave.functions import predicates
from orgweave.operators import cluster, publish, resolve, scoring, snippets
from orgweave.sources import sinks


def test_mapping(spark):
    objects = spark.createDataFrame(
        [(1, ["Desc"], ["AS-ONE"], "apnic", ["o1"]), (2, ["9x"], ["AS-TWO"], "apnic", []), (3, [], ["AS-THREE"], "ripe", []), (4, [], [], "ripe", [])],
        "asn bigint, description array<string>, as_name array<string>, rir string, org_id array<string>",
    )
    caida = spark.createDataFrame([("3", "Three, Inc.")], "asn string, org_name string")
    porg = spark.createDataFrame([(7, "Peer", "http://p")], "id bigint, name string, website string")
    pnet = spark.createDataFrame([(2, "Net", 7, "note", "Aka", "http://n")], "asn bigint, name string, org_id bigint, notes string, aka string, website string")
    orgs, mapped = resolve.map_organisations(resolve.attach_registry_org(objects, orgs=None), caida, porg, pnet)
    assert {r.asn: r.org_name for r in mapped.collect()} == {1: "Desc", 2: "Peer", 3: "Three Inc"}
    peer = next(r for r in orgs.collect() if r.org_name == "Peer")
    assert peer.website == ["http://n", "http://p"] and peer.aka == ["Aka"] and peer.notes == ["note"]
    assert resolve.check_mapping(orgs, mapped).count() == 0
    assert resolve.check_mapping(orgs.where("org_name <> 'Peer'"), mapped).count() == 1


def test_registry_names(spark):
    objects = spark.createDataFrame([(1, ["o1"]), (2, ["o9"])], "asn bigint, org_id array<string>")
    orgs = spark.createDataFrame([(["o1"], ["Name"])], "org_id array<string>, org_name array<string>")
    assert {r.asn: r.registry_name for r in resolve.attach_registry_org(objects, orgs, use=True).collect()} == {1: "Name", 2: None}


ORGS = "org_name string, website array<string>, aka array<string>"


def test_alias_groups(spark, scratch):
    orgs = spark.createDataFrame([("Acme Net One", ["http://www.acme.example.org"], []), ("Acme Net Two", [], []), ("Beta Sys", ["https://acme.example.org/x"], None), ("Gamma Ltd", None, None)], ORGS)
    rel = spark.createDataFrame([("Acme Net Two", ["Acme Net Twos", "other thing"])], "base string, alias_list array<string>")
    attrs = cluster.node_attributes(orgs, rel)
    groups = {r.org_name: r.alias_id for r in cluster.main_alias_groups(orgs, attrs, scratch).collect()}
    assert groups["Acme Net One"] == groups["Beta Sys"] and len(set(groups.values())) == 3
    frame = spark.createDataFrame(list(groups.items()), "org_name string, alias_id string")
    assert cluster.secondary_alias_groups(frame, attrs, scratch).count() == 3
    parents = spark.createDataFrame([("Gamma Ltd", "acme net one")], "org_name string, attribute string")
    votes = cluster.ownership_votes(frame, attrs, parents).collect()
    assert [(r.child, r.parent) for r in votes] == [(groups["Gamma Ltd"], groups["Acme Net One"])]


def test_recluster(spark, scratch):
    orgs = spark.createDataFrame([(x,) for x in "abcde"], "org_name string")
    judged = spark.createDataFrame(
        [("a", "b", "0.9", 1, 1), ("b", "c", "0.9", 1, 2), ("c", "a", "0.9", 1, 3), ("c", "d", "0.9", 1, 4), ("d", "c", "0.1", 2, 5), ("d", "e", "n/a", 1, 6)],
        "org_a_name string, org_b_name string, score string, judged_at int, judge_id int",
    )
    assert {r.org_name: r.alias_id for r in cluster.recluster_aliases(orgs, judged, scratch).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    groups = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "org_name string, alias_id string")
    owned = spark.createDataFrame([("a", "b", 0.9, 0.1, 0.0), ("b", "c", 0.0, 0.0, 0.0)], "a string, b string, a_over_b double, b_over_a double, none double")
    got = {r.alias_id: (r.family_id, r.parents) for r in cluster.recluster_parents(groups, owned, scratch).collect()}
    assert got == {"A": ("A", None), "B": ("A", ["A"]), "C": ("C", None)}


FAMILIES = "alias_id bigint, org_family_id bigint, asn_entries array<struct<asn: bigint, as_name: string, org_name: string, rir: string>>, parent array<bigint>, children array<bigint>"


def test_publish(spark, scratch):
    good = spark.createDataFrame([(1, 1, [(10, "n", "o", "r")], None, [2]), (2, 1, [], [1], None)], FAMILIES)
    t = sinks.relational_tables(good)
    nested = sinks.public_records(t["as_table"], t["org_alias_table"], t["alias_relationships"])
    assert {r.alias_id: (len(r.asn_entries), r.parent, r.children) for r in nested.collect()} == {1: (1, [], [2]), 2: (0, [1], [])}
    assert publish.check_links(good).count() == 0
    bad = spark.createDataFrame([(1, 1, [(10, "n", "o", "r")], [2], [2]), (2, 2, [(10, "m", "o", "r")], [1], [9])], FAMILIES)
    b = sinks.relational_tables(bad)
    problems = {r.problem for r in publish.check_tables(b["as_table"], b["org_alias_table"], b["alias_relationships"], scratch).collect()}
    assert problems == {"number repeated", "on an ownership loop", "link across families"}
    assert publish.check_links(bad).count() == 2


def test_judging(spark):
    wanted = spark.createDataFrame([("acme net", "acme web"), ("x", "y")], "org_a_name string, org_b_name string")
    done = spark.createDataFrame([("y", "x")], "org_a_name string, org_b_name string")
    assert [tuple(r)[:3] for r in scoring.judge_missing(wanted, done).collect()] == [("acme net", "acme web", "0.333")]

    def broken(batch):
        raise RuntimeError

    assert scoring.score_pairs(wanted, broken).where("answer is null").count() == 2


def test_relations(spark):
    answer = lambda kind, **k: json.dumps({"base_org_name": "A", "candidate_org_name": k.get("c", "B"), "reasoning for Alias": "", "reasoning for Parent/Subsidiary": "", "relationship": kind, "parent": k.get("p", ""), "parent name": k.get("n", "")})
    rows = [("A", "B", "so: " + answer("Alias")), ("A", "C", answer("Parent/Subsidiary", c="C", p="candidate", n="C")), ("A", "D", answer("Parent/Subsidiary", c="D", p="base", n="A")), ("Z", "B", answer("Alias")), ("Z", "C", "broken")]
    got = scoring.collect_relations(spark.createDataFrame(rows, "base string, cand string, answer string"), "base", "cand", "answer").collect()
    assert [(r.base, r.alias_list, r.parent_company_list, r.subsidiary_list) for r in got] == [("A", ["B"], ["C"], ["D"])]


def test_mentions(spark):
    chunks = spark.createDataFrame([("Acme Net met Beta Sys", "s"), ("nothing", "s"), (None, "s")], "text string, org string")
    tagged = snippets.tag_mentions(chunks, "text", snippets.dictionary_tagger(["Acme Net", "Beta Sys"]))
    assert sorted(r.mention for r in snippets.snippet_rows(tagged, "text", "org", "web").collect()) == ["acme net", "beta sys"]
    akas = snippets.aka_rows(spark.createDataFrame([("Acme", ["AC", ""])], "n string, a array<string>"), "n", "a")
    assert sorted(r.mention for r in akas.collect()) == ["ac", "acme"]
    vectors = scoring.embed(chunks, "text").collect()
    assert all(len(r.vector) == 64 for r in vectors)


def test_stale_pairs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "gone")], "x string, y string")
    names = spark.createDataFrame([("a",), ("b",), (None,)], "n string")
    assert predicates.drop_stale_pairs(pairs, names, "x", "y", "n").count() == 1
    assert pairs.select(predicates.reported(F.col("x"), F.col("y"))).distinct().first()[0] is False
