"""Registry dumps, feeds, pages, sinks, streaming."""

import gzip
import json

from orgweave.operators import resolve, snippets
from orgweave.sources import feeds, rpsl, sinks
from orgweave.streaming import ingest

DUMP = """% banner
aut-num:        AS64500
as-name:        EXAMPLE-AS
descr:          first: part
+               second
                third
# comment
org:            ORG-EX1
mnt-by:         M1
mnt-by:         M2
last-modified:  2025-09-01T00:00:00Z

organisation:   ORG-EX1
org-name:       Example Ltd

role:           Desk
address:        Here

as-block:       AS64000 - AS64600
remarks:        allocated to APNIC
last-modified:  2025-01-01T00:00:00Z

aut-num:        none"""


def test_grammar():
    records = list(rpsl.parse_records(DUMP.split("\n")))
    assert records[0]["descr"] == ["first: part", "second", "third"] and records[0]["mnt-by"] == ["M1", "M2"] and records[-1] == {"aut-num": ["none"]}
    assert list(rpsl.parse_records(["+ lost", "origin: a", "origin: b"])) == [{"origin": ["b"]}] and list(rpsl.parse_records([])) == []
    assert len(list(rpsl.parse_records(DUMP.split("\n"), frozenset(["role"])))) == 1


def test_dump_objects(spark, tmp_path):
    with gzip.open(tmp_path / "ripe.db.gz", "wt", encoding="latin-1") as f:
        f.write(DUMP)
    raw = rpsl.read_dump(spark, str(tmp_path), "ripe")
    a = rpsl.as_objects(raw, "ripe").collect()
    assert [(r.asn, r.org_id, str(r.changed_time)[:10]) for r in a] == [(64500, ["org-ex1"], "2025-09-01")]
    assert [r.org_name for r in rpsl.org_objects(raw, "ripe").collect()] == [["Example Ltd"]] and rpsl.contact_objects(raw, "ripe").count() == 1
    assert [(r.low, r.high, r.assigned_to) for r in rpsl.as_blocks(raw, "ripe").collect()] == [(64000, 64600, "apnic")]


def test_arin_ranges(spark, tmp_path):
    (tmp_path / "arin.txt").write_text("ASHandle: AS10\nASNumber: 10 - 12\nOrgID: EX\nUpdated: 2025-08-30\n\nASHandle: AS9\nASNumber: 9\nOrgID: RIPE\n\nASHandle: AS2\nASNumber: 20000000\n")
    got = rpsl.as_objects(rpsl.read_dump(spark, str(tmp_path / "arin.txt"), "arin"), "arin")
    assert sorted(r.asn for r in got.collect()) == [10, 11, 12]


def test_conflicts(spark):
    objects = spark.createDataFrame([(150, "ripe", "2025-02-01"), (150, "apnic", "2020-01-01"), (7, "ripe", None), (7, "arin", "2021-01-01")], "asn bigint, rir string, changed_time string")
    blocks = spark.createDataFrame([(100, 200, "2024-01-01", "apnic"), (1, 90000, "2019-01-01", "ripe")], "low bigint, high bigint, changed_time string, assigned_to string")
    got = {r.asn: r.rir for r in resolve.resolve_conflicts(objects, blocks.where("low = 100")).collect()}
    assert got == {150: "apnic", 7: "arin"}


def test_feeds(spark, tmp_path):
    lines = [{"type": "Organization", "organizationId": "A", "name": "Old"}, {"type": "Organization", "organizationId": "A", "name": "New"}, {"type": "Organization", "organizationId": "@del1", "name": "x"},
             {"type": "ASN", "asn": "1", "organizationId": "A"}, {"type": "ASN", "asn": "2", "organizationId": "@del1"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert [tuple(r) for r in feeds.caida_names(spark, str(tmp_path / "c.jsonl")).collect()] == [("1", "New")]
    (tmp_path / "p.json").write_text(json.dumps({"org": {"data": [{"id": 1, "name": "A, Inc.", "website": "w"}]}, "net": {"data": [{"asn": 5, "name": "N", "org_id": 1, "aka": ""}]}}))
    org, net = feeds.peering_tables(spark, str(tmp_path / "p.json"))
    assert org.first().name == "A Inc" and net.first().asn == 5


def test_baselines(spark, scratch, tmp_path):
    (tmp_path / "l.json").write_text("[[1,2],[3]]")
    (tmp_path / "s.json").write_text(json.dumps({"data": {"1": {"Sibling ASNs": [2]}, "2": {"Sibling ASNs": [3]}, "9": {"Sibling ASNs": []}}}))
    assert feeds.baseline_lists(spark, str(tmp_path / "l.json")).count() == 3
    assert {r.asn: r.cluster for r in feeds.baseline_siblings(spark, str(tmp_path / "s.json"), scratch).collect()} == {1: "1", 2: "1", 3: "1", 9: "9"}


def test_pages_and_chunks():
    page = "<main><p>One two. Last words here</p><list><item>a</item><item>b</item><item>c</item></list><table><row><cell>1</cell><cell>x</cell></row></table></main>"
    parts = snippets.flatten_page(page)
    assert parts[0] == ("text", "One two. Last words here") and parts[1] == ("listing", "Last words here\na\nb") and parts[3] == ("table", "Last words here\nColumn 1: 1; Column 2: x")
    assert snippets.flatten_page(None) == [] and snippets.flatten_page("") == []
    chunks = snippets.split_text("word " * 200, 50, 10)
    assert max(map(len, chunks)) <= 50 and "".join(chunks).replace(" ", "").startswith("wordword") and snippets.split_text("x" * 120, 50, 0) == ["x" * 50, "x" * 50, "x" * 20]
    assert snippets.split_text("  ") == []


def test_store(spark):
    rows = spark.createDataFrame([("m", "t"), ("m", "t"), (None, "t")], "mention string, text string")
    store = sinks.upsert_snippets(None, rows, ["mention", "text"])
    again = sinks.upsert_snippets(store, spark.createDataFrame([("m", "t"), ("n", "t")], "mention string, text string"), ["mention", "text"])
    assert store.count() == 2 and again.count() == 3


def test_stream_is_incremental(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "k string").coalesce(1)
    frame("a", "b").write.mode("append").parquet(src)
    ingest.upsert_stream(spark, "k string", src, out, ck, ["k"])
    frame("b", "c").write.mode("append").parquet(src)
    ingest.upsert_stream(spark, "k string", src, out, ck, ["k"])
    ingest.upsert_stream(spark, "k string", src, out, ck, ["k"])
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
