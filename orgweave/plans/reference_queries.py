"""One query for each operator group of the pipeline, over whole tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgweave.functions import text as T
from orgweave.functions.answers import first_json_object
from orgweave.functions.predicates import blocked, long_enough, reported, score_matches, usable_attribute
from orgweave.functions.wordlists import BLOCKED_NAMES, BLOCKED_PARTS, INSTITUTION_WORDS, REGISTRIES, REPORTED_NAMES, STOP_ATTRIBUTES
from orgweave.operators import aggregates as A
from orgweave.operators import evaluate as E
from orgweave.operators import graph as G
from orgweave.operators import joins as J
from orgweave.operators import publish
from orgweave.operators import snippets as S
from orgweave.session import Scratch
from orgweave.sources import rpsl, sinks
from orgweave.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_NAMES = "(select distinct org_name as n from org where org_name is not null union select distinct p_name || ' / ' || p_type || '; Co. Ltd' from part)"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    made = F.concat("p_name", F.lit(" / "), "p_type", F.lit("; Co. Ltd")).alias("n")
    return table(spark, folder, "org").select(F.col("org_name").alias("n")).where("n is not null").unionByName(table(spark, folder, "part").select(made)).distinct()


@query(rf"""
select n, trim(regexp_replace(regexp_replace(n, '[,.|/\;]', '', 'g'), '\s+', ' ', 'g')) as name,
  trim(lower(regexp_replace(regexp_replace(n, '[,./]', ' ', 'g'), '\s+', ' ', 'g'))) as merge_key,
  trim(regexp_replace(lower(n), '[,.<>:"/\\|?*]', '', 'g')) as cluster_key,
  trim(regexp_replace(lower(n), '[^a-z0-9 ]', '', 'g')) as attribute_key,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '\b(inc|llc|ltd|corp|company|co)\b\.?', '', 'g'), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g')) as embedding_key,
  regexp_replace(n, '[<>:"/\\|?*]', '_', 'g') as path_safe, lower(trim(trim(regexp_replace(n, '[<>:"/\\|?*,;]', '', 'g')))) as mention_key,
  lower(trim(regexp_replace(n, '[^a-zA-Z ]', '', 'g'))) as letters_key, regexp_matches(n, '^[a-zA-Z]') as starts_with_letter
from {_NAMES}""")
def org_name_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """The name keys of every organisation name."""
    n = F.col("n")
    return _names(spark, folder).select(
        "n", T.normalize_name(n).alias("name"), T.merge_key(n).alias("merge_key"), T.cluster_key(n).alias("cluster_key"), T.attribute_key(n).alias("attribute_key"),
        T.embedding_key(n).alias("embedding_key"), T.path_safe(n).alias("path_safe"), T.mention_key(n).alias("mention_key"), T.letters_key(n).alias("letters_key"),
        T.starts_with_letter(n).alias("starts_with_letter"),
    )


@query("""
select c_custkey, cast(regexp_replace(c_name, '[^0-9]', '', 'g') as bigint) as asn, cast(regexp_extract(c_name, '(\\d+)', 1) as bigint) as first_number from customer""")
def asn_digits(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in customer names: all digits, and the first run."""
    return table(spark, folder, "customer").select("c_custkey", T.asn_digits(F.col("c_name")).alias("asn"), T.first_integer(F.col("c_name")).alias("first_number"))


@query("""select n_nationkey, unnest(generate_series(cast(n_nationkey * 10 as bigint), cast(n_nationkey * 10 + n_regionkey as bigint))) as asn from nation""")
def range_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Number ranges written as text, expanded."""
    low = F.col("n_nationkey") * 10
    written = F.concat(low.cast("string"), F.lit(" - "), (low + F.col("n_regionkey")).cast("string"))
    return table(spark, folder, "nation").select("n_nationkey", F.explode(T.integer_range(written)).alias("asn"))


@query("""
select cast(s_suppkey + 64500 as bigint) as asn, s_name as as_name, cast('org-' || s_nationkey as varchar) as org_id, 'mnt-a|mnt-b' as mnt_by, 'last' as origin from supplier""")
def rpsl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers written as registry records with comments, continuations and repeats, and read back."""
    import pandas as pd

    lines = F.concat(
        F.lit("# comment\naut-num:        AS"), (F.col("s_suppkey") + 64500).cast("string"), F.lit("\nas-name:        "), F.substring_index("s_name", "#", 1), F.lit("#\n+"),
        F.substring_index("s_name", "#", -1), F.lit("\norg:            ORG-"), F.col("s_nationkey").cast("string"), F.lit("\nmnt-by: mnt-a\nmnt-by: mnt-b\n% remark\norigin: first\norigin: last"),
    )

    def parse(batches):
        for b in batches:
            yield pd.DataFrame({"record_id": range(len(b)), "file": "", "attributes": [next(rpsl.parse_records(t.split("\n"))) for t in b["t"]]})

    raw = table(spark, folder, "supplier").select(lines.alias("t")).mapInPandas(parse, rpsl.RAW)
    name = F.array_join("as_name", "")
    objects = rpsl.as_objects(raw.select("record_id", "file", F.map_filter("attributes", lambda k, v: k != "origin").alias("attributes")), "ripe")
    origin = raw.select(T.asn_digits(F.element_at(rpsl.values(["aut-num"]), 1)).alias("asn"), F.element_at(rpsl.values(["origin"]), 1).alias("origin"))
    return objects.join(origin, "asn").select("asn", name.alias("as_name"), F.element_at("org_id", 1).alias("org_id"), F.array_join("mnt_by", "|").alias("mnt_by"), "origin")


_CASES = " ".join(f"when contains(x, '{r}') or contains(x, '{r.upper()}') then '{r}'" for r in REGISTRIES)


@query(f"""
select doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: case {_CASES} else '' end), lambda y: y <> '')[1], '') as rir
from documents where text is not null""")
def registry_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Registry that a document's first line to name one names."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.registry_of(F.split("text", "\n")).alias("rir"))


def _org_lists(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "org").select(T.normalize_name(F.col("org_name")).alias("name"), "org_id", "aka", "website")


_ORG_NAME = r"trim(regexp_replace(regexp_replace(org_name, '[,.|/\;]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""
with o as (select {_ORG_NAME} as name, org_id, aka, website from org where org_name is not null),
flat as (select distinct name, k, trim(v) as v from (
  select name, 'org_id' as k, unnest(org_id) as v from o union all select name, 'aka', unnest(aka) from o union all select name, 'website', unnest(website) from o) where trim(v) <> ''),
g as (select name, k, string_agg(v, '|' order by v) as s from flat group by name, k)
select d.name, coalesce(a.s, '') as org_id, coalesce(b.s, '') as aka, coalesce(c.s, '') as website from (select distinct name from o) d
left join g a on a.name = d.name and a.k = 'org_id' left join g b on b.name = d.name and b.k = 'aka' left join g c on c.name = d.name and c.k = 'website'""")
def org_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each organisation name with its distinct ids, other names and web sites."""
    grouped = A.group_organisations(_org_lists(spark, folder), "name", ["org_id", "aka", "website"])
    return grouped.select("name", *(F.array_join(c, "|").alias(c) for c in ("org_id", "aka", "website")))


_ENTRIES = "(select alias_id, org_family_id, snap_month, unnest(asn_entries) as e from saint_org_families)"


@query(f"""
with n as (select distinct e.asn as asn, e.org_name as org_name from {_ENTRIES} where e.org_name is not null)
select 'names of a number' as problem, cast(asn as varchar) as value, count(distinct org_name) as n from n group by asn having count(distinct org_name) > 1
union all select 'missing in ' || case when o.org_name is null then 'org' else 'families' end, coalesce(o.org_name, f.org_name), 1
from (select distinct org_name from org where org_name is not null) o full outer join (select distinct org_name from n) f on o.org_name = f.org_name
where o.org_name is null or f.org_name is null""")
def mapping_check(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers with several names, and names that only one side knows."""
    n = table(spark, folder, "saint_org_families").select(F.explode("asn_entries").alias("e")).select("e.asn", "e.org_name").where("org_name is not null").distinct()
    many = A.cardinality_violations(n, "asn", "org_name").select(F.lit("names of a number").alias("problem"), F.col("asn").cast("string").alias("value"), "n")
    lost = J.violations(table(spark, folder, "org").select("org_name").where("org_name is not null"), n, "org_name", "org", "families")
    return many.unionByName(lost.select(F.concat(F.lit("missing in "), "missing_in").alias("problem"), F.col("org_name").alias("value"), F.lit(1).cast("bigint").alias("n")))


@query("""
with w as (select lower(trim(pdb_name)) as k, min(pdb_id) as id from peering_org where pdb_name is not null group by 1)
select o.org_key, coalesce(nullif(trim(p.website), ''), o.website[1], 'none') as site, p.pdb_id is not null as enriched
from (select org_key, org_name, website from org) o left join w on w.k = lower(trim(o.org_name))
left join (select pdb_id, min(website) as website from peering_org group by pdb_id) p on p.pdb_id = w.id""")
def enrich_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations with the first peering row of their name; the site falls back to their own, then to none."""
    org = table(spark, folder, "org").select("org_key", F.lower(F.trim("org_name")).alias("k"), "website")
    peer = table(spark, folder, "peering_org").where("pdb_name is not null").select(F.lower(F.trim("pdb_name")).alias("k"), "pdb_id", F.col("website").alias("peer_site"))
    sites = peer.groupBy("pdb_id").agg(F.min("peer_site").alias("peer_site"))
    joined = J.enrich(org, peer.select("k", "pdb_id"), "k", "pdb_id", ["pdb_id"]).join(sites, "pdb_id", "left")
    site = F.coalesce(F.nullif(F.trim("peer_site"), F.lit("")), F.try_element_at("website", F.lit(1)), F.lit("none"))
    return joined.select("org_key", site.alias("site"), F.col("pdb_id").isNotNull().alias("enriched"))


@query("""
with b as (select event_id, user_id * 7 as low, user_id * 7 + cast(floor(value) as bigint) as high, ts from events)
select c_custkey, event_id, low, high from (
  select c_custkey, event_id, low, high, row_number() over (partition by c_custkey order by ts desc, low desc, high desc, event_id desc) as k
  from customer join b on c_custkey between low and high) where k = 1""")
def interval_block_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest number block that holds each customer's number."""
    low = F.col("user_id") * 7
    blocks = table(spark, folder, "events").select("event_id", low.alias("low"), (low + F.floor("value")).alias("high"), "ts")
    points = table(spark, folder, "customer").select("c_custkey")
    return J.latest_block(points, "c_custkey", "c_custkey", blocks, "low", "high", "ts", bin_size=64, ties=("event_id",)).select("c_custkey", "event_id", "low", "high")


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g')), ' '), lambda x: x <> ''))"
_PAIRS = f"""
with s as (select distinct p_name || ' ' || p_type as t from part), k as (select t, {_TOKENS} as w from s),
p as (select a.t as a, b.t as b, len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) as j from k a join k b on a.t < b.t)"""


@query(_PAIRS + " select a, b, round(j, 6) as similarity from p where j >= 0.5")
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of part descriptions that share half of their words."""
    s = table(spark, folder, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("t")).distinct()
    return J.jaccard_pairs(s, "t", "t", 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""
with recursive s as (select distinct p_brand as g, p_name as t from part), k as (select g, t, {_TOKENS} as w from s),
e as (select a.g, a.t as u, b.t as v from k a join k b on a.g = b.g where len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) >= 0.5),
r as (select g, u, v from e union select r.g, r.u, e.v from r join e on r.g = e.g and r.v = e.u)
select u as t, g as brand, min(v) as component from r group by u, g""")
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of alike part names inside each brand."""
    s = table(spark, folder, "part").select("p_brand", "p_name").distinct().withColumn("id", F.concat_ws("\x1f", "p_brand", "p_name"))
    pairs = J.jaccard_pairs(s, "id", "p_name", 0.5, "p_brand").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    loops = s.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    found = G.connected_components(pairs.unionByName(loops), Scratch(spark, "jaccard"))
    part = lambda c, k: F.element_at(F.split(c, "\x1f"), k)
    return found.select(part("node", 2).alias("t"), part("node", 1).alias("brand"), part("component", 2).alias("component"))


_SITE = "(select distinct org_key, lower(trim(w)) as attr from (select org_key, unnest(website) as w from org) where w is not null and lower(trim(w)) not in ('', 'n/a', 'http://', 'under construction'))"


@query(f"""
with recursive f as {_SITE}, h as (select attr, min(org_key) as hub from f group by attr),
e as (select distinct f.org_key as u, h.hub as v from f join h using (attr)), b as (select u, v from e union select v, u from e union select org_key, org_key from org),
r as (select u, v from b union select r.u, b.v from r join b on b.u = r.v)
select u as org_key, min(v) as family from r group by u""")
def shared_attr_families(spark: SparkSession, folder: str) -> DataFrame:
    """Registry rows linked by shared web sites, directly or over others."""
    rows = table(spark, folder, "org").select("org_key", F.explode_outer("website").alias("w"))
    useless = F.lower(F.trim("w")).isin("", "n/a", "http://", "under construction")
    keyed = rows.select("org_key", F.when(~useless, F.lower(F.trim("w"))).alias("attr"))
    return G.shared_attribute_families(keyed, "org_key", "attr", Scratch(spark, "families")).select(F.col("node").alias("org_key"), F.col("component").alias("family"))


_DIST = "list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_VEC = "(select vec_id, cast(embedding as double[]) as v from embeddings)"


@query(f"""
select query, neighbour, round(score, 6) as score from (
  select q.vec_id as query, r.vec_id as neighbour, {_DIST} as score, row_number() over (partition by q.vec_id order by {_DIST}, r.vec_id) as k
  from {_VEC} q join {_VEC} r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0) where k <= 10""")
def vector_knn(spark: SparkSession, folder: str) -> DataFrame:
    """Exact ten nearest vectors of every twentieth vector (the stated query set) among all."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return J.nearest_vectors(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).select("query", "neighbour", F.round("score", 6).alias("score"))


@query(f"""
select query, neighbour, round(score, 6) as score from (
  select q.vec_id as query, r.vec_id as neighbour, {_DIST} as score, row_number() over (partition by q.vec_id order by {_DIST}, r.vec_id) as k
  from {_VEC} q join {_VEC} r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0) where k = 1""")
def vector_top1(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest other vector of the query set."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return J.nearest_vectors(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 1).select("query", "neighbour", F.round("score", 6).alias("score"))


@query(f"""
select query, neighbour, round(score, 6) as score from (
  select q.vec_id as query, r.vec_id as neighbour, list_cosine_similarity(q.v, r.v) as score, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v, r.v) desc, r.vec_id) as k
  from {_VEC} q join {_VEC} r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0) where k <= 5 and score >= 0.3""")
def vector_cosine_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant neighbours by cosine of the query set."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = J.nearest_vectors(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5, "cosine").where("score >= 0.3")
    return found.select("query", "neighbour", F.round("score", 6).alias("score"))


@query("""
with l as (select distinct l_suppkey as g, l_orderkey as m, p_type as kw from lineitem join part on p_partkey = l_partkey),
s as (select g, count(distinct m) as members from l group by g)
select g, kw, count(distinct m) as supporters, members from l join s using (g) group by g, kw, members having count(distinct m) >= 0.2 * members""")
def support_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Part types that a fifth of a supplier's orders hold."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kw"))
    l = table(spark, folder, "lineitem").select("l_partkey", F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("m")).join(part, "l_partkey")  # noqa: E741
    return A.supported(l, "g", "m", "kw", 0.2)


@query("""
select l_partkey, l_suppkey, n from (select l_partkey, l_suppkey, count(*) as n, row_number() over (partition by l_partkey order by count(*) desc, l_suppkey) as k
from lineitem group by l_partkey, l_suppkey) where k = 1""")
def top_parent_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent supplier of each part, ties to the smallest."""
    return A.top_vote(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("""
select l_orderkey, l_suppkey, l_discount, case when l_discount >= l_tax and l_discount >= 0.05 then 'A' when l_tax >= 0.05 then 'B' else 'none' end as side from (
  select *, row_number() over (partition by l_orderkey order by l_discount desc, l_suppkey, l_tax) as k from (select l_orderkey, l_suppkey, l_discount, min(l_tax) as l_tax from lineitem group by all)) where k = 1""")
def best_parent(spark: SparkSession, folder: str) -> DataFrame:
    """Best-scored supplier of each order and the three-way choice between its scores."""
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_tax")  # noqa: E741
    best = A.best_parent(l, "l_orderkey", "l_suppkey", "l_discount")
    tax = l.groupBy("l_orderkey", "l_suppkey", "l_discount").agg(F.min("l_tax").alias("l_tax"))
    side = A.three_way(F.col("l_discount"), F.col("l_tax"), F.lit(0.05))
    return best.join(tax, ["l_orderkey", "l_suppkey", "l_discount"]).select("l_orderkey", "l_suppkey", "l_discount", side.alias("side"))


@query("""
with m as (select c_custkey as member, c_nationkey as g from customer), s as (select s_suppkey as member, s_nationkey + 100 as g from supplier),
l as (select distinct o_custkey as child, l_suppkey as parent from orders join lineitem on l_orderkey = o_orderkey),
sz as (select g, count(*) as n from (select * from m union all select * from s) group by g),
c as (select m.g as cg, s.g as pg, child, count(*) as k from l join m on m.member = child join s on s.member = parent group by all),
v as (select cg, pg, count(*) as k from c join sz p on p.g = pg where c.k >= 0.5 * p.n group by cg, pg)
select pg as parent_group, cg as child_group from v join sz q on q.g = cg where v.k >= 0.1 * q.n""")
def group_edge_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of suppliers that a tenth of a nation's customers buy from half of: votes with two ratios."""
    m = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("member"), F.col("c_nationkey").alias("group"))
    s = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("member"), (F.col("s_nationkey") + 100).alias("group"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("child"))
    links = table(spark, folder, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("parent")).join(o, "l_orderkey")
    edges = A.group_edges(links, m.unionByName(s), 0.5, 0.1)
    return edges.select("parent_group", "child_group")


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    """Unordered pairs of names whose latest verdict matches."""
    name = lambda c: F.lower(F.trim(c))
    j = table(spark, folder, "alias_judge").select(name("org_a_name").alias("a"), name("org_b_name").alias("b"), score_matches(F.trim("score")).alias("hit"), "judged_at", "judge_id")
    keyed = j.where("a <> '' and b <> '' and a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "judged_at", "judge_id", "hit")
    last = keyed.groupBy("src", "dst").agg(F.max(F.struct("judged_at", "judge_id", "hit")).alias("l"))
    return last.where("l.hit").select("src", "dst")


@query()
def clique_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Disjoint cliques over matched names (tested against brute force: SQL has no clique enumeration)."""
    return G.clique_cover(_matches(spark, folder), Scratch(spark, "cliques"))


_UP = "(select distinct p as src, alias_id as dst from (select alias_id, unnest(parent) as p from saint_org_families) where p is not null)"


@query(f"""
with recursive e as {_UP}, r as (select src as origin, dst as here from e union select r.origin, e.dst from r join e on e.src = r.here)
select distinct here as node from r where here in (select origin from r where origin = here) and origin = here""")
def cycle_check(spark: SparkSession, folder: str) -> DataFrame:
    """Alias groups on an ownership loop of the links that children name in any snapshot."""
    up = table(spark, folder, "saint_org_families").select(F.explode("parent").alias("src"), F.col("alias_id").alias("dst"))
    return G.loop_nodes(up, Scratch(spark, "cycles"))


@query("""
with recursive f as (select distinct snap_month, org_family_id as fam, trim(lower(regexp_replace(regexp_replace(e.org_name, '[,./]', ' ', 'g'), '\\s+', ' ', 'g'))) as k
  from (select snap_month, org_family_id, unnest(asn_entries) as e from saint_org_families) where e.org_name is not null),
h as (select k, min(fam) as hub from f group by k), e as (select distinct fam as u, hub as v from f join h using (k)),
b as (select u, v from e union select v, u from e), r as (select u, v from b union select r.u, b.v from r join b on b.u = r.v)
select u as family, min(v) as merged from r group by u""")
def name_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Families that share an organisation name, merged."""
    rows = table(spark, folder, "saint_org_families").select("org_family_id", F.explode("asn_entries.org_name").alias("n")).where("n is not null")
    keyed = rows.select("org_family_id", T.merge_key(F.col("n")).alias("k"))
    return G.merge_by_name(keyed, "org_family_id", "k", Scratch(spark, "merge")).select(F.col("node").alias("family"), F.col("component").alias("merged"))


_P = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
_PS = rf"""list_filter(list_transform(regexp_extract_all(content, '{_P}', 1), lambda x: trim(regexp_replace(x, '<[^<>]*>', ' ', 'g'))), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= 15)"""


@query(f"""
select page_id, max(list_aggregate({_PS}, 'string_agg', chr(10))) as body from clean_individual_html where content is not null group by page_id
having max(list_aggregate({_PS}, 'string_agg', chr(10))) <> ''""")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of at least 15 words of every page, whatever attributes and inner markup they have."""
    inner = F.transform(F.regexp_extract_all("content", F.lit(_P), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^<>]*>", " ")))
    rows = table(spark, folder, "clean_individual_html").where("content is not null").select("page_id", F.array_join(F.filter(inner, lambda x: long_enough(x)), "\n").alias("body"))
    return rows.groupBy("page_id").agg(F.max("body").alias("body")).where("body <> ''")


@query()
def page_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph, listing and table parts of every page (a parser's work; tested on fixtures)."""
    return S.page_parts(table(spark, folder, "clean_individual_html"), "page_id", "content").distinct()


@query("""
select doc_id, k as chunk_no, substr(text, cast(k * 270 + 1 as bigint), 300) as chunk
from (select doc_id, text, unnest(generate_series(0, greatest(cast(ceil((length(text) - 30) / 270.0) as bigint), 1) - 1)) as k from documents where length(text) > 0)""")
def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 300 characters, 30 shared, over every text."""
    return S.fixed_chunks(table(spark, folder, "documents"), "doc_id", "text")


@query()
def recursive_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks cut at paragraphs, lines and blanks (recursive; tested on fixtures)."""
    return S.recursive_chunks(table(spark, folder, "documents"), "doc_id", "text")


_MENTION = """lower(trim(trim(regexp_replace(m, '[<>:"/\\\\|?*,;]', '', 'g'))))""".replace("\\\\\\\\", "\\\\")


@query(f"""
select mention, doc_id, k as rank from (
  select mention, doc_id, row_number() over (partition by mention order by doc_id) as k from (select distinct {_MENTION} as mention, doc_id from (select doc_id, unnest(mentions) as m from documents) where m is not null)
  where mention in (select {_MENTION} from (select distinct org_name as m from org where org_name is not null))) where k <= 10""")
def mention_index(spark: SparkSession, folder: str) -> DataFrame:
    """First ten documents that mention each registry organisation (a top-k report)."""
    postings = table(spark, folder, "documents").select(F.explode("mentions").alias("m"), "doc_id").where("m is not null").select(T.mention_key(F.col("m")).alias("mention"), "doc_id").distinct()
    wanted = table(spark, folder, "org").select(T.mention_key(F.col("org_name")).alias("mention")).where("mention is not null")
    return J.lookup_mentions(postings, wanted, "mention", "doc_id", 10).select("mention", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("""
with j as (select distinct lower(trim(org_a_name)) as a, lower(trim(org_b_name)) as b from alias_judge where trim(org_a_name) <> '' and trim(org_b_name) <> ''),
p as (select distinct lower(trim(m)) as m, doc_id from (select doc_id, unnest(mentions) as m from documents) where m is not null),
c as (select a, b, doc_id, 0 as side from j join p on p.m = b union all select a, b, doc_id, 1 from j join p on p.m = a),
f as (select a, b, doc_id, min(side) as side from c group by a, b, doc_id)
select a, b, doc_id, side, rank from (select *, row_number() over (partition by a, b order by side, doc_id) as rank from f) where rank <= 6""")
def context_merge(spark: SparkSession, folder: str) -> DataFrame:
    """At most six documents of context for each judged pair, the second name's first."""
    pair = table(spark, folder, "alias_judge").select(F.lower(F.trim("org_a_name")).alias("a"), F.lower(F.trim("org_b_name")).alias("b")).where("a <> '' and b <> ''").distinct()
    posts = table(spark, folder, "documents").select(F.explode("mentions").alias("x"), "doc_id").where("x is not null").select(F.lower(F.trim("x")).alias("m"), "doc_id").distinct()
    # Six of each mention are enough: whatever the other side repeats, six different ones are left.
    rank = F.row_number().over(Window.partitionBy("m").orderBy("doc_id"))
    posts = posts.withColumn("k", rank).where("k <= 6").drop("k")
    side = lambda c: pair.join(posts, F.col(c) == F.col("m")).select("a", "b", "doc_id", F.col("doc_id").alias("o"))
    merged = J.merge_context(side("b"), side("a"), ["a", "b"], "doc_id", "o", 6)
    return merged.select("a", "b", "doc_id", "side", F.col("rank").cast("bigint").alias("rank"))


@query("""
with s as (select distinct lower(trim(m)) as mention, source, kind from (select unnest(mentions) as m, source, kind from documents) where m is not null),
old as (select * from s where kind = 'peering'), fresh as (select * from s where kind is distinct from 'peering')
select mention, source, kind from old union all select f.mention, f.source, f.kind from fresh f""")
def snippet_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The store of peering snippets with the content keys it lacks of all others."""
    rows = table(spark, folder, "documents").select(F.explode("mentions").alias("m"), "source", "kind").where("m is not null").select(F.lower(F.trim("m")).alias("mention"), "source", "kind")
    keys = ["mention", "source", "kind"]
    store = sinks.upsert_snippets(None, rows.where("kind = 'peering'"), keys)
    return sinks.upsert_snippets(store, rows, keys).select(*keys)


@query("""
select event_id, cast(json_extract_string(props, '$.k') as double) as k, event_type from events where json_extract_string(props, '$.k') is not null""")
def json_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores inside answers that wrap a JSON object in prose."""
    answer = F.concat(F.lit("Answer: "), "props", F.lit(" }"))
    rows = table(spark, folder, "events").select("event_id", "event_type", first_json_object(answer).alias("o"))
    return rows.select("event_id", F.get_json_object("o", "$.k").try_cast("double").alias("k"), "event_type").where("k is not null")


@query("""
select user_id, count(*) as answers, count(distinct event_type) as kinds from events group by user_id having bool_and(coalesce(value, 0) >= 0)""")
def pair_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Users all of whose answers are valid: one bad answer discards the user."""
    rows = table(spark, folder, "events")
    return rows.groupBy("user_id").agg(F.count("*").alias("answers"), F.count_distinct("event_type").alias("kinds"), F.bool_and(F.coalesce("value", F.lit(0.0)) >= 0).alias("ok")).where("ok").drop("ok")


@query("""
with j as (select lower(trim(org_a_name)) as a, lower(trim(org_b_name)) as b, trim(score) as s from alias_judge),
w as (select distinct least(a, b) as a, greatest(a, b) as b from j where a is not null and b is not null), d as (select distinct least(a, b) as a, greatest(a, b) as b from j where try_cast(s as double) is not null)
select a, b from w where not exists (select 1 from d where d.a = w.a and d.b = w.b)""")
def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that have no judgement with a number yet, in either order."""
    j = table(spark, folder, "alias_judge").select(F.lower(F.trim("org_a_name")).alias("a"), F.lower(F.trim("org_b_name")).alias("b"), F.trim("score").try_cast("double").alias("s"))
    return J.resume_pairs(j.where("a is not null and b is not null"), j.where("s is not null"), "a", "b")


@query("""
with m as (select distinct alias_id, e.asn as asn from (select alias_id, snap_month, unnest(asn_entries) as e from saint_org_families) where snap_month = (select max(snap_month) from saint_org_families))
select x.alias_id, x.asn as a, y.asn as b from m x join m y on x.alias_id = y.alias_id and x.asn < y.asn""")
def pair_enumeration(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of numbers in an alias group of the last snapshot."""
    f = table(spark, folder, "saint_org_families").select("snap_month", "alias_id", "asn_entries")
    last = f.agg(F.max("snap_month")).first()[0]
    m = f.where(F.col("snap_month") == F.lit(last)).select("alias_id", F.explode("asn_entries.asn").alias("asn"))
    return J.pairs_within(m, "asn", "alias_id")


@query("""
with f as (select alias_id, snap_month, parent, asn_entries from saint_org_families where snap_month = (select max(snap_month) from saint_org_families)),
m as (select distinct alias_id, e.asn as asn from (select alias_id, unnest(asn_entries) as e from f)), l as (select distinct p, alias_id as c from (select alias_id, unnest(parent) as p from f) where p is not null)
select distinct x.asn as parent_member, y.asn as child_member from l join m x on x.alias_id = l.p join m y on y.alias_id = l.c where x.asn <> y.asn""")
def parent_child_product(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered pairs of numbers over linked alias groups of the last snapshot."""
    f = table(spark, folder, "saint_org_families").select("snap_month", "alias_id", "parent", "asn_entries")
    last = f.agg(F.max("snap_month")).first()[0]
    now = f.where(F.col("snap_month") == F.lit(last))
    m = now.select("alias_id", F.explode("asn_entries.asn").alias("asn")).distinct()
    edges = now.select(F.explode("parent").alias("p"), F.col("alias_id").alias("c")).where("p is not null").distinct()
    return J.pairs_across(m, "asn", "alias_id", edges, "p", "c")


_PARTS = " or ".join(f"contains(lower(coalesce(n, '')), '{p}')" for p in BLOCKED_PARTS)


@query(f"""
select org_key, ({_PARTS} or lower(n) in ({_list([x.lower() for x in BLOCKED_NAMES])})) as blocked, n in ({_list(REPORTED_NAMES)}) as reported
from (select org_key, coalesce(org_name, '') as n from org)""")
def blacklist_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each organisation's links are blocked or were reported."""
    n = F.coalesce("org_name", F.lit(""))
    return table(spark, folder, "org").select("org_key", blocked(n, n).alias("blocked"), reported(n, n).alias("reported"))


_INST = " and ".join(f"not contains(lower(o), '{w}')" for w in INSTITUTION_WORDS)


@query(f"""
select distinct o as org_name, a as attribute from (select org_name as o, lower(unnest(aka)) as a from org where org_name is not null)
where length(trim(a)) >= 4 and len(string_split(trim(a), ' ')) >= 2 and a not in ({_list(STOP_ATTRIBUTES)}) and {_INST}""")
def stop_list_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Other names of organisations that may link them."""
    rows = table(spark, folder, "org").select("org_name", F.explode("aka").alias("a")).where("org_name is not null").select("org_name", F.lower("a").alias("attribute"))
    return rows.where(usable_attribute(F.col("attribute"), F.col("org_name"))).distinct()


_MEMBERS = """(select distinct {c} as cluster, e.asn as asn from (select snap_month, alias_id, org_family_id, unnest(asn_entries) as e from saint_org_families)
  where snap_month = (select {f}(snap_month) from saint_org_families) and e.asn is not null)"""


def _members(spark: SparkSession, folder: str, cluster: str, which: str) -> DataFrame:
    f = table(spark, folder, "saint_org_families").select("snap_month", cluster, "asn_entries")
    month = f.agg(F.max("snap_month") if which == "max" else F.min("snap_month")).first()[0]
    return f.where(F.col("snap_month") == F.lit(month)).select(F.col(cluster).alias("cluster"), F.explode("asn_entries.asn").alias("asn")).where("asn is not null").distinct()


_SIG = "select cluster, list_sort(list(distinct asn)) as sig, count(distinct asn) as n from {t} group by cluster"
_COVER = """select count(distinct x.cluster) as a, coalesce(sum(case when y.n > 1 then 1 else 0 end), 0) as b, coalesce(sum(case when y.n = 1 then 1 else 0 end), 0) as c, coalesce(sum(y.n), 0) as d
  from (select p.cluster as pc, q.cluster as qc, count(*) as m from {p} p join {q} q using (asn) group by all) z join s{q} y on y.cluster = z.qc join s{p} x on x.cluster = z.pc where z.m = y.n and x.n > y.n"""


@query(f"""
with o as {_MEMBERS.format(c='org_family_id', f='max')}, t as {_MEMBERS.format(c='alias_id', f='max')}, so as ({_SIG.format(t='o')}), st as ({_SIG.format(t='t')}),
c1 as ({_COVER.format(p='o', q='t')}), c2 as ({_COVER.format(p='t', q='o')})
select (select count(distinct asn) from o where asn in (select asn from t)) as common, (select count(*) from so) as our_clusters, (select count(*) from so where n > 1) as our_multi, (select round(avg(n), 6) from so) as our_mean,
 (select count(*) from st) as their_clusters, (select count(*) from st where n > 1) as their_multi, (select round(avg(n), 6) from st) as their_mean,
 (select count(*) from so where n > 1 and sig in (select sig from st)) as identical_multi,
 c1.a as our_covering, c1.b as our_multi_covered, c1.c as our_single_covered, c1.d as our_members_covered, c2.a as their_covering, c2.b as their_multi_covered, c2.c as their_single_covered, c2.d as their_members_covered from c1, c2""")
def partition_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Families against alias groups of the last snapshot."""
    return E.compare_partitions(_members(spark, folder, "org_family_id", "max"), _members(spark, folder, "alias_id", "max"), "cluster", "asn")


@query(f"""
with t as (select cluster as org, asn from {_MEMBERS.format(c='org_family_id', f='min')}), c as {_MEMBERS.format(c='alias_id', f='max')},
s as (select org, count(*) as truth_size from t group by org), m as (select org, cluster, count(*) as n from t join c using (asn) group by all),
b as (select org, cluster, n, row_number() over (partition by org order by n desc, cluster) as k from m)
select s.org, s.truth_size, b.cluster as best_cluster, coalesce(b.n, 0) as overlap, round(coalesce(b.n, 0) / s.truth_size, 6) as recall from s left join b on b.org = s.org and b.k = 1""")
def recall_best_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the first snapshot's families by the last one's alias groups."""
    truth = _members(spark, folder, "org_family_id", "min").withColumnRenamed("cluster", "org")
    return E.best_cluster_recall(truth, _members(spark, folder, "alias_id", "max"), "org", "cluster", "asn")


@query(f"""
with a0 as {_MEMBERS.format(c='alias_id', f='min')}, b0 as {_MEMBERS.format(c='alias_id', f='max')}, a as (select * from a0 where asn in (select asn from b0)), b as (select * from b0 where asn in (select asn from a0)),
sa as ({_SIG.format(t='a')}), sb as ({_SIG.format(t='b')}), ia as (select distinct sig from sa), ib as (select distinct sig from sb), i as (select sig from ia intersect select sig from ib)
select (select count(distinct asn) from a) as common, (select count(*) from ia) as families_a, (select count(*) from ib) as families_b, (select count(*) from i) as identical,
 (select count(distinct asn) from a join sa using (cluster) where sig not in (select sig from i)) as changed_members,
 round((select count(*) from i) / ((select count(*) from ia) + (select count(*) from ib) - (select count(*) from i)), 6) as jaccard""")
def snapshot_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Alias groups of the first and last snapshot."""
    return E.stability(_members(spark, folder, "alias_id", "min"), _members(spark, folder, "alias_id", "max"), "cluster", "asn")


@query("""
with p as (select contains(lower(explanation), 'same') or contains(lower(explanation), 'one operating') as g, try_cast(trim(score) as double) > 0.6 as p from alias_judge where explanation is not null),
n as (select count(*) filter (g and p) as tp, count(*) filter (not g and p) as fp, count(*) filter (g and not p) as fn, count(*) filter (not g and not p) as tn, count(*) filter (p is null) as failed, count(*) as total from p)
select tp, fp, fn, tn, round(100 * tp / nullif(tp + fp, 0), 2) as precision, round(100 * tp / nullif(tp + fn, 0), 2) as recall, round(200 * tp / nullif(2 * tp + fp + fn, 0), 2) as f1,
 round(100 * (tp + tn) / nullif(tp + fp + fn + tn, 0), 2) as accuracy, round(100 * failed / total, 2) as failure_rate from n""")
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Scores against the verdict that the explanation gives in words."""
    e = F.lower("explanation")
    rows = table(spark, folder, "alias_judge").where("explanation is not null").select((e.contains("same") | e.contains("one operating")).alias("g"), (F.trim("score").try_cast("double") > 0.6).alias("p"))
    return E.confusion(rows, "g", "p").drop("mean_latency", "pairs_per_second")


@query("""
with m as (select distinct lower(trim(org_name)) as member, lower(trim(org_name))[1] as cluster from org where org_name is not null),
w as (select lower(trim(org_a_name)) as a, lower(trim(org_b_name)) as b, max(try_cast(trim(score) as double)) as w from alias_judge group by all),
j as (select x.cluster = y.cluster as same, w.w from w join m x on x.member = w.a join m y on y.member = w.b where w.w is not null)
select round(coalesce(sum(case when same then 1 - w else 0 end), 0), 4) as inside, round(coalesce(sum(case when not same then w else 0 end), 0), 4) as across,
 round(coalesce(sum(case when same then 1 - w else w end), 0), 4) as loss from j""")
def cluster_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of clustering judged names by their first letter."""
    n = F.lower(F.trim("org_name"))
    m = table(spark, folder, "org").where("org_name is not null").select(n.alias("member"), F.substring(n, 1, 1).alias("cluster")).distinct()
    w = table(spark, folder, "alias_judge").groupBy(F.lower(F.trim("org_a_name")).alias("a"), F.lower(F.trim("org_b_name")).alias("b")).agg(F.max(F.trim("score").try_cast("double")).alias("w")).where("w is not null")
    return A.cluster_loss(w, m).select(*(F.round(c, 4).alias(c) for c in ("inside", "across", "loss")))


@query("""
with m as (select distinct l_partkey, l_suppkey from lineitem), s as (select l_suppkey, count(*) as n from m group by 1)
select l_partkey, l_suppkey from (select l_partkey, m.l_suppkey, row_number() over (partition by l_partkey order by n desc, m.l_suppkey) as k from m join s using (l_suppkey)) where k = 1""")
def multi_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Each part at the supplier with most parts."""
    return A.one_group_each(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("""
with f as (select alias_id, snap_month, min(org_family_id) as org_family_id from saint_org_families group by all), l as (select max(snap_month) as m from saint_org_families),
e as (select distinct alias_id, u.asn as asn, u.as_name as as_name, u.org_name as org_name, u.rir as rir from (select alias_id, unnest(asn_entries) as u from saint_org_families where snap_month = (select m from l))),
p as (select distinct alias_id as c, unnest(parent) as p from saint_org_families where snap_month = (select m from l)),
x as (select f.alias_id, org_family_id, (select count(*) from e where e.alias_id = f.alias_id) as entries, (select count(*) from p where c = f.alias_id and p is not null) as parents, (select count(*) from p where p = f.alias_id) as children
 from f where snap_month = (select m from l))
select * from x""")
def public_records(spark: SparkSession, folder: str) -> DataFrame:
    """Relational tables of the last snapshot, nested again; sizes of each record's lists."""
    f = table(spark, folder, "saint_org_families").select("snap_month", "alias_id", "org_family_id", "asn_entries", "parent")
    last = f.agg(F.max("snap_month")).first()[0]
    t = sinks.relational_tables(f.where(F.col("snap_month") == F.lit(last)))
    alias = t["org_alias_table"].groupBy("alias_id").agg(F.min("org_family_id").alias("org_family_id"))
    nested = sinks.public_records(t["as_table"], alias, t["alias_relationships"].where("parent_alias_id is not null"))
    size = lambda c: F.size(c).cast("bigint")
    return nested.select("alias_id", "org_family_id", size("asn_entries").alias("entries"), size("parent").alias("parents"), size("children").alias("children"))


@query("""
with f as (select distinct snap_month, alias_id, parent, children from saint_org_families),
u as (select distinct snap_month, p, alias_id as c from (select snap_month, alias_id, unnest(parent) as p from f) where p is not null),
d as (select distinct snap_month, alias_id as p, c from (select snap_month, alias_id, unnest(children) as c from f) where c is not null)
select snap_month, 'parent doesn''t name child' as problem, p || '>' || c as value from u where not exists (select 1 from d where d.snap_month = u.snap_month and d.p = u.p and d.c = u.c)
union all select snap_month, 'child doesn''t name parent', p || '>' || c from d where not exists (select 1 from u where d.snap_month = u.snap_month and d.p = u.p and d.c = u.c)""")
def link_symmetry(spark: SparkSession, folder: str) -> DataFrame:
    """Links that only one end names, in each snapshot."""
    f = table(spark, folder, "saint_org_families").select("snap_month", "alias_id", "parent", "children")
    return publish.check_links(f, ("snap_month",))


@query("""
select count(*) filter (part = 0) as first_half, count(*) filter (part = 1) as second_half, max(k) filter (part = 0) < min(k) filter (part = 1) as ordered
from (select org_name as k, cast(floor((row_number() over (order by org_name) - 1) / ceil((select count(distinct org_name) from org where org_name is not null) / 2.0)) as integer) as part from (select distinct org_name from org where org_name is not null))""")
def work_split(spark: SparkSession, folder: str) -> DataFrame:
    """Organisation names dealt into two contiguous halves."""
    names = table(spark, folder, "org").select("org_name").where("org_name is not null").distinct()
    halves = A.contiguous_split(names, "org_name", 2)
    first, second = F.col("part") == 0, F.col("part") == 1
    return halves.agg(
        F.count(F.when(first, 1)).alias("first_half"), F.count(F.when(second, 1)).alias("second_half"),
        (F.max(F.when(first, F.col("org_name"))) < F.min(F.when(second, F.col("org_name")))).alias("ordered"),
    )


@query("""
select date_trunc('day', ts) as start, event_type, count(*) as count from events group by all""")
def windowed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each day and type; the same plan runs on a stream with a watermark."""
    from orgweave.streaming.ingest import windowed_counts

    rows = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = windowed_counts(rows, "ts", "event_type")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "count")


@query("""
select src.source, string_agg(kind || ':' || n, '|' order by n desc, kind) as kinds from (select source, kind, count(*) as n from documents where kind is not null group by all) src group by src.source""")
def org_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of documents of each source, most frequent first."""
    return T.histogram_text(table(spark, folder, "documents").where("kind is not null").select("source", "kind"), ["source"], "kind", "kinds")
