"""Queries that run the pipeline's stages through their operators: registry objects, mapping, relations, filters, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions import predicates as P
from orgweave.operators import aggregates as A
from orgweave.operators import cluster as C
from orgweave.operators import evaluate as E
from orgweave.operators import publish, resolve, scoring
from orgweave.operators.snapshots import union_all
from orgweave.plans import reference_queries as R
from orgweave.session import Scratch
from orgweave.sources import rpsl, sinks
from orgweave.tables import table

QUERIES: dict[str, R.Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def register(f: R.Query) -> R.Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _records(spark: SparkSession, folder: str, registry: str) -> DataFrame:
    """Raw records of one registry, made of the suppliers: a number, an organisation, a block and a contact for each."""
    r = rpsl.REGISTRIES[registry]
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_phone" if "s_phone" in table(spark, folder, "supplier").columns else F.lit("1").alias("s_phone"))
    text = lambda *parts: F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    number = {"ASHandle": text("AS", k), "ASNumber": text(k, " - ", k + 1), "ASName": F.array("s_name"), "OrgID": text("ORG-", n)} if registry == "arin" else {
        "aut-num": text("AS", k), "as-name": F.array("s_name"), "org": text("ORG-", n), "descr": text("Supplier ", k)}
    org = {"OrgID": text("ORG-", k), "OrgName": F.array("s_name")} if registry == "arin" else {"organisation": text("ORG-", k), "org-name": F.array("s_name")}
    contact = {r.contact_classes[0]: text("C", k), ("OfficePhone" if registry == "arin" else "phone"): text("+", k)}
    block = {"as-block": text("AS", k * 10, " - AS", k * 10 + 9), "remarks": F.array(F.lit(f"assigned by {registry}"))}
    made = [number, org, contact, *([block] if r.block_class else [])]
    rows = [s.select(F.lit(i).cast("bigint").alias("record_id"), F.lit("").alias("file"), F.create_map(*(x for key, v in m.items() for x in (F.lit(key), v))).alias("attributes")) for i, m in enumerate(made)]
    return union_all(rows)


def _each(spark: SparkSession, folder: str, parse) -> DataFrame:
    return union_all([parse(_records(spark, folder, name), name) for name in rpsl.REGISTRIES])


_RIRS = "(select unnest(['afrinic','ripe','apnic','arin','jpirr','lacnic']) as rir)"


@query(f"""
select rir, cast(s_suppkey + d as bigint) as asn, s_name as as_name, case when rir in ('jpirr', 'lacnic') then null else 'org-' || s_nationkey end as org_id,
  case when rir = 'arin' then 0 else 1 end as described
from supplier, {_RIRS} r, (select unnest([0, 1]) as d) x where d = 0 or rir = 'arin'""")
def registry_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of all six registries; one registry lists ranges."""
    return _each(spark, folder, rpsl.as_objects).select(
        "rir", "asn", F.try_element_at("as_name", F.lit(1)).alias("as_name"), F.try_element_at("org_id", F.lit(1)).alias("org_id"), F.size("description").alias("described"))


@query(f"""
select rir, 'org-' || s_suppkey as org_id, s_name as org_name from supplier, {_RIRS} r where rir not in ('jpirr', 'lacnic')""")
def registry_organisations(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations of the registries that have such objects."""
    return _each(spark, folder, rpsl.org_objects).select("rir", F.try_element_at("org_id", F.lit(1)).alias("org_id"), F.try_element_at("org_name", F.lit(1)).alias("org_name"))


@query(f"""
select rir, '+' || s_suppkey as phone from supplier, {_RIRS} r""")
def registry_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts of all registries."""
    return _each(spark, folder, rpsl.contact_objects).select("rir", F.try_element_at("phone", F.lit(1)).alias("phone"))


@query(f"""
select rir, cast(s_suppkey * 10 as bigint) as low, cast(s_suppkey * 10 + 9 as bigint) as high, rir as assigned_to from supplier, {_RIRS} r where rir in ('afrinic', 'ripe', 'apnic')""")
def registry_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Number blocks of the registries that have such objects."""
    return _each(spark, folder, rpsl.as_blocks).select("rir", "low", "high", "assigned_to")


@query("""
with o as (select o_orderkey % 5000 as asn, o_orderstatus as rir, o_orderdate as t, o_custkey from orders),
b as (select event_id * 40 as low, event_id * 40 + 39 as high, ts, event_id, case event_id % 3 when 0 then 'O' when 1 then 'F' else 'P' end as assigned_to from events where event_id * 40 < 5000),
w as (select asn, assigned_to from (select k.asn, assigned_to, row_number() over (partition by k.asn order by ts desc, low desc, high desc) as n from (select distinct asn from o) k join b on k.asn between low and high) where n = 1),
x as (select o.asn, rir, t, row_number() over (partition by o.asn order by coalesce(o.rir = w.assigned_to, false) desc, t desc, rir) as n from (select distinct asn, rir, t from o) o left join w on w.asn = o.asn)
select asn, rir, t as changed_time from x where n = 1""")
def resolved_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Of a number's objects that of the registry which its latest block names, else the one changed last."""
    o = table(spark, folder, "orders").select((F.col("o_orderkey") % 5000).alias("asn"), F.col("o_orderstatus").alias("rir"), F.col("o_orderdate").alias("changed_time")).distinct()
    low, third = F.col("event_id") * 40, F.col("event_id") % 3
    b = table(spark, folder, "events").where(low < 5000).select(low.alias("low"), (low + 39).alias("high"), F.col("ts").alias("changed_time"), F.when(third == 0, "O").when(third == 1, "F").otherwise("P").alias("assigned_to"))
    return resolve.resolve_conflicts(o, b).select("asn", "rir", "changed_time")


_LAST = "(select * from saint_org_families where snap_month = (select max(snap_month) from saint_org_families))"
_OBJECTS = f"(select e.asn as asn, min(e.as_name) as as_name, min(e.org_name) as d, max(e.rir) as rir from (select unnest(asn_entries) as e from {_LAST}) where e.asn is not null group by 1)"
_PEERED = f"""(select o.*, case when asn % 3 = 0 then 'Feed ' || asn % 50 end as feed, case when asn % 3 < 2 and asn % 40 < 30 then 'Peer ' || asn % 40 end as peer,
  case when asn % 3 < 2 then 'aka ' || asn % 7 end as net_aka, case when asn % 3 < 2 and asn % 40 < 30 then 'http://p' || asn % 40 end as site from {_OBJECTS} o)"""
_MAPPED = rf"""(select *, trim(regexp_replace(regexp_replace(coalesce(feed, peer, case when rir = 'apnic' and regexp_matches(d, '^[a-zA-Z]') then d end, as_name), '[,.|/\;]', '', 'g'), '\s+', ' ', 'g')) as name from {_PEERED})"""


def _map(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, folder, "saint_org_families").select("snap_month", "asn_entries")
    last = f.agg(F.max("snap_month")).first()[0]
    e = f.where(F.col("snap_month") == F.lit(last)).select(F.explode("asn_entries").alias("e")).select("e.*").where("asn is not null")
    one = e.groupBy("asn").agg(F.min("as_name").alias("as_name"), F.min("org_name").alias("description"), F.max("rir").alias("rir"))
    objects = one.select("asn", F.array_compact(F.array("as_name")).alias("as_name"), F.array_compact(F.array("description")).alias("description"), F.array().cast("array<string>").alias("org_id"), "rir")
    asn, text = F.col("asn"), lambda word, m: F.concat(F.lit(word), (F.col("asn") % m).cast("string"))
    feed = objects.where(asn % 3 == 0).select("asn", text("Feed ", 50).alias("org_name"))
    net = objects.where(asn % 3 < 2).select("asn", text("net ", 9).alias("name"), (asn % 40).alias("org_id"), F.lit(None).cast("string").alias("notes"), text("aka ", 7).alias("aka"), F.lit(None).cast("string").alias("website"))
    org = spark.range(30).select("id", F.concat(F.lit("Peer "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("http://p"), F.col("id").cast("string")).alias("website"))
    return resolve.map_organisations(resolve.attach_registry_org(objects, objects), feed, org, net)


@query(rf"""
select asn, name as org_name, rir from {_MAPPED} where name <> ''""")
def as_to_org(spark: SparkSession, folder: str) -> DataFrame:
    """Organisation of every number: by feed, then peering database, then description or AS name."""
    return _map(spark, folder)[1].select("asn", "org_name", "rir")


@query(rf"""
with m as (select * from {_MAPPED} where name <> ''), v as (select name, peer as x, 'aka' as k from m where peer <> name union select name, net_aka, 'aka' from m where net_aka is not null union select name, site, 'site' from m where site is not null)
select n.name as org_name, coalesce((select string_agg(x, '|' order by x) from v where v.name = n.name and k = 'aka'), '') as aka, coalesce((select string_agg(x, '|' order by x) from v where v.name = n.name and k = 'site'), '') as website
from (select distinct name from m) n""")
def mapped_organisations(spark: SparkSession, folder: str) -> DataFrame:
    """The organisations that numbers are mapped to, with the other names and sites that the peering database adds."""
    return _map(spark, folder)[0].select("org_name", F.array_join("aka", "|").alias("aka"), F.array_join("website", "|").alias("website"))


_J = "(select judge_id, trim(org_a_name) as base, trim(org_b_name) as cand from alias_judge where trim(org_a_name) <> '' and trim(org_b_name) <> '')"


@query(f"""
with j as (select *, judge_id % 97 = 0 as bad, judge_id % 4 as m from {_J}), ok as (select base from j group by base having not bool_or(bad)),
r as (select base, cand, m, m = 1 or (m = 2 and lower(base) = lower(cand)) as up from j where base in (select base from ok))
select base, coalesce(string_agg(distinct cand, '|' order by cand) filter (m = 0), '') as alias_list, coalesce(string_agg(distinct cand, '|' order by cand) filter (m in (1, 2) and up), '') as parent_company_list,
 coalesce(string_agg(distinct cand, '|' order by cand) filter (m = 2 and not up), '') as subsidiary_list, coalesce(string_agg(distinct cand, '|' order by cand) filter (m = 3), '') as no_relationship_list from r group by base""")
def relation_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases, parents and subsidiaries of each organisation from answers in prose with JSON; one bad answer discards it."""
    base, cand, m = F.trim("org_a_name"), F.trim("org_b_name"), F.col("judge_id") % 4
    rows = table(spark, folder, "alias_judge").select("judge_id", base.alias("base"), cand.alias("cand")).where("base <> '' and cand <> ''")
    kind = F.when(F.col("judge_id") % 97 == 0, "Maybe").when(m == 0, "Alias").when(m == 3, "No_relation").otherwise("Parent/Subsidiary")
    role, parent = F.when(m == 1, "candidate").when(m == 2, "base").otherwise(""), F.when(m == 1, F.col("cand")).when(m == 2, F.col("base")).otherwise("")
    told = {"base_org_name": F.col("base"), "candidate_org_name": F.col("cand"), "reasoning for Alias": F.lit("-"), "reasoning for Parent/Subsidiary": F.lit("-"), "relationship": kind, "parent": role, "parent name": parent}
    answer = F.concat(F.lit("Here it is: "), F.to_json(F.create_map(*(x for k, v in told.items() for x in (F.lit(k), v)))), F.lit(" Done."))
    lists = scoring.collect_relations(rows.select("base", "cand", answer.alias("answer")), "base", "cand", "answer")
    return lists.select("base", *(F.array_join(c, "|").alias(c) for c in ("alias_list", "parent_company_list", "subsidiary_list", "no_relationship_list")))


@query("""
select distinct judge_id, coalesce(try_cast(trim(score) as double) > 0.6, false) as matches,
 length(org_b_name) > 2 and coalesce(1 - try_cast(trim(score) as double) < 0.1 or try_cast(trim(score) as double) >= 0.6 or contains(lower(org_a_name), lower(org_b_name))
  or list_has_any(string_split(lower(org_b_name), ' '), string_split(lower(org_a_name), ' ')), false) as relevant from alias_judge where org_a_name is not null and org_b_name is not null""")
def judged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Which judgements match, and which candidates are relevant to their base."""
    score = F.trim("score").try_cast("double")
    rows = table(spark, folder, "alias_judge").where("org_a_name is not null and org_b_name is not null")
    relevant = P.relevant_candidate(F.col("org_b_name"), F.col("org_a_name"), score, 1 - score)
    return rows.select("judge_id", P.score_matches(F.trim("score")).alias("matches"), relevant.alias("relevant")).distinct()


@query("""
with o as (select distinct lower(trim(org_name)) as n from org where org_name is not null), j as (select distinct lower(trim(org_a_name)) as a, lower(trim(org_b_name)) as b from alias_judge)
select a, b from j where a in (select n from o) and b in (select n from o)""")
def fresh_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Judged pairs of which the registry still knows both names."""
    name = lambda c: F.lower(F.trim(c))
    pairs = table(spark, folder, "alias_judge").select(name("org_a_name").alias("a"), name("org_b_name").alias("b")).distinct()
    return P.drop_stale_pairs(pairs, table(spark, folder, "org").select(name("org_name").alias("org_name")), "a", "b", "org_name")


@query("""
select doc_id, array_to_string(list_filter(mentions, lambda x, i: i % 3 <> 0 and not starts_with(x, '##')), '|') as orgs, coalesce(len(mentions) >= 2 and list_has_any(mentions, [source_org]), false) as relevant
from documents where mentions is not null""")
def snippet_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Organisation spans of each document, and whether it is relevant to its own organisation."""
    rows = table(spark, folder, "documents").where("mentions is not null")
    spans = F.transform("mentions", lambda x, i: F.struct(F.when((i + 1) % 3 == 0, "LOC").otherwise("ORG").alias("label"), x.alias("text")))
    orgs = F.array_join(F.transform(P.organisation_spans(spans), lambda s: s.text), "|")
    return rows.select("doc_id", orgs.alias("orgs"), F.coalesce(P.relevant_snippet(F.col("mentions"), F.array("source_org")), F.lit(False)).alias("relevant"))


@query("""
select source from documents where source is not null group by source having count(*) >= 8""")
def complete_organisations(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with eight fetched texts or more."""
    return P.complete_orgs(table(spark, folder, "documents").where("source is not null"), "source")


@query("""
with c as (select distinct rir, org_name, list_sort(aka) as m from org where aka is not null and org_name is not null and rir is not null and not list_contains(list_transform(aka, lambda x: x is null), true))
select rir, array_to_string(m, '|') as members from (select rir, m, row_number() over (partition by rir order by len(m) desc, list_contains(m, lower(org_name)) desc, m) as k from c) where k = 1""")
def greatest_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Of each registry the greatest cluster of other names."""
    rows = table(spark, folder, "org").where("aka is not null and org_name is not null and rir is not null").where(~F.exists("aka", lambda x: x.isNull()))
    best = A.best_cluster(rows.select("rir", "org_name", "aka"), "rir", "aka", "org_name")
    return best.select("rir", F.array_join(F.array_sort("aka"), "|").alias("members"))


@query(f"""
with q as ({R.ORACLE["recall_best_cluster"]}) select round(avg(recall), 6) as macro, round(sum(overlap) / sum(truth_size), 6) as micro from q""")
def recall_report(spark: SparkSession, folder: str) -> DataFrame:
    """Macro and micro recall of the first snapshot's families by the last one's alias groups."""
    return E.recall_summary(R.recall_best_cluster(spark, folder))


@query(f"""
with recursive f as {_LAST}, e as (select distinct u.asn as asn, u.as_name as as_name, u.rir as rir, u.org_name as org_name, alias_id from (select alias_id, unnest(asn_entries) as u from f)),
a as (select distinct org_family_id as fam, alias_id from f), l as (select distinct alias_id as c, p from (select alias_id, unnest(parent) as p from f) where p is not null),
r as (select p as origin, c as here from l union select r.origin, l.c from r join l on l.p = r.here)
select 'number repeated' as problem, cast(asn as varchar) as value from e group by asn having count(*) > 1
union all select 'alias group repeated', cast(alias_id as varchar) from a group by alias_id having count(*) > 1
union all select 'alias group missing in as_table', cast(alias_id as varchar) from (select distinct alias_id from a) where alias_id not in (select alias_id from e)
union all select 'link to unknown alias group', cast(x as varchar) from (select c as x from l union select p from l) where x not in (select alias_id from a)
union all select distinct 'on an ownership loop', cast(here as varchar) from r where origin = here
union all select 'link across families', cast(l.c as varchar) from l join a x on x.alias_id = l.c join a y on y.alias_id = l.p where x.fam <> y.fam""")
def table_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of the final tables of the last snapshot."""
    f = table(spark, folder, "saint_org_families").select("snap_month", "alias_id", "org_family_id", "asn_entries", "parent")
    last = f.agg(F.max("snap_month")).first()[0]
    t = sinks.relational_tables(f.where(F.col("snap_month") == F.lit(last)))
    return publish.check_tables(t["as_table"], t["org_alias_table"], t["alias_relationships"].where("parent_alias_id is not null"), Scratch(spark, "checks"))


@query(f"""
with f as {_LAST}, e as (select distinct alias_id, cast(u.asn as varchar) || ':' || coalesce(u.as_name, '') || ':' || coalesce(u.org_name, '') || ':' || coalesce(u.rir, '') as t from (select alias_id, unnest(asn_entries) as u from f)),
l as (select distinct alias_id as c, p from (select alias_id, unnest(parent) as p from f) where p is not null), a as (select alias_id, min(org_family_id) as fam from f group by 1)
select alias_id, fam as org_family_id, coalesce((select string_agg(t, '|' order by t) from e where e.alias_id = a.alias_id), '') as entries,
 coalesce((select string_agg(cast(p as varchar), '|' order by p) from l where c = alias_id), '') as parents, coalesce((select string_agg(cast(c as varchar), '|' order by c) from l where p = alias_id), '') as children from a""")
def published_records(spark: SparkSession, folder: str) -> DataFrame:
    """Public records of the last snapshot, nested again from the relational tables, with their whole contents."""
    f = table(spark, folder, "saint_org_families").select("snap_month", "alias_id", "org_family_id", "asn_entries", "parent")
    last = f.agg(F.max("snap_month")).first()[0]
    t = sinks.relational_tables(f.where(F.col("snap_month") == F.lit(last)))
    alias = t["org_alias_table"].groupBy("alias_id").agg(F.min("org_family_id").alias("org_family_id"))
    nested = sinks.public_records(t["as_table"], alias, t["alias_relationships"].where("parent_alias_id is not null"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.transform("asn_entries", lambda e: F.concat(e.asn.cast("string"), F.lit(":"), blank(e.as_name), F.lit(":"), blank(e.org_name), F.lit(":"), blank(e.rir)))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return nested.select("alias_id", "org_family_id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(text))), "|").alias("entries"), ids("parent").alias("parents"), ids("children").alias("children"))


@query()
def alias_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Registry organisations in alias groups by main attributes, sites and other names, merged by secondary ones (components over fuzzy clusters; tested on fixtures)."""
    scratch = Scratch(spark, "alias")
    org = table(spark, folder, "org").where("org_name is not null").select("org_name", "website", "aka")
    told = org.select(F.col("org_name").alias("base"), F.array_compact(F.coalesce("aka", F.array().cast("array<string>"))).alias("alias_list"))
    attributes = scratch.cut(C.node_attributes(org, told))
    groups = scratch.cut(C.main_alias_groups(org, attributes, scratch))
    merged = C.secondary_alias_groups(groups, attributes, scratch)
    return groups.join(merged, "alias_id").select("org_name", "alias_id", "merged_id")


@query()
def reclustered_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Registry organisations in disjoint cliques of matching judgements (SQL has no clique enumeration)."""
    return C.recluster_aliases(table(spark, folder, "org").where("org_name is not null"), table(spark, folder, "alias_judge"), Scratch(spark, "recluster"))


@query("""
select a as attribute, count(*) as n from (select lower(trim(unnest(aka))) as a from org) where a <> '' group by a""")
def attribute_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How many registry rows hold each other name."""
    rows = table(spark, folder, "org").select(F.explode("aka").alias("a")).select(F.lower(F.trim("a")).alias("attribute"))
    return A.keyword_counts(rows, "attribute")


@query("""
with d as (select distinct lower(trim(source_org)) as n from documents where source_org is not null)
select distinct lower(trim(org_name)) as name from org where org_name is not null and lower(trim(org_name)) not in (select n from d)""")
def missing_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Registry organisations of which no text is held."""
    name = lambda c: F.lower(F.trim(c)).alias("name")
    return A.missing_names(table(spark, folder, "org").select(name("org_name")), table(spark, folder, "documents").select(name("source_org")), "name")


@query("""
with g as (select distinct org_family_id as fam, lower(trim(e.org_name)) as n from (select org_family_id, unnest(asn_entries) as e from saint_org_families) where e.org_name is not null)
select fam, n from g where n in (select n from g group by n having count(distinct fam) = 1)""")
def telling_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that stand in one family alone."""
    rows = table(spark, folder, "saint_org_families").select(F.col("org_family_id").alias("fam"), F.explode("asn_entries.org_name").alias("n")).where("n is not null")
    return A.without_generic_names(rows.select("fam", F.lower(F.trim("n")).alias("n")).distinct(), "fam", "n")
