"""Problem 2: the same organisations in the registry and in the peering database, without a shared key.

Records of both tables are read into profiles of keys; records whose profiles
are equal are one node of a side.  Pairs of nodes that share a key, or nearly,
are candidates, whose names, other names, sites and places are compared for a
graded similarity.  Soft logic over all candidates, those inside a table
included, gives each pair its confidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm import names as N
from orgweave.llm.merge_rematch import LEAST_CUT, evidence_of, fits, initials, placeholders
from orgweave.llm.soft_linkage import solve
from orgweave.session import Scratch
from orgweave.tables import table

#: Pairs with more than this confidence are the same organisation; two that tie for a third get half each.
MATCH = 0.52
#: What a key shared by two records says, by the trust in the less trusted of its readings.
SHARED = {N.CODE: 0.99, N.CONFIRMED: 0.97, N.NAMED: 0.95, N.PARTIAL: 0.85}
#: How much less alike two records are whose own sites differ, or whose generic words do.
OTHER_SITE, OTHER_WORDS = 0.45, 0.3
#: The most that the places of two records add or take.
PLACE = 0.08
#: Both pairs of a chain must be so alike that its ends are compared too.
CHAINED = 0.5

PROFILE = "rid bigint, keys array<string>, trusts array<int>, country string, rest array<string>, place string, sig string"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``rid, names, sites, place``: both tables alike; rid is twice the key, plus 1 for the peering side.

    ``place`` is the registry's region or the peering row's country.  All rows of a key are one record.
    """
    none = F.array().cast("array<string>")
    org = table(spark, folder, "org").select(
        (F.col("org_key") * 2).alias("rid"), F.concat(F.array("org_name"), F.coalesce("aka", none)).alias("names"),
        F.coalesce("website", none).alias("sites"), F.lower(F.coalesce("rir", F.lit(""))).alias("place"),
    )
    peer = table(spark, folder, "peering_org").select(
        (F.col("pdb_id") * 2 + 1).alias("rid"), F.array("pdb_name", "aka").alias("names"), F.array("website").alias("sites"),
        F.lower(F.coalesce("country", F.lit(""))).alias("place"),
    )
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(c))))).alias(c)
    rows = org.unionByName(peer).where("rid is not null").distinct()
    return rows.groupBy("rid").agg(flat("names"), flat("sites"), F.max("place").alias("place"))


def read_profiles(rows: DataFrame, generic: frozenset[str], shared: frozenset[str]) -> DataFrame:
    """The records' keys with their trust, country marker, generic words and place (PROFILE); ``sig`` is alike if all that and the side are."""
    words = rows.sparkSession.sparkContext.broadcast((generic, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hosts = words.value
        for batch in batches:
            out = []
            for rid, names, sites, place in zip(*(c.to_pylist() for c in batch.columns)):
                read = [N.read_website(s, hosts) for s in sites if s]
                found = sorted(evidence_of([n for n in names if n and n.strip()], [], [r for r in read if r[0]], known))
                keys, trusts = [f[0] for f in found], [f[1] for f in found]
                country, rest = (found[0][2], found[0][4].split()) if found else ("", [])
                # A record without any key is like no other.
                sig = xxhash.xxh3_128_hexdigest(repr((rid & 1, keys, trusts, country, rest, place)) if found else f"r{rid}")
                out.append((rid, keys, trusts, country, rest, place, sig))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rid", "keys", "trusts", "country", "rest", "place", "sig"])

    return rows.select("rid", "names", "sites", "place").mapInArrow(run, PROFILE)


def errors(a: str, b: str, most: int = 2) -> int:
    """Typing errors between two keys (a letter more, less or other, or two swapped), at most ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def alike(p: tuple[dict[str, int], str, frozenset[str]], q: tuple[dict[str, int], str, frozenset[str]]) -> tuple[float, bool]:
    """(similarity of two profiles' names, other names and sites; whether they contradict each other).

    A profile is (key -> trust, country marker, generic words).  National markers
    that differ contradict; so do names in one script of which nothing is alike,
    and own sites whose names are not.  Profiles that have nothing to compare
    (names in two scripts) are not alike, but don't contradict.
    """
    (mine, land, words), (yours, other_land, other_words) = p, q
    if land != other_land:
        return 0.0, True
    best = max((SHARED[min(mine[k], yours[k])] if k[1:2] != ":" else 0.9 for k in mine.keys() & yours.keys() if k[:2] not in ("p:", "i:")), default=0.0)
    whole = lambda d: [k for k in d if k[1:2] != ":" and len(k) >= 8]
    full = whole(mine), whole(yours)
    near = best
    if best < SHARED[N.NAMED]:
        for a in full[0]:
            for b in full[1]:
                wrong = errors(a, b)
                if wrong <= 2:
                    near = max(near, 1 - (1.9 if wrong == 1 else 2.6) * wrong / max(len(a), len(b)))
        for cuts, wholes in ((mine, full[1]), (yours, full[0])):
            for cut in (k[2:] for k in cuts if k[:2] == "p:"):
                for b in wholes:
                    if len(cut) >= LEAST_CUT and b.startswith(cut) and b != cut:
                        near = max(near, 0.58 + 0.03 * min(len(cut), 12))
            for cut in (k[2:] for k in cuts if k[:2] == "i:"):
                near = max(near, max((0.45 for b in wholes if initials(b) == cut), default=0.0))
        for a in (k[2:] for k in mine if k[:2] == "p:"):
            for b in (k[2:] for k in yours if k[:2] == "p:"):
                if a.startswith(b) or b.startswith(a):
                    near = max(near, 0.5 + 0.02 * min(len(a), len(b), 12))
    sites = [k for k, t in mine.items() if t == N.CODE], [k for k, t in yours.items() if t == N.CODE]
    apart = bool(sites[0] and sites[1]) and all(errors(a, b) > 1 for a in sites[0] for b in sites[1])
    if apart:
        near -= OTHER_SITE
    if words and other_words and best < SHARED[N.CONFIRMED] and not words & other_words:
        near -= OTHER_WORDS * (1 - max((SequenceMatcher(None, a, b).ratio() for a in words for b in other_words), default=0.0))
    latin = [any(k[:2] not in ("n:", "t:", "i:") for k in d) for d in (mine, yours)]
    return max(0.0, near), apart or (near <= 0.0 and all(latin))


def compare(pairs: DataFrame, profiles: DataFrame, places: dict[tuple[str, str], float]) -> DataFrame:
    """``a, b, sim, apart`` of pairs of nodes ``a, b``."""
    lift = pairs.sparkSession.sparkContext.broadcast(places)
    facts = ["keys", "trusts", "country", "rest", "place"]
    side = lambda s: profiles.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in facts))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{s}" for s in "ab" for c in facts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[2:]]
            sims, aparts = [], []
            for ka, ta, ca, ra, pa_, kb, tb, cb, rb, pb in zip(*cols):
                sim, apart = alike((dict(zip(ka, ta)), ca, frozenset(ra)), (dict(zip(kb, tb)), cb, frozenset(rb)))
                if sim > 0:
                    sim = min(1.0, max(0.0, sim + lift.value.get((pa_, pb), lift.value.get((pb, pa_), 0.0))))
                sims.append(sim)
                aparts.append(apart)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64()), pa.array(aparts, pa.bool_())], ["a", "b", "sim", "apart"])

    return joined.mapInArrow(run, "a bigint, b bigint, sim double, apart boolean")


def place_evidence(exact: DataFrame, profiles: DataFrame) -> dict[tuple[str, str], float]:
    """What a region and a country together say: the log of how much oftener than by chance they meet in pairs with a common trusted key.

    At most (regions and countries) squared entries.
    """
    at = lambda s: profiles.select(F.col("node").alias(s), F.col("place").alias(f"p{s}"))
    met = exact.where("trust >= 1 and a % 2 <> b % 2").join(at("a"), "a").join(at("b"), "b").where("pa <> '' and pb <> ''")
    counts = {(r.pa, r.pb): r.n for r in met.groupBy("pa", "pb").agg(F.count("*").alias("n")).collect()}
    both: dict[tuple[str, str], int] = {}
    for (x, y), n in counts.items():
        both[min(x, y), max(x, y)] = both.get((min(x, y), max(x, y)), 0) + n
    total = sum(both.values())
    alone: dict[str, int] = {}
    for (x, y), n in both.items():
        alone[x], alone[y] = alone.get(x, 0) + n, alone.get(y, 0) + n
    # Every region and country that occurs, also pairs that never meet.
    pairs = {(min(x, y), max(x, y)) for x in alone for y in alone if (len(x) == 2) != (len(y) == 2)}
    return {(x, y): PLACE * math.tanh(math.log((both.get((x, y), 0) + 0.5) * total / (alone[x] * alone[y] + 0.5)) / 2) for x, y in pairs}


def candidates(profiles: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b, sim`` (a < b): pairs of nodes that share a key or nearly, and the ends of chains of like pairs, unless they contradict."""
    keyed = profiles.select("node", "country", F.array_join("rest", " ").alias("rest"), F.explode(F.arrays_zip("keys", "trusts")).alias("k"))
    keyed = scratch.cut(keyed.select("node", "country", "rest", F.col("k.keys").alias("key"), F.col("k.trusts").alias("trust")))
    exact = keyed.where("not key like 'p:%' and not key like 'i:%'").select("node", "key", "country", "trust")
    other = exact.withColumnsRenamed({"node": "b", "trust": "other"})
    shared = exact.withColumnRenamed("node", "a").join(other, ["key", "country"]).where("a < b").groupBy("a", "b").agg(F.max(F.least("trust", "other")).alias("trust"))
    shared = scratch.cut(shared)
    best = keyed.groupBy("node").agg(F.max("trust").alias("best"))
    blank = F.lit("")
    block = scratch.cut(keyed.join(best, "node").select(F.col("node").alias("cluster"), "key", "trust", "country", blank.alias("cc"), "rest", "best", blank.alias("ccs")))
    near = fits(block, block).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    places = place_evidence(shared, profiles)
    known = scratch.cut(compare(shared.select("a", "b").unionByName(near).distinct(), profiles, places))
    fresh = known
    while True:
        # Ends of chains with a new link; each turn compares pairs that were never compared, so turns end.
        both = lambda df: df.where(~F.col("apart") & (F.col("sim") >= CHAINED)).select(F.explode(F.array(F.struct(F.col("a").alias("mid"), F.col("b").alias("far")), F.struct(F.col("b").alias("mid"), F.col("a").alias("far")))).alias("e")).select("e.*")
        chains = both(fresh).join(both(known).withColumnRenamed("far", "end"), "mid").where("far <> end").select(F.least("far", "end").alias("a"), F.greatest("far", "end").alias("b"))
        asked = scratch.cut(chains.distinct().join(known, ["a", "b"], "left_anti"))
        if asked.isEmpty():
            break
        fresh = scratch.cut(compare(asked, profiles, places))
        known = scratch.cut(known.unionByName(fresh))
    return known.where(~F.col("apart")).select("a", "b", "sim")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """``org_key, pdb_id, confidence`` of every candidate pair."""
    scratch = Scratch(spark, "p2")
    rows = scratch.cut(records(spark, folder))
    named = rows.select(F.explode("names").alias("name")).where("name is not null").distinct()
    generic = N.generic_words(named, "name")
    sited = rows.select(F.explode("sites").alias("site"), F.try_element_at("names", F.lit(1)).alias("name"))
    host = F.regexp_extract(F.lower(F.trim("site")), r"^(?:[a-z]+:/*)?(?:www\.)?([^/?#:\s]+)", 1)
    shared = frozenset(N.read_website(h + "/", frozenset())[3] for h in placeholders(sited, host, "name", generic))
    read = scratch.cut(read_profiles(rows, generic, shared))
    first = read.groupBy("sig").agg(F.min("rid").alias("node"))
    member = scratch.cut(read.select("rid", "sig").join(first, "sig").select("rid", "node"))
    profiles = scratch.cut(read.join(first, "sig").where("rid = node").drop("rid", "sig"))
    truth = solve(candidates(profiles, scratch), scratch)
    # A node is of one side, and its rid's parity says which.
    cross = truth.where("a % 2 <> b % 2").select(F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("o"), F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("p"), F.round("confidence", 4).alias("confidence"))
    left, right = member.select(F.col("node").alias("o"), F.shiftright("rid", 1).alias("org_key")), member.select(F.col("node").alias("p"), F.shiftright("rid", 1).alias("pdb_id"))
    return cross.join(left, "o").join(right, "p").select("org_key", "pdb_id", "confidence")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that are the same organisation."""
    return matches(spark, folder).where(F.col("confidence") > MATCH).select("org_key", "pdb_id")


def p2_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate pair with its confidence."""
    return matches(spark, folder)


QUERIES = {"p2_found": p2_found, "p2_confidence": p2_confidence}
