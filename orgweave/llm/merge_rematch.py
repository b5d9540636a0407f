"""Merge-and-rematch resolution of records that carry several spellings.

Records that share a trusted brand key (and national marker) are merged; a
merged profile holds the union of its members' spellings, initials and codes.
Profiles that could not be placed by an exact key re-enter blocking against the
richer profiles, by cut brands, by initials and by one typing error, and are
merged with the profile that fits best, or with all that fit equally well if
those also fit each other.  Rounds go on until nothing merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm import names as N
from orgweave.llm.grid_components import grid_components
from orgweave.session import Scratch

#: Cut brands shorter than this fit too many profiles to say anything.
LEAST_CUT = 6
#: A code or host that goes with this share of all names (and with so many) says nothing about whose it is.
SHARED_SHARE, SHARED_LEAST = 0.001, 25
_ONSET = regex.compile(r"([bcdfghjklmnpqrstvwxyz]*?)([bdfgkptc]r|[bcdfghjklmnpqrstvwxyz])[aeiou]")

EVIDENCE = "rid bigint, key string, trust int, country string, cc string, rest string"


def initials(brand: str) -> str:
    """The first letters of a brand's syllables, by which it is abbreviated."""
    return "".join(m.group(2)[0] for m in _ONSET.finditer(brand))


def evidence_of(texts: list[str], codes: list[str], sites: list[tuple[str, bool, str, str]], generic: frozenset[str]) -> list[tuple[str, int, str, str, str]]:
    """(key, trust, country, cc, rest) that a record's names, codes and web sites give together.

    ``country`` is the national marker of the record's names ("" if none), ``cc``
    what a cut code ends in, ``rest`` the generic words by which two profiles of
    one brand are told apart.
    """
    told = [(t, N.read_name(t, generic)) for t in texts]
    readings = [r for _, rs in told for r in rs]
    country = next((r.country for r in readings if r.country), "") or next((c for _, _, c, _ in sites if c), "")
    rest = " ".join(sorted(frozenset().union(*(r.rest for r in readings)))) if readings else ""
    out: dict[str, int] = {}
    cc = ""

    def add(k: str, trust: int) -> None:
        if k and "?" not in k and out.get(k, -1) < trust:
            out[k] = trust

    for r in readings:
        if r.native:
            add("n:" + r.native, N.CONFIRMED)
    named = [r.brand for r in readings if len(r.brand) == 2 and min(map(len, r.brand)) >= 2]

    def add_cut(cut: str) -> None:
        done = [N.complete(cut, r.brand) for r in readings if r.brand]
        for whole, trust in done:
            add(whole, trust)
        if len(cut) >= LEAST_CUT and not any(trust == N.CONFIRMED for _, trust in done):
            add("p:" + cut, N.PARTIAL)

    for code in codes:
        whole, cut, tail = N.read_code(code)
        cc = cc or tail
        if len(whole) >= 5 and whole not in generic:
            add_cut(whole) if cut else add(whole, N.CODE)
    for whole, cut, _, _ in sites:
        if len(whole) >= 5 and cut:
            add_cut(whole)
        elif len(whole) >= 5:
            longer = [b for b in (N.key("".join(b)) for b in named) if whole.startswith(b) and len(whole) - len(b) <= 6]
            add(max(longer, key=len, default=whole), N.CODE)
    for t, rs in told:
        if rs and len(rs[0].brand) < 2 and not rs[0].native:
            text = " ".join(N.words_of(t))
            if len(text) >= 8:
                add("t:" + text, N.NAMED)
    for brand in named:
        add(N.key("".join(brand)), N.NAMED)
        add(N.key("".join(reversed(brand))), N.PARTIAL)
        add("".join(brand), N.PARTIAL)
    for r in readings:
        if len(r.brand) == 1:
            word = N.key(r.brand[0])
            word = word[:-3] if word.endswith("net") and len(word) >= 9 else word
            if len(word) >= 8:
                add(word, N.PARTIAL)
            if len(word) >= LEAST_CUT:
                add("p:" + word, N.PARTIAL)
            elif 3 <= len(word) <= 5 and not set(word) & set("aeiou"):
                add("i:" + word, N.PARTIAL)
    return [(k, t, country, cc, rest) for k, t in out.items()]


def has_part(value: str, name: str, generic: frozenset[str]) -> bool:
    """Whether a code or host holds the first or last four letters of a brand word of the name."""
    whole = "".join(N.words_of(value))
    words = [w for w in N.words_of(name) if len(w) >= 4 and w not in generic and w not in N.LEGAL]
    return any(w[:4] in whole or w[-4:] in whole for w in words)


def placeholders(rows: DataFrame, value: F.Column, name: str, generic: frozenset[str] = frozenset(), total: int | None = None) -> list[str]:
    """Values that go with very many different names of which they hold nothing: placeholders, shared hosts.

    Spellings of one organisation hold parts of its code, however many they are.  At most 1 / share of them.
    ``total`` is the number of different names (null counts as one), if it is known.
    """
    total = rows.select(name).distinct().count() if total is None else total
    least = max(SHARED_LEAST, SHARED_SHARE * total)
    pairs = rows.select(value.alias("value"), F.col(name).alias("name")).where("value <> ''")
    # What stands in so few rows has no more names; the others are few.
    many = pairs.groupBy("value").count().where(F.col("count") >= least).select("value")
    pairs = pairs.join(F.broadcast(many), "value", "left_semi").distinct()
    often = [r.value for r in pairs.groupBy("value").count().where(F.col("count") >= least).collect()]
    if not often:
        return []
    shared = rows.sparkSession.sparkContext.broadcast(generic)

    def strangers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v for v, n in zip(*(c.to_pylist() for c in batch.columns)) if not has_part(v, n or "", shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    counts = pairs.where(F.col("value").isin(often)).mapInArrow(strangers, "value string").groupBy("value").count()
    return [r.value for r in counts.where(F.col("count") >= least).collect()]


def exact_links(evidence: DataFrame) -> DataFrame:
    """``rid, node``: each record with the keys that place it: its trusted ones, or the names' where it has none."""
    best = evidence.groupBy("rid").agg(F.max("trust").alias("best"), F.max("country").alias("marker"))
    keyed = evidence.where("trust > 0").join(best, "rid").where((F.col("trust") >= N.CONFIRMED) | (F.col("best") <= N.NAMED) | F.col("key").like("t:%"))
    return keyed.select("rid", F.concat_ws("|", "key", "marker").alias("node"))


def clusters_of(links: DataFrame, records: DataFrame, scratch: Scratch) -> DataFrame:
    """``rid, cluster`` of all records under their links to nodes.

    A node ties its records to the smallest of them; most have one record and tie nothing, so they are left out of the graph.
    """
    hashed = scratch.cut(links.select("rid", F.xxhash64("node").alias("node")))
    shared = hashed.groupBy("node").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last")
    edges = hashed.join(shared, "node").where("rid <> first").select(F.col("rid").alias("u"), F.col("first").alias("v"))
    roots = grid_components(edges, scratch).select(F.col("v").alias("rid"), "root")
    clusters = scratch.cut(records.join(roots, "rid", "left").select("rid", F.coalesce("root", "rid").alias("cluster")))
    scratch.drop(hashed)
    return clusters


def rematch(profile: DataFrame, open_: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b`` clusters to merge: open profiles with the one that fits best, or with all of the best if each fits each."""
    found = scratch.cut(fits(profile, open_))
    most = found.groupBy("a").agg(F.max("weight").alias("weight"))
    best = found.join(most, ["a", "weight"]).select("a", "b")
    counted = scratch.cut(best.join(best.groupBy("a").agg(F.count("*").alias("n")), "a"))
    several = counted.where("n > 1")
    either = found.select(F.col("a").alias("b"), F.col("b").alias("c")).unionByName(found.select("b", F.col("a").alias("c"))).distinct()
    # Whoever is one of n that fit each other has n neighbours at least, so few are left to be looked at in pairs.
    degree = either.groupBy("b").agg(F.count("*").alias("degree"))
    likely = several.join(degree, "b").groupBy("a", "n").agg(F.min("degree").alias("least")).where("least >= n").select("a")
    several = several.join(likely, "a", "left_semi")
    triples = several.join(either, "b").join(several.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi")
    whole = triples.groupBy("a", "n").agg(F.count("*").alias("pairs")).where("pairs = n * (n - 1)").select("a")
    merged = scratch.cut(counted.where("n = 1").select("a", "b").unionByName(several.join(whole, "a", "left_semi").select("a", "b")))
    scratch.drop(found)
    scratch.drop(counted)
    return merged


def fits(profile: DataFrame, open_: DataFrame) -> DataFrame:
    """``a, b, weight``: open profiles and the profiles that fit them.

    ``profile`` and ``open_`` are (cluster, key, trust, country, cc, rest); a fit needs the same national
    marker, no contradicting code, and common generic words if both have any.
    """
    whole = profile.where("trust >= 1 and not key like '_:%' and length(key) >= 8").select("cluster", "key", "country", "ccs", "rest")
    mine = [F.col("cluster").alias("a"), F.col("key").alias("akey"), "country", F.col("cc").alias("acc"), F.col("rest").alias("arest")]
    facts = ["acc", "ccs", "arest", "rest"]
    pair = lambda df, weight: df.select("a", F.col("cluster").alias("b"), weight.alias("weight"), *facts)
    short = open_.where("key like 'p:%'").withColumn("key", F.expr("substring(key, 3)")).select(*mine)
    heads = short.withColumn("head", F.substring("akey", 1, LEAST_CUT)), whole.withColumn("head", F.substring("key", 1, LEAST_CUT))
    by_cut = pair(heads[0].join(heads[1], ["head", "country"]).where(F.startswith("key", "akey")), F.length("akey"))
    brief = open_.where("key like 'i:%' and cc <> '' and rest <> ''").withColumn("key", F.expr("substring(key, 3)")).select(*mine)
    by_initials = pair(brief.join(whole.withColumn("akey", _initials("key")), ["akey", "country"]), F.lit(1))
    typed = open_.where("trust in (0, 1) and not key like '_:%' and length(key) >= 8")
    by_typo = typed.select(*mine, _thirds("key")).join(whole.select("*", _thirds("key")), ["block", "country"])
    error = F.levenshtein("akey", "key", 2)
    swapped = F.array_sort(F.split("akey", "")) == F.array_sort(F.split("key", ""))
    by_typo = by_typo.where((F.abs(F.length("key") - F.length("akey")) <= 1) & (error.between(0, 1) | ((error == 2) & swapped)))
    by_typo = pair(by_typo, F.when(F.col("akey") == F.col("key"), 60).otherwise(5))
    found = by_cut.unionByName(by_initials).unionByName(by_typo).where("a <> b")
    found = found.where("acc = '' or ccs = '' or contains(ccs, acc)")
    found = found.where("arest = '' or rest = '' or arrays_overlap(split(arest, ' '), split(rest, ' '))")
    return found.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def _thirds(column: str) -> F.Column:
    """Blocks for one typing error, which leaves two thirds of a text as they are: the first, the last or the outer ones.

    Lengths differ by one, so there are thirds of two sizes.
    """
    text = F.col(column)
    size, other = F.expr(f"int(length({column}) div 3)"), F.expr(f"int((length({column}) - 1) div 3)")

    def blocks(n: F.Column) -> list[F.Column]:
        outer = F.concat(F.left(text, n), F.lit("|"), F.right(text, n))
        return [F.concat(F.lit("<"), F.left(text, n * 2)), F.concat(F.lit(">"), F.right(text, n * 2)), outer]

    return F.explode(F.when(size == other, F.array(*blocks(size))).otherwise(F.array(*blocks(size), *blocks(other)))).alias("block")


def _initials(column: str) -> F.Column:
    """``initials`` as a column."""
    return F.regexp_replace(column, "(?:([bdfgkptc])r|([bcdfghjklmnpqrstvwxyz]))[aeiou]|.", "$1$2")


def _union(rows: DataFrame) -> DataFrame:
    """Profiles by cluster: the union of the rows' spellings, with the profile's best trust and its codes' countries."""
    each = [F.max(c).alias(c) for c in ("trust", "country", "cc", "rest")]
    profile = rows.groupBy("cluster", "key").agg(*each)
    # The set holds country codes, so its size is bounded.
    codes = F.array_join(F.array_sort(F.collect_set(F.when(F.col("cc") != "", F.col("cc")))), " ")
    facts = rows.groupBy("cluster").agg(F.max("trust").alias("best"), codes.alias("ccs"))
    return profile.join(facts, "cluster")


def profiles(evidence: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``cluster, key, trust, country, cc, rest, best, ccs``: the union of the members' spellings."""
    placed = scratch.cut(evidence.join(clusters, "rid").drop("rid"))
    out = scratch.cut(_union(placed))
    scratch.drop(placed)
    return out


def resolve_profiles(evidence: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``rid, cluster`` of every record, the final profiles) for ``evidence`` (EVIDENCE).

    A round only moves the profiles that merge; everything else stays as it is.
    Each round but the last lowers the number of clusters, so the rounds end.
    Records without any usable key stay alone.  Empty evidence gives no rows;
    repeated rows are harmless.
    """
    evidence = scratch.cut(evidence.distinct())
    clusters = clusters_of(exact_links(evidence), evidence.select("rid").distinct(), scratch)
    profile = profiles(evidence, clusters, scratch)
    while True:
        merged = rematch(profile, profile.where(F.col("best") <= N.NAMED), scratch)
        if merged.isEmpty():
            break
        moves = grid_components(merged.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
        moves = scratch.cut(moves.where("v <> root").select(F.col("v").alias("cluster"), F.col("root").alias("to")))
        moved = F.coalesce("to", "cluster").alias("cluster")
        touched = moves.select("cluster").unionByName(moves.select(F.col("to").alias("cluster"))).distinct()
        keep = profile.join(touched, "cluster", "left_anti")
        parts = scratch.cut(profile.join(touched, "cluster", "left_semi").join(moves, "cluster", "left").select(moved, "key", "trust", "country", "cc", "rest"))
        last, profile = profile, scratch.cut(keep.unionByName(_union(parts).select(keep.columns)))
        scratch.drop(last)
        last, clusters = clusters, scratch.cut(clusters.join(moves, "cluster", "left").select("rid", moved))
        scratch.drop(last)
    return clusters, profile


def resolve(evidence: DataFrame, scratch: Scratch) -> DataFrame:
    """``rid, cluster`` of every record; see ``resolve_profiles``."""
    return resolve_profiles(evidence, scratch)[0]
