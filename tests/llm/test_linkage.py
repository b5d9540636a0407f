"""Name reading, merge-and-rematch, soft linkage."""

import itertools

import numpy as np
import pytest

from orgweave.llm import merge_rematch as R
from orgweave.llm import names as N
from orgweave.llm import p2_linkage as P
from orgweave.llm import soft_linkage as L

GENERIC = frozenset("telecom cloud bank hosting media networks".split())


@pytest.mark.parametrize(
    "name, brand, country",
    [
        ("Kirkres Poldan Deutschland GmbH", ["kirkres", "poldan"], "de"), ("ООО Зисфес Грилнир Telecom", ["zisfes", "grilnir"], ""), ("Telecom Hãlhon Sondo Ltda ME", ["halhon", "sondo"], ""),
        ("GosbronVilbon Media (dba Gosbron)", ["gosbron", "vilbon"], ""), ("Silul Mermos South Africa (Pty) Ltd", ["silul", "mermos"], "za"), ("Ltd.", [], ""),
    ],
)
def test_reading(name, brand, country):
    r = N.read_name(name, GENERIC)[0]
    assert (r.brand, r.country) == (brand, country)


def test_codes_and_sites():
    assert N.read_code("KIRKRESPOL-AS-DE") == ("kirkrespol", True, "de") and N.read_code("AS-HanmorDipon") == ("hanmordipon", False, "") and N.read_code("Hanmor-Dipon-NET")[0] == "hanmordipon"
    shared = frozenset(["pages.hostpark"])
    assert N.read_website("HTTP://www.de.gogru-galfon.com.example/en/", shared)[:3] == ("gogrugalfon", False, "de")
    assert N.read_website("https://pages.hostpark.example/gogrugal-us", shared)[:3] == ("gogrugal", True, "us")
    for bad in (None, "", "n/a", "http://", "under construction"):
        assert N.read_website(bad, shared)[0] == ""
    assert N.complete("birburdrer", ["drernor", "birbur"]) == ("birburdrernor", N.CONFIRMED)
    assert N.complete("vontronfur", ["v", "furris"]) == ("vontronfuris", N.NAMED) and N.complete("xyz", ["abcdef"])[0] == ""


def test_resolution(spark, scratch):
    records = {
        1: (["Bribil Paver Cloud Inc."], []), 2: (["Bribil Paer Cloud"], []), 3: (["x"], ["BRIBIL-PAVER-NET"]), 4: (["Bribil Paver Deutschland GmbH"], ["BRIBILPAVER-AS"]),
        5: (["Garsal Tosjun Bank"], ["GARSALTOSJUN"]), 6: (["G. Tosjun Bank"], ["GARSALTOS-US"]), 7: ([], []), 8: (["Ltd"], ["UNSPECIFIED"]),
    }
    rows = [(rid, *e) for rid, (names, codes) in records.items() for e in R.evidence_of(names, codes, [], GENERIC | {"unspecified"})]
    df = spark.createDataFrame(rows + rows[:2], R.EVIDENCE)
    groups = {}
    for r in R.resolve(df, scratch).collect():
        groups.setdefault(r.cluster, set()).add(r.rid)
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == [[1, 2, 3], [5, 6]]
    assert R.resolve(df.limit(0), scratch).count() == 0


def test_placeholders(spark):
    rows = [("UNSPECIFIED", f"n{k}") for k in range(40)] + [(f"c{k % 3}", "same") for k in range(60)] + [(None, "z")]
    df = spark.createDataFrame(rows, "code string, name string")
    assert R.placeholders(df, df["code"], "name") == ["UNSPECIFIED"]


def random_pairs(seed, nodes=14, tries=30):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, nodes, (2, tries))
    found = sorted({(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b) if x != y})
    return np.array(found).T, rng.uniform(0.3, 1, len(found))


@pytest.mark.parametrize("seed", range(6))
def test_within_one_per_cent_of_the_optimum(seed):
    (a, b), sim = random_pairs(seed)
    at, weight = L.wedges(a, b)
    y, rules = L.admm(sim, at, weight)
    assert ((0 <= y) & (y <= 1)).all() and ((0 <= rules) & (rules <= weight)).all()
    # The rules' multipliers give a bound that no truths can beat: the cost then falls apart into the pairs.
    push = np.zeros(len(a) + 1)
    for k, sign in enumerate((1, 1, -1)):
        np.add.at(push, np.where(at[:, k] >= 0, at[:, k], len(a)), sign * rules)
    cost = lambda z: L.SIMILARITY * sim * np.maximum(0, sim - z) + (L.NOTHING + push[:-1]) * z
    bound = np.min([cost(np.zeros_like(sim)), cost(sim), cost(np.ones_like(sim))], axis=0).sum() - rules.sum()
    found = L.objective(y, sim, at, weight)
    assert bound <= found <= bound * 1.01
    assert found < L.objective(sim, sim, at, weight)


def test_soft_logic(spark, scratch):
    pairs = [(2, 101, 0.9), (4, 103, 0.55), (6, 105, 0.95), (6, 107, 0.6), (8, 109, 0.9), (8, 10, 0.9), (10, 109, 0.2), (12, 111, 0.9), (12, 113, 0.9)]
    df = spark.createDataFrame(pairs, "a long, b long, sim double")
    y = {(r.a, r.b): r.confidence for r in L.solve(df, scratch).collect()}
    assert len(y) == len(pairs) and y[(2, 101)] == pytest.approx(0.9, abs=0.01) and y[(4, 103)] == pytest.approx(0.55, abs=0.01)
    assert y[(6, 105)] > 0.9 and y[(6, 107)] < 0.1, "of two that contradict each other the likelier one"
    assert y[(10, 109)] > 0.7, "the ends of a chain match"
    assert y[(12, 111)] + y[(12, 113)] <= 1.01, "two equals share"
    assert L.solve(df.limit(0), scratch).count() == 0


def test_a_component_of_any_size_is_solved_alike(spark, scratch):
    (a, b), sim = random_pairs(3, 5, 5)
    df = spark.createDataFrame([(int(x), int(y), float(s)) for x, y, s in zip(a, b, sim)], "a long, b long, sim double")
    near = {(r.a, r.b): r.confidence for r in L.solve(df, scratch).collect()}
    spread = {(r.a, r.b): r.confidence for r in L.solve_spread(df, scratch, 0.02).collect()}
    cost = [L.objective(np.array([y[(int(p), int(q))] for p, q in zip(a, b)]), sim, *L.wedges(a, b)) for y in (near, spread)]
    assert near.keys() == spread.keys() and cost[1] == pytest.approx(cost[0], rel=0.1)


def test_similarity_is_graded():
    read = lambda names, sites=(): (lambda e: ({k: t for k, t, *_ in e}, e[0][2] if e else "", frozenset(e[0][4].split()) if e else frozenset()))(
        R.evidence_of(names, [], [N.read_website(s, frozenset()) for s in sites], GENERIC))
    same = P.alike(read(["Kirkres Poldan Telecom"]), read(["Kirkres Poldan Telecom"]))
    typo = P.alike(read(["Kirkres Poldan"]), read(["Kirkres Podlan"]))
    far = P.alike(read(["Kirkres Poldan"]), read(["Tarmin Folgar"]))
    assert same[0] > typo[0] > 0.6 and far == (0.0, True) and not typo[1]
    assert P.alike(read(["Kirkres Poldan Deutschland"]), read(["Kirkres Poldan"]))[1], "a subsidiary is an organisation of its own"
    assert P.alike(read(["Kirkres Poldan Bank"]), read(["Kirkres Poldan Cloud"]))[0] < same[0]
    sites = read(["Kirkres Poldan"], ["http://kirkrespoldan.net.example"]), read(["Kirkres Poldan"], ["www.otherwise.com.example"])
    assert P.alike(*sites)[1] and P.alike(sites[0], sites[0])[0] == 0.99
    assert P.alike(({}, "", frozenset()), read(["Kirkres Poldan"])) == (0.0, False), "nothing to compare is no contradiction"
    assert [P.errors("abcd", x) for x in ("abcd", "abdc", "abc", "axcd", "abxyz", "zzzzzzz")] == [0, 1, 1, 1, 3, 3]


def test_linkage_of_tables(spark, tmp_path):
    org = [
        (1, "Kirkres Poldan Telecom", None, ["http://www.kirkrespoldan.net.example/"], "ripe", 0), (1, "Kirkres Poldan Telecom", None, ["http://www.kirkrespoldan.net.example/"], "ripe", 0),
        (2, "Kirkres Poldan Deutschland GmbH", [None, ""], [], "ripe", 0), (3, None, None, None, None, 0), (4, "", [], ["n/a", None], None, 0), (5, "カルホンニンモル株式会社", ["Karhon Ninmor Co."], None, "apnic", 0),
    ]
    peer = [
        (1001, "Kirkres Podlan Telecom", None, "kirkrespoldan.net.example/en", "DE", 0), (1002, "カルホンニンモル", "", None, None, 0), (1003, "Karhon Ninmor", None, "", "JP", 0),
        (1004, None, None, None, None, 0), (1005, "x" * 3000, "-", "http://", None, 0), (1001, "Kirkres Podlan Telecom", None, "kirkrespoldan.net.example/en", "DE", 0),
    ]
    kinds = "org_key long, org_name string, aka array<string>, website array<string>, rir string, confidence int", "pdb_id long, pdb_name string, aka string, website string, country string, confidence int"
    frames = spark.createDataFrame(org, kinds[0]), spark.createDataFrame(peer, kinds[1])
    for name, df in zip(("org", "peering_org"), frames):
        df.write.parquet(f"{tmp_path}/a/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    found = [tuple(r) for r in P.p2_found(spark, f"{tmp_path}/a").collect()]
    assert sorted(found) == [(1, 1001), (5, 1002), (5, 1003)]
    assert P.p2_found(spark, f"{tmp_path}/b").count() == 0


def test_evidence_never_fails():
    odd = ["", " ", "�", "株式会社", "a" * 5000, "()", "- ", "\x00", "İ", "the", "1 2"]
    for a, b in itertools.product(odd, odd):
        R.evidence_of([a, b], [b], [N.read_website(a, frozenset())], GENERIC)


def groups_of(spark, scratch, records):
    rows = [(rid, *e) for rid, (names, codes) in records.items() for e in R.evidence_of(names, codes, [], GENERIC)]
    groups = {}
    for r in R.resolve(spark.createDataFrame(rows, R.EVIDENCE), scratch).collect():
        groups.setdefault(r.cluster, set()).add(r.rid)
    return sorted(map(sorted, groups.values()))


def test_spellings_that_fit_each_other_merge(spark, scratch):
    # Each of the three is one typing error from both others; 11 fits two brands that don't fit each other.
    records = {1: (["Kuspo Kilsol"], []), 2: (["Kupo Kilsol"], []), 3: (["Kuso Kilsol"], []), 9: (["Tarmin Folgar"], [])}
    records |= {10: (["Barde Monlis"], ["BARDEMONLIS-AS"]), 11: (["Barte Monlis"], []), 12: (["Barte Molis"], ["BARTEMOLIS-AS"])}
    assert groups_of(spark, scratch, records) == [[1, 2, 3], [9], [10], [11], [12]]


def test_rounds_go_on_until_nothing_merges(spark, scratch):
    # Each spelling is one typing error from the next alone, and a round merges only at the two ends.
    first, last = "bcdfghjklmnpqrs", "tvwxzbcdfghjklm"
    chain = [last[:k] + first[k:] for k in range(len(first) + 1)]
    rows = [(k, word, N.NAMED, "", "", "") for k, word in enumerate(chain)]
    got = R.resolve(spark.createDataFrame(rows, R.EVIDENCE), scratch).collect()
    assert len(got) == len(chain) and len({r.cluster for r in got}) == 1


def test_one_organisation_with_a_third_of_the_names(spark):
    syllables = ["bar", "dil", "fon", "gus", "hel", "jor", "kim", "lat"]
    brands = [f"{a}{b} {c}{a}" for a in syllables for b in syllables for c in syllables[:4]]
    kinds = ["telecom", "cloud", "networks", "hosting"]
    spelled = [f"{w[:k] + x + w[k + 1:]} kilsolnar {kind}" for w in ["kuspordan"] for k in range(9) for x in "aeo" for kind in kinds]
    spelled += [f"kuspordan {w[:k] + w[k + 1:]} {kind}" for w in ["kilsolnar"] for k in range(9) for kind in kinds]
    names = [(f"{b} {kinds[k % 4]}", "UNSPECIFIED") for k, b in enumerate(brands)] + [(n, "KUSPORDANKILSOLNAR-AS") for n in spelled]
    df = spark.createDataFrame(names, "name string, code string").distinct()
    generic = N.generic_words(df.select("name").distinct(), "name")
    assert set(kinds) <= generic and not generic & {"kuspordan", "kilsolnar"}
    assert R.placeholders(df, df["code"], "name", generic) == ["UNSPECIFIED"]


def test_nodes_of_one_record_stay_out_of_the_graph(spark, scratch, monkeypatch):
    links = spark.createDataFrame([(k, f"own{k}") for k in range(50)] + [(1, "x"), (2, "x"), (3, "x"), (3, "y"), (9, "y"), (9, "y"), (7, "z"), (7, "z")], "rid long, node string")
    records = spark.createDataFrame([(k,) for k in range(52)], "rid long")
    graphs, whole = [], R.grid_components
    monkeypatch.setattr(R, "grid_components", lambda edges, s: graphs.append(edges.count()) or whole(edges, s))
    got = R.clusters_of(links, records, scratch).collect()
    members = {}
    for r in got:
        members.setdefault(r.cluster, set()).add(r.rid)
    assert len(got) == 52 and sorted(map(sorted, members.values())) == sorted([[1, 2, 3, 9], *([k] for k in range(52) if k not in (1, 2, 3, 9))])
    assert graphs and graphs[0] <= 5, "only records that share a node are edges"


def test_blocks_and_initials_are_compiled(spark):
    keys = ["mortelnet", "brelkantis", "krolvunda", "strbrelmo", "abcdefghij", "aeiou", "x", "", "krbrdrte"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    told = {r.key: r.i for r in df.select("key", R._initials("key").alias("i")).collect()}
    assert told == {k: R.initials(k) for k in keys}
    blocked = df.select("key", R._thirds("key"))
    plan = blocked.select("*", R._initials("key"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan, "functions over lambdas are interpreted, row by row"
    of = lambda words: {k: {r.block for r in spark.createDataFrame([(k,)], "key string").select(R._thirds("key")).collect()} for k in words}
    word = "brelkantis"
    found = of([word, word[1:], word[:4] + word[5:], word[:-1], word + "x", "brelkxntis", "rbelkantis"])
    assert all(found[word] & blocks for blocks in found.values())
