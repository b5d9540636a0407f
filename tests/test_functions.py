"""Scalar functions, answers and predicates on literals."""

import pytest
from pyspark.sql import functions as F

from orgweave.functions import answers, predicates
from orgweave.functions import text as T


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.normalize_name, "A, B.  C|D/E;", "A B CDE"), (T.merge_key, " Acme,Net. Inc", "acme net inc"), (T.cluster_key, "A.B: C*", "ab c"),
        (T.attribute_key, "Ácme Net-1", "cme net1"), (T.embedding_key, "Acme Co. Ltd. Networks", "acme networks"), (T.path_safe, "a/b:c", "a_b_c"),
        (T.prompt_safe, " a,b;c? ", "abc"), (T.strip_quotes, "a,'b\"", "ab"), (T.letters_key, " A1 b! ", "a b"), (T.snapshot_key, " A   B ", "a b"),
        (T.asn_digits, "AS12 34", 1234), (T.asn_digits, "none", None), (T.first_integer, "x12y3", 12), (T.integer_range, "5 - 7", [5, 6, 7]), (T.integer_range, "x", []),
        (T.registrable_domain, "https://www.Shop.example.co.uk/x", "example.co.uk"), (T.registrable_domain, "a.b.example.org", "example.org"), (T.registrable_domain, "n/a", None),
    ],
)
def test_text(spark, f, given, expected):
    assert one(spark, f(F.col("x")), x=given) == expected


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "x string")
    for f in (T.normalize_name, T.merge_key, T.embedding_key, T.asn_digits, T.registrable_domain):
        assert df.select(f(F.col("x"))).first()[0] is None


def test_jaccard(spark):
    assert one(spark, T.jaccard(T.tokens(F.lit("acme net one")), T.tokens(F.lit("acme net two")))) == 0.5
    assert one(spark, T.jaccard(T.tokens(F.lit("名")), T.tokens(F.lit("称")))) == 1.0


def test_registry_and_times(spark):
    assert one(spark, T.registry_of(F.array(F.lit("x"), F.lit("see APNIC and ripe"), F.lit("arin")))) == "ripe"
    assert one(spark, T.registry_of(F.array(F.lit("Apnic")))) == ""
    assert str(one(spark, T.latest_time(F.array(F.lit("20240102"), F.lit("bad"), F.lit("20230101")), "yyyyMMdd"))).startswith("2024-01-02")
    assert one(spark, T.only_one_class(F.array(F.lit("ASHandle"), F.lit("OrgID")), ["ASHandle", "OrgID"])) is True


def test_first_object():
    assert answers.first_object('x {"a": {"b": 1}} {"c": 2}') == '{"a": {"b": 1}}'
    for bad in (None, "", "no", "{bad}", "{", '{"a": "}'):
        assert answers.first_object(bad) is None


def test_relation(spark):
    full = '{{"base_org_name": "A", "candidate_org_name": "B", "reasoning for Alias": "", "reasoning for Parent/Subsidiary": "", "relationship": "{}", "parent": "{}", "parent name": "{}"}}'
    cases = {full.format("Alias", "", ""): ("Alias", None), full.format("Parent/Subsidiary", "candidate", "b"): ("Parent/Subsidiary", None),
             full.format("Parent/Subsidiary", "base", "b"): (None, "parent inconsistent"), full.format("x", "", ""): (None, "unknown relation"), '{"a": 1}': (None, "key missing")}
    for given, (relation, error) in cases.items():
        r = one(spark, answers.relation_of(F.col("x")), x=given)
        assert (r.relation, r.error) == (relation, error)


def test_predicates(spark):
    assert one(spark, predicates.score_matches(F.lit("0.61"))) and not one(spark, predicates.score_matches(F.lit("0.6"))) and not one(spark, predicates.score_matches(F.lit("high")))
    assert one(spark, predicates.blocked(F.lit("Ministry of X"), F.lit("y"))) and one(spark, predicates.blocked(F.lit("a"), F.lit("COMPANY"))) and not one(spark, predicates.blocked(F.lit("a"), F.lit("b")))
    assert not one(spark, predicates.usable_attribute(F.lit("acme net"), F.lit("Acme University"))) and one(spark, predicates.usable_attribute(F.lit("acme net"), F.lit("Acme")))
    assert not one(spark, predicates.usable_attribute(F.lit("pty ltd"), F.lit("Acme")))
