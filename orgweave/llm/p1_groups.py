"""Problem 1: one group name for all organisation names linked by pairwise verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm.grid_components import name_groups
from orgweave.session import Scratch
from orgweave.tables import table

THRESHOLD = 0.6
PLAIN_DECIMAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"
#: What counts as an outer blank: all of Unicode's white space.
OUTER_BLANKS = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$"


def stripped(column: str) -> F.Column:
    """The text without outer blanks; the pattern runs only where an end isn't a plain character."""
    return F.regexp_replace(F.col(column), OUTER_BLANKS, "")


def matched_pairs(judgements: DataFrame) -> DataFrame:
    """``a, b`` (trimmed, lower case, a < b) of the pairs whose latest verdict is a match.

    Per unordered pair the row with the latest judged_at counts, then the greatest
    judge_id (null: earliest); it matches if its score, without outer blanks, is a
    plain decimal number above 0.6.  Null or blank names and names paired with
    themselves don't count.  Repeated rows are combined before the shuffle.
    """
    x, y = (F.lower(stripped(c)) for c in ("org_a_name", "org_b_name"))
    clean = judgements.select(x.alias("x"), y.alias("y"), "score", "judged_at", "judge_id").where("x <> '' and y <> '' and x <> y")
    score = stripped("score")
    value = F.when(score.rlike(PLAIN_DECIMAL), score.cast("double"))
    matches = F.coalesce(value > THRESHOLD, F.lit(False))
    keyed = clean.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "judged_at", "judge_id", matches.alias("hit"))
    last = keyed.groupBy("a", "b").agg(F.max(F.struct("judged_at", "judge_id", "hit")).alias("last"))
    return last.where("last.hit").select("a", "b")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each organisation name with a match, and the smallest name linked to it."""
    scratch = Scratch(spark, "p1")
    groups = name_groups(matched_pairs(table(spark, folder, "alias_judge")), "a", "b", scratch)
    return groups.withColumnRenamed("name", "org_name")


P1_SQL = r"""
with recursive clean as (
    select lower(trim(org_a_name, e' \t\n\r')) as x, lower(trim(org_b_name, e' \t\n\r')) as y, trim(score) as score, judged_at, judge_id
    from alias_judge),
last as (
    select least(x, y) as a, greatest(x, y) as b, arg_max(coalesce(score, ''), (judged_at, judge_id)) as score
    from clean where x <> '' and y <> '' and x <> y group by all),
pairs as (
    select a, b from last
    where regexp_full_match(score, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') and try_cast(score as double) > 0.6),
edges as (select a as u, b as v from pairs union select b, a from pairs union select a, a from pairs union select b, b from pairs),
reach as (select u as org_name, v from edges union select r.org_name, e.v from reach r join edges e on e.u = r.v)
select org_name, min(v) as group_name from reach group by org_name"""
