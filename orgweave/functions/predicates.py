"""Filters over names, snippets and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.wordlists import BLOCKED_NAMES, BLOCKED_PARTS, INSTITUTION_WORDS, REPORTED_NAMES, STOP_ATTRIBUTES

MIN_PARAGRAPH_WORDS = 15
SCORE_THRESHOLD = 0.6


def long_enough(text: Column, words: int = MIN_PARAGRAPH_WORDS) -> Column:
    """At least so many blank-separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")) >= words


def usable_attribute(attribute: Column, org_name: Column) -> Column:
    """At least 4 characters and 2 words, not a stop attribute, and the organisation isn't an institution."""
    barred = F.lower(org_name).rlike("|".join(w.replace("(", r"\(").replace(")", r"\)") for w in INSTITUTION_WORDS))
    enough = (F.length(F.trim(attribute)) >= 4) & (F.size(F.split(F.trim(attribute), " ")) >= 2)
    return ~barred & enough & ~attribute.isin(STOP_ATTRIBUTES)


def blocked(a: Column, b: Column) -> Column:
    """Whether a pair has a blocked part in either name or a blocked name, whatever the case."""
    either = lambda c: F.lower(c).rlike("|".join(BLOCKED_PARTS)) | F.lower(c).isin([n.lower() for n in BLOCKED_NAMES])
    return either(a) | either(b)


def reported(a: Column, b: Column) -> Column:
    """Whether users reported either organisation's links."""
    return a.isin(REPORTED_NAMES) | b.isin(REPORTED_NAMES)


def drop_stale_pairs(pairs: DataFrame, names: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Pairs of which both names still exist."""
    known = names.select(F.col(name).alias("_n")).where("_n is not null").distinct()
    return pairs.join(known.withColumnRenamed("_n", a), a, "left_semi").join(known.withColumnRenamed("_n", b), b, "left_semi")


def relevant_candidate(candidate: Column, base: Column, cosine: Column, known_distance: Column) -> Column:
    """Longer than 2 characters and near a known organisation, like the base, part of it or sharing a word with it."""
    shares = F.arrays_overlap(F.split(F.lower(candidate), " "), F.split(F.lower(base), " "))
    near = (known_distance < 0.1) | (cosine >= 0.6) | F.contains(F.lower(base), F.lower(candidate)) | shares
    return (F.length(candidate) > 2) & F.coalesce(near, F.lit(False))


def relevant_snippet(mentions: Column, relevant: Column) -> Column:
    """At least two mentions, one of them relevant."""
    return (F.size(mentions) >= 2) & F.arrays_overlap(mentions, relevant)


def organisation_spans(spans: Column) -> Column:
    """Of tagged spans (struct label, text) the organisations that aren't word fragments."""
    return F.filter(spans, lambda x: (x.label == "ORG") & ~x.text.startswith("##"))


def complete_orgs(files: DataFrame, org: str, least: int = 8) -> DataFrame:
    """Organisations with at least so many fetched files; the others are fetched again."""
    return files.groupBy(org).count().where(F.col("count") >= least).select(org)


def score_matches(score: Column, threshold: float = SCORE_THRESHOLD) -> Column:
    """Strictly above the threshold; what isn't a number doesn't match."""
    return F.coalesce(score.try_cast("double") > threshold, F.lit(False))
