"""Scalar functions over names and texts, as Column expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.wordlists import REGISTRIES, TWO_LABEL_SUFFIXES

MAX_SNIPPET_CHARS = 60_000


def normalize_name(c: Column) -> Column:
    """Drop , . | / \\ ; and collapse blanks; case stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[,.|/\;]", ""), r"\s+", " "))


def merge_key(c: Column) -> Column:
    """Name under which families are merged: , . / become blanks, lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, r"[,./]", " "), r"\s+", " ")))


def cluster_key(c: Column) -> Column:
    """Lower case without commas, dots and characters unsafe in paths."""
    return F.trim(F.regexp_replace(F.lower(c), r'[,.<>:"/\\|?*]', ""))


def attribute_key(c: Column) -> Column:
    """Lower case ASCII letters, digits and blanks only."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""))


def embedding_key(c: Column) -> Column:
    """``attribute_key`` without company forms, blanks collapsed."""
    bare = F.regexp_replace(F.lower(c), r"\b(inc|llc|ltd|corp|company|co)\b\.?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9 ]+", ""), r"\s+", " "))


def path_safe(c: Column) -> Column:
    """Unsafe characters become underscores; not injective, so only for display."""
    return F.regexp_replace(c, r'[<>:"/\\|?*]', "_")


def prompt_safe(c: Column) -> Column:
    """Unsafe characters, commas and semicolons dropped."""
    return F.trim(F.regexp_replace(c, r'[<>:"/\\|?*,;]', ""))


def mention_key(c: Column) -> Column:
    """One canonical key for storing and looking up mentions."""
    return F.lower(F.trim(prompt_safe(c)))


def strip_quotes(c: Column) -> Column:
    """Without commas and quotes."""
    return F.translate(c, ",\"'", "")


def letters_key(c: Column) -> Column:
    """ASCII letters and blanks only, lower case: the form in which answers' names are compared."""
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z ]", "")))


def snapshot_key(c: Column) -> Column:
    """Blanks collapsed, lower case: the form in which snapshots are compared."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def starts_with_letter(c: Column) -> Column:
    return c.rlike("^[a-zA-Z]")


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")


def integer_range(c: Column) -> Column:
    """``a - b`` as the array a..b, a single number as [a], anything else as []."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    low, high = F.try_element_at(numbers, F.lit(1)), F.coalesce(F.try_element_at(numbers, F.lit(2)), F.try_element_at(numbers, F.lit(1)))
    return F.when(low.isNull() | (low > high), F.array().cast("array<bigint>")).otherwise(F.sequence(low, high))


def asn_digits(c: Column) -> Column:
    """All digit runs joined, as a number; null without digits."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def changed_email(entries: Column) -> Column:
    """Of each entry its first word, where that holds an at sign."""
    words = F.transform(entries, lambda x: F.regexp_extract(x, r"^(\S+@\S+)", 1))
    return F.filter(words, lambda x: x != "")


def latest_time(entries: Column, pattern: str) -> Column:
    """Latest of the entries that parse by ``pattern``; null if none does."""
    return F.array_max(F.transform(entries, lambda x: F.try_to_timestamp(x, F.lit(pattern))))


def registry_of(lines: Column) -> Column:
    """Registry named by the first line that names one; lines are searched in order, all lower or all upper case."""
    def named(x: Column) -> Column:
        return reduce(lambda rest, r: F.when(x.contains(r) | x.contains(r.upper()), r).otherwise(rest), reversed(REGISTRIES), F.lit(""))

    return F.coalesce(F.try_element_at(F.filter(F.transform(lines, named), lambda x: x != ""), F.lit(1)), F.lit(""))


def only_one_class(keys: Column, classes: list[str]) -> Column:
    """Whether a record has exactly one class key; ARIN's handle pair counts as one."""
    present = F.array_intersect(keys, F.array(*map(F.lit, classes)))
    pair = (F.size(present) == 2) & F.array_contains(present, "ASHandle") & F.array_contains(present, "OrgID")
    return (F.size(present) == 1) | pair


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays (sets); two empty sets are alike (1.0)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def tokens(c: Column) -> Column:
    """Distinct blank-separated tokens of ``attribute_key``."""
    return F.array_distinct(F.filter(F.split(attribute_key(c), " "), lambda x: x != ""))


def registrable_domain(url: Column) -> Column:
    """Host's registered name: public suffix (of one label, or two of the packaged list) and one label before it."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:/*)?(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    parts = F.split(host, r"\.")
    n = F.size(parts)
    last2 = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), ".")
    keep = F.when(last2.isin(TWO_LABEL_SUFFIXES), 3).otherwise(2)
    return F.when((host == "") | (n < 2), None).otherwise(F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), 3), "."))


def acquisition_text(month: Column, text: Column) -> Column:
    """Text tagged with its month, at most 60000 characters."""
    return F.substring(F.concat(F.lit("["), month, F.lit("] "), text), 1, MAX_SNIPPET_CHARS)


def content_key(*columns: Column) -> Column:
    """64-bit content key; nulls and field borders count."""
    return F.xxhash64(*(part for c in columns for part in (c.isNull(), c)))


def without_generic(values: Column, stop: list[str]) -> Column:
    return F.array_except(values, F.array(*map(F.lit, stop)))


def all_blank(values: Column) -> Column:
    return F.forall(values, lambda x: F.trim(x) == "")


def canonical_set(values: Column) -> Column:
    """Sorted distinct values: one form for equal sets."""
    return F.array_sort(F.array_distinct(values))


def aka_snippet(org: Column, aka: Column) -> Column:
    """Sentence by which an "also known as" enters the snippet store."""
    return F.concat(org, F.lit(" is also known as "), aka, F.lit("."))


def fill_template(template: str, **columns: Column) -> Column:
    """``{name}`` places of a template filled from columns."""
    text = F.lit(template)
    for name, c in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), c)
    return text


def histogram_text(df: DataFrame, group: list[str], value: str, alias: str = "orgs") -> DataFrame:
    """Per group ``value:count`` joined by ``|``, most frequent first, then by name."""
    counts = df.groupBy(*group, value).count()
    rows = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v"))))
    return counts.groupBy(*group).agg(F.array_join(F.transform(rows, lambda x: F.concat(x.v, F.lit(":"), (-x.n).cast("string"))), "|").alias(alias))
