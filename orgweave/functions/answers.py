"""Model answers: the first JSON object in a text, relation and score validation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from orgweave.functions.wordlists import RELATION_KEYS


def first_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` block, braces in strings included; None if it is no JSON object."""
    if not text:
        return None
    depth, start = 0, -1
    for at, ch in enumerate(text):
        if ch == "{":
            depth += 1
            start = at if depth == 1 else start
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                block = text[start : at + 1]
                try:
                    return block if isinstance(json.loads(block), dict) else None
                except ValueError:
                    return None
    return None


@pandas_udf(StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """``first_object`` of each text; Arrow batches."""
    return texts.map(first_object)


def has_keys(obj: Column, keys: list[str]) -> Column:
    """Whether a JSON object has all the keys."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(obj))) == 0, F.lit(False))


def relation_of(obj: Column) -> Column:
    """``relation, parent_name, error`` of a relation answer; ``error`` is null if it is consistent."""
    get = lambda k: F.try_element_at(F.from_json(obj, "map<string,string>"), F.lit(k))
    kind, role, parent = get("relationship"), get("parent"), get("parent name")
    named = F.when(role == "candidate", get("candidate_org_name")).when(role == "base", get("base_org_name"))
    consistent = F.coalesce(F.lower(parent) == F.lower(named), F.lit(False))
    error = (
        F.when(obj.isNull(), "no object")
        .when(~has_keys(obj, RELATION_KEYS), "key missing")
        .when(kind.isin("Alias", "No_relation"), F.lit(None).cast("string"))
        .when(kind == "Parent/Subsidiary", F.when(consistent, F.lit(None).cast("string")).otherwise("parent inconsistent"))
        .otherwise("unknown relation")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, kind).alias("relation"), F.when(ok & (kind == "Parent/Subsidiary"), parent).alias("parent_name"), error.alias("error"))


def scores_of(obj: Column, keys: list[str]) -> Column:
    """The numeric fields of a judgement; null where missing or no number."""
    get = lambda k: F.try_element_at(F.from_json(obj, "map<string,string>"), F.lit(k)).try_cast("double")
    return F.struct(*(get(k).alias(k) for k in keys))
