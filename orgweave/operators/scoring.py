"""Models behind interfaces: pair scorers, embeddings, and judging with resume.

A scorer sees whole Arrow batches and may batch, thread or await its requests as
it likes; offline a deterministic rule stands in for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.answers import first_json_object, relation_of
from orgweave.operators.joins import resume_pairs

Scorer = Callable[[pd.DataFrame], list[str | None]]
Embedder = Callable[[list[str]], np.ndarray]


def rule_scorer(batch: pd.DataFrame) -> list[str]:
    """Offline scorer: Jaccard similarity of the names' words as a JSON answer."""
    out = []
    for a, b in zip(batch["org_a_name"], batch["org_b_name"]):
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        score = len(x & y) / len(x | y) if x | y else 0.0
        out.append(f'{{"score": "{score:.3f}", "explanation": "share of common words"}}')
    return out


def score_pairs(pairs: DataFrame, scorer: Scorer = rule_scorer, attempts: int = 2) -> DataFrame:
    """The pairs with the scorer's raw ``answer``; a batch that fails is tried again, then its answers are null and ``error`` says why."""
    schema = pairs.schema.simpleString()[7:-1] + ",answer:string,error:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers: list[str | None] = [None] * len(b)
            error = None
            for _ in range(attempts):
                try:
                    answers, error = list(scorer(b)), None
                    break
                except Exception as e:  # noqa: BLE001 - tried again
                    error = f"{type(e).__name__}: {e}"
            yield b.assign(answer=answers, error=error)

    return pairs.mapInPandas(run, schema)


def judge_missing(wanted: DataFrame, done: DataFrame, scorer: Scorer = rule_scorer) -> DataFrame:
    """Judgements of the wanted pairs that have none yet, in either order."""
    scored = score_pairs(resume_pairs(wanted, done, "org_a_name", "org_b_name"), scorer)
    obj = first_json_object(F.col("answer"))
    return scored.select("org_a_name", "org_b_name", F.get_json_object(obj, "$.score").alias("score"), F.get_json_object(obj, "$.explanation").alias("explanation"))


def collect_relations(answers: DataFrame, base: str, candidate: str, answer: str) -> DataFrame:
    """Per base organisation its four lists; one inconsistent answer discards the organisation, as a half-read one would mislead."""
    read = answers.select(base, candidate, relation_of(first_json_object(F.col(answer))).alias("r"))
    valid = read.groupBy(base).agg(F.bool_and(F.col("r.error").isNull()).alias("ok")).where("ok").select(base)
    rows = read.join(valid, base, "left_semi")
    is_parent = F.lower("r.parent_name") == F.lower(candidate)
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(candidate))))
    return rows.groupBy(base).agg(
        pick(F.col("r.relation") == "Alias").alias("alias_list"), pick((F.col("r.relation") == "Parent/Subsidiary") & is_parent).alias("parent_company_list"),
        pick((F.col("r.relation") == "Parent/Subsidiary") & ~is_parent).alias("subsidiary_list"), pick(F.col("r.relation") == "No_relation").alias("no_relationship_list"),
    )


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Offline embedder: normalised counts of hashed character 3-grams."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts):
        padded = f"  {(text or '').lower()} "
        for k in range(len(padded) - 2):
            row[int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=4).digest()) % size] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, text: str, embedder: Embedder = hashed_embedding) -> DataFrame:
    """The rows with an array ``vector``."""
    schema = df.schema.simpleString()[7:-1] + ",vector:array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(vector=list(embedder(b[text].fillna("").tolist())))

    return df.mapInPandas(run, schema)
