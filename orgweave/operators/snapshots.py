"""What changed between consecutive full snapshots of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(col: Column, kind: T.DataType) -> Column:
    """A form of ``col`` that hashes alike for equal and unlike for unequal values.

    Spark's hashes skip nulls, so every nullable leaf becomes a (is-null, value)
    pair.  Arrays of structs and scalars count as sets: order, repeats and null
    elements don't matter and a null array equals an empty one.
    """
    if isinstance(kind, T.ArrayType):
        listed = F.filter(F.coalesce(col, F.array().cast(kind)), lambda x: x.isNotNull())
        return F.transform(F.array_sort(F.array_distinct(listed)), lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        leaves = [canonical(col.getField(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(kind.fields)]
        return F.struct(*leaves)
    return F.struct(col.isNull().alias("n"), col.alias("v"))


def row_hash(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of the canonical form of ``columns``."""
    forms = [canonical(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    return [F.xxhash64(F.lit(seed), *forms).alias(f"_h{seed}") for seed in (1, 2)]


def latest_rows(df: DataFrame, keys: list[str], version: str, hashes: list[Column]) -> DataFrame:
    """Per key the hashes of its row with the greatest ``version``; null versions lose.

    Only keys and hashes are shuffled, and repeats are combined before it.  Rows
    of one key and version with different contents are a tie; the greatest hash
    wins, so the result is the same on every run.
    """
    slim = df.select(*keys, version, *hashes)
    best = slim.groupBy(*keys).agg(F.max(F.struct(version, "_h1", "_h2")).alias("_best"))
    return best.select(*keys, F.col("_best._h1").alias("_h1"), F.col("_best._h2").alias("_h2"))


def snapshot_changes(df: DataFrame, key: str, snapshot: str, version: str, compared: list[str]) -> DataFrame:
    """Keys added, removed or changed in each snapshot against the one before.

    A full outer join on (key, snapshot) of every snapshot with its predecessor
    moved one snapshot on: a missing side gives ``added`` or ``removed`` and
    unequal canonical row hashes give ``changed``.

    Defined cases: rows whose key or snapshot is null are no part of a snapshot;
    an empty table or a single snapshot gives no rows; repeated rows count once;
    of several rows of a key the latest ``version`` counts; columns that are not
    named are not read.  Snapshots follow each other in the order of their
    labels, whatever the time between them.

    Result: ``snapshot, key, change_kind``.
    """
    clean = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
    rows = latest_rows(clean, [snapshot, key], version, row_hash(clean, compared))
    order = Window.orderBy("_s")
    steps = clean.select(F.col(snapshot).alias("_s")).distinct()
    steps = steps.select("_s", F.lag("_s").over(order).alias("_prev"), F.lead("_s").over(order).alias("_next"))
    now = (
        rows.join(F.broadcast(steps.where("_prev is not null").select("_s")), F.col(snapshot) == F.col("_s"))
        .select(F.col(key).alias("_k"), F.col("_s"), F.col("_h1").alias("_n1"), F.col("_h2").alias("_n2"))
    )
    before = (
        rows.join(F.broadcast(steps.where("_next is not null").select("_s", "_next")), F.col(snapshot) == F.col("_s"))
        .select(F.col(key).alias("_k"), F.col("_next").alias("_s"), F.col("_h1").alias("_o1"), F.col("_h2").alias("_o2"))
    )
    joined = now.join(before, ["_k", "_s"], "full_outer")
    kind = (
        F.when(F.col("_o1").isNull(), "added")
        .when(F.col("_n1").isNull(), "removed")
        .when((F.col("_o1") != F.col("_n1")) | (F.col("_o2") != F.col("_n2")), "changed")
    )
    return joined.select(F.col("_s").alias(snapshot), F.col("_k").alias(key), kind.alias("change_kind")).where(
        "change_kind is not null"
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)
