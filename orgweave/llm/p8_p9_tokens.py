"""Problems 8 and 9: token ids of all documents, and documents packed into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm.bpe import encode_column
from orgweave.llm.packing import pack
from orgweave.operators.snapshots import union_all
from orgweave.session import Scratch
from orgweave.tables import table

TOKENIZER = "byte_bpe_50k"


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_column(table(spark, folder, "documents"), "doc_id", "text", TOKENIZER)


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document (or piece of one above the capacity) and its container, for each container size."""
    scratch = Scratch(spark, "p9")
    specs = table(spark, folder, "container_spec").dropDuplicates().collect()  # a control table: a few rows at every scale
    documents, out = table(spark, folder, "documents"), []
    for name in sorted({r.tokenizer_name for r in specs}):
        sizes = scratch.cut(encode_column(documents, "doc_id", "text", name, count_only=True))
        mine = [(r.spec_id, r.capacity_tokens) for r in specs if r.tokenizer_name == name]
        out.append(pack(sizes, "doc_id", "n_tokens", mine, scratch))
    return union_all(out)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of room used, for each container size."""
    packed = p9_packed(spark, folder)
    per = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    cap = table(spark, folder, "container_spec").select("spec_id", "capacity_tokens").distinct()
    total = per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.join(cap, "spec_id").select(
        "spec_id", "capacity_tokens", "containers", "tokens", "fullest",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )
