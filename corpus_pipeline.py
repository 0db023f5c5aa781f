"""From raw documents to packed batches: toxic texts go, of equal texts one stays, of near-equal ones one stays, texts
that hold benchmark items go, and what is left is packed. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import exact, leaks, packing, partenum, toxicity
from siftline.llm.common import documents, saved

#: Word shingles and similarity of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, the document with the smallest doc_id stays; a null doc_id always does."""
    found = partenum.jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"))
    return rows.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
