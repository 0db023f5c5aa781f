"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut where its own content says so: at the first "cut" after at least `least` code points, or after `most`.
Equal texts get equal chunks, and texts that begin or end alike share those until, or some way after, they differ. Chunks are deduplicated to identifiers that are verified:
no two chunk texts share one, else all are dealt again with another salt. A document becomes its ordered list of
identifiers, and only these lists, never the texts, are grouped and compared; equal lists mean equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import doc_id, keyed, saved

LEAST, MOST = 2048, 8192
#: A cut comes after white space that follows one of these.
CUTS = "[aeinorst.,]"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Joined again, they are the text; an empty text has none."""
    pattern = f"(?s).{{{least},{most}}}?(?<={CUTS}\\s)|.{{1,{most}}}"
    return F.when(F.length(text) <= least, F.filter(F.array(text), lambda x: x != "")).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def identifier(chunk: Column, salt: int) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{salt}:"), chunk).cast("binary")))


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """id, text_sha256, recipe: the ordered identifiers of each row's chunks, verified over all rows."""
    base = keyed(docs).select("did", "none", "text")
    cut = base.select(F.explode(chunks(F.col("text"), least, most)).alias("chunk"))
    for salt in range(100):
        # a chunk text counts once a task before it moves, and once in all after that
        distinct = cut.select(identifier(F.col("chunk"), salt).alias("id"), "chunk").groupBy("id", "chunk").agg(F.count("*").alias("n"))
        if distinct.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").isEmpty():
            break
    ids = F.transform(chunks(F.col("text"), least, most), lambda c: identifier(c, salt))
    return base.select(doc_id().alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.array_join(F.transform(ids, F.hex), "").alias("recipe"))


def exact_dedup(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical; a null text equals an empty one. The largest doc_id stays; a null
    doc_id is below all others, so it stays only among null ones. Rows that repeat both doc_id and text count in
    group_size each and are kept or dropped alike. Other columns are left out; an empty table gives no rows.
    """
    rows = saved(recipes(docs, least, most), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, "recipe").select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps; of rows that repeat doc_id and text, one."""
    rows = saved(recipes(docs, least, most), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep"))
    # the text's own SHA-256 stands for it here: a kept row is known by its doc_id and text
    kept = rows.join(groups, "recipe").where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("id", "text_sha256").agg(F.count("*").alias("times"))
    kept = saved(kept.select(F.col("id").alias("kept_id"), F.col("text_sha256").alias("kept_text"), "times"), "kept")
    all_ = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("own_text"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_text") == F.col("kept_text"))
    once = all_.join(kept.where("times = 1"), same, "left_semi")
    more = kept.where("times > 1")
    if not more.isEmpty():
        once = once.unionByName(all_.join(more, same, "left_semi").dropDuplicates(["own_id", "own_text"]))
    return once.select("row.*")
