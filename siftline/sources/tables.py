"""Any table as a file table, and other sources of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.model import IMPORT_CACHE


def as_files(df: DataFrame, path: Column, content: Column, dev: Column | None = None, ino: Column | None = None, mtime_ns: Column | None = None) -> DataFrame:
    """path, size (in bytes), dev, ino, mtime_ns, content of a table's rows; each is a file of its own unless ids are given."""
    content = content.cast("binary")
    return df.select(
        path.alias("path"),
        F.octet_length(content).cast("long").alias("size"),
        (F.lit(0) if dev is None else dev).cast("long").alias("dev"),
        (F.xxhash64(path) if ino is None else ino).cast("long").alias("ino"),
        (F.lit(None) if mtime_ns is None else mtime_ns).cast("long").alias("mtime_ns"),
        content.alias("content"),
    )


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as /source/lang/doc_id.txt, with an mtime made of the id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return as_files(d, path, F.col("text"), ino=F.col("doc_id"), mtime_ns=F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") * 7919) % 1000 * 1_000_000))


def images(spark: SparkSession, root: str) -> DataFrame:
    """Images below a folder that can be decoded; others are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)


def import_cache(spark: SparkSession, path: str) -> DataFrame:
    """Another tool's hash cache, exported to Parquet or CSV."""
    reader = spark.read.schema(IMPORT_CACHE)
    return reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)
