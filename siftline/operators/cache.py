"""Hashes kept from earlier runs: own, by path, size and mtime; imported, by file id and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose cached hash still holds: same size and mtime."""
    return files.join(cache.select("path", "size", "mtime_ns", "hash"), ["path", "size", "mtime_ns"])


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    return files.join(cache.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_anti")


def imported(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with a hash from another tool's cache, which may keep it by whole length or by a prefix it covers.

    Of the lengths size, 4096 and 16384 (those last two where the file is no longer), the first that is found counts,
    if the entry's length and mtime in milliseconds are the file's. Digests of two algorithms must not be mixed.
    """
    tries = F.filter(
        F.array(F.struct(F.lit(0).alias("turn"), F.col("size").alias("chunk_len")), *(F.when(F.col("size") <= n, F.struct(F.lit(k).alias("turn"), F.lit(n).cast("long").alias("chunk_len"))) for k, n in ((1, 4096), (2, 16384)))),
        lambda x: x.isNotNull(),
    )
    asked = files.withColumn("try_", F.explode(tries)).withColumn("chunk_len", F.col("try_.chunk_len"))
    held = cache.where("chunk_pos = 0").select("dev", "ino", "chunk_len", "modified_ms", "file_len", "hash")
    met = asked.join(held, ["dev", "ino", "chunk_len"]).groupBy(*files.columns).agg(F.min_by(F.struct("modified_ms", "file_len", "hash"), "try_.turn").alias("e"))
    valid = (F.col("e.file_len") == F.col("size")) & (F.col("e.modified_ms") == F.floor(F.col("mtime_ns") / 1_000_000))
    return met.where(valid).select(*files.columns, F.col("e.hash").alias("hash"))


def updated(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows in place of older ones with their path."""
    return cache.join(fresh.select("path"), "path", "left_anti").select("path", "size", "mtime_ns", "hash").unionByName(fresh.select("path", "size", "mtime_ns", "hash"))
