"""Files that arrive: a stream of (path, size, mtime_ns, content) keeps a hash cache, and groups that may still grow.

A batch scan's groups are final; these are not, so they are an interface of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.model import HASH_CACHE


def hashed(stream: DataFrame) -> DataFrame:
    return stream.select("path", "size", "mtime_ns", F.sha2("content", 256).alias("hash"))


def keep(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's hashes below `folder`, in a part of its own that a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/part={number}")

    return hashed(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The hash cache: of each path the row that came last."""
    rows = spark.read.schema(HASH_CACHE + ", batch int").option("recursiveFileLookup", True).parquet(folder)
    return rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ns", "hash"), F.struct("batch", "mtime_ns")).alias("r")).select("path", "r.*")


def compacted(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """Writes the current cache as part -1 of a new folder, which can take the place of the old one while no stream runs."""
    current(spark, folder).withColumn("batch", F.lit(-1)).write.mode("errorifexists").parquet(f"{to}/part=-1")
    return current(spark, to)


def groups(cache: DataFrame) -> DataFrame:
    """size, hash, files of what is duplicated so far."""
    return cache.groupBy("size", "hash").agg(F.count("*").alias("files")).where("files > 1")
