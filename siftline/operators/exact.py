"""Exact duplicate groups of files by a funnel: size, samples, whole content, and bytes if asked for.

In tables contents are hashed where they are read and only digests are grouped. A table that has a size column is read in two
phases: first keys and sizes, then the contents of files whose size others share (`funneled`); without such a column its
contents must be read to know their sizes, and one scan hashes them all. In trees, only paths that survive a stage are read
in the next. Contents move in `verified` alone, those of groups' members. A group's files are rows of `members`; `groups`
gathers them into lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.values import samples

FILE = ["dev", "ino"]


def collapsed(files: DataFrame) -> DataFrame:
    """A row for each file id: size, dev, ino, rep_path (first in path order), aliases (how many paths)."""
    return files.groupBy("size", "dev", "ino").agg(F.min(paths.sort_key(F.col("path"))).alias("first"), F.count("*").alias("aliases")).select("size", "dev", "ino", F.col("first.path").alias("rep_path"), "aliases")


def digested(files: DataFrame, content: Column | None = None) -> DataFrame:
    """A table's files with the SHA-256 of their content instead of it."""
    content = F.col("content") if content is None else content
    return files.withColumn("digest", F.sha2(content, 256)).drop("content")


def funneled(files: DataFrame, size: str, content: Column | None = None) -> DataFrame:
    """A table's files that others share a size with, with the SHA-256 of their content instead of it.

    size: a stored column that equal contents have alike; only it and the file id are read of files that it tells apart.
    The shared sizes reach the scan of contents as a runtime filter where they are few, else by a semi-join; rows of
    contents are hashed right after it. Files of a null size are hashed.
    """
    content = F.col("content") if content is None else content
    shared = several(files.where(F.col(size).isNotNull()).select(size, *FILE), [size]).select(size)
    left = files.join(shared, size, "left_semi").unionByName(files.where(F.col(size).isNull()))
    return left.withColumn("digest", F.sha2(content, 256)).drop("content")


def several(files: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that at least two file ids share, with the numbers of ids and paths."""
    ids = files.groupBy(*keys, *FILE).agg(F.count("*").alias("paths"))
    return ids.groupBy(*keys).agg(F.count("*").alias("ids"), F.sum("paths").alias("paths")).where("ids > 1")


def members(files: DataFrame) -> DataFrame:
    """Rows of duplicate groups: group_id, path, size, dev, ino, and what else files has. Needs a digest.

    Paths of one file id are all members, but don't make a group by themselves. Empty files are a group.
    """
    shared = several(files, ["size", "digest"]).select("size", "digest")
    return files.join(shared, ["size", "digest"], "left_semi").withColumn("group_id", F.concat_ws("-", "size", "digest"))


def groups(members: DataFrame) -> DataFrame:
    """A row for each group: group_id, size, paths in order. For reports: a list holds all paths of its group."""
    key = paths.sort_key(F.col("path"))
    return members.groupBy("group_id", "size").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["path"]).alias("paths"))


def summary(files: DataFrame, members: DataFrame) -> DataFrame:
    """One row: files_scanned, bytes_scanned (each path counts), duplicate_groups, duplicate_files."""
    all_ = files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_scanned"))
    per = members.groupBy("group_id").agg(F.count("*").alias("n"))
    found = per.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_files"))
    return all_.crossJoin(F.broadcast(found))  # one row by one row


def funnel(files: DataFrame, threshold: int, sample: int) -> DataFrame:
    """How many rows and bytes reach each stage over a table with content: stage, files, bytes."""
    rows = files.select("size", *FILE, F.sha2("content", 256).alias("digest"), F.when(F.col("size") > threshold, F.sha2(samples(F.col("content"), F.col("size"), sample), 256)).alias("partial"))
    same_size = rows.join(several(rows, ["size"]).select("size"), "size", "left_semi")
    large = same_size.where(F.col("size") > threshold)
    sampled = large.join(several(large, ["size", "partial"]).select("size", "partial"), ["size", "partial"], "left_semi")
    hashed = same_size.where((F.col("size") <= threshold) & (F.col("size") > 0)).unionByName(sampled)
    found = rows.join(several(rows, ["size", "digest"]).select("size", "digest"), ["size", "digest"], "left_semi")
    out = None
    for k, (stage, df) in enumerate((("all", rows), ("same_size", same_size), ("sampled", large), ("same_sample", sampled), ("hashed", hashed), ("duplicate", found))):
        row = df.agg(F.lit(k).alias("step"), F.lit(stage).alias("stage"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        out = row if out is None else out.unionByName(row)
    return out


#: Members whose contents meet a copy of their group's first under one key, about.
TOGETHER = 16


def salted(members: DataFrame, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """Members with a salt, about `together` of each group for one, and ref (group_id, salt, dev, ino, path): the group's file with the
    lowest id, for each salt."""
    per = members.groupBy("group_id").agg(F.min(F.struct(*FILE, "path")).alias("ref"), F.ceil(F.count("*") / together).cast("int").alias("salts"))
    rows = members.join(per.select("group_id", "salts"), "group_id").withColumn("salt", F.pmod(F.xxhash64("path"), F.col("salts")).cast("int")).drop("salts")
    return rows, per.select("group_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "ref.dev", "ref.ino", "ref.path")


def verified(members: DataFrame, content: Column | None = None) -> DataFrame:
    """Members whose bytes equal those of their group's file with the lowest id; groups that come down to one id go.

    A group whose reference can't be read (null content) goes as a whole. The reference goes to a group's members, a copy
    for each few of them, so no group's contents meet under one key.
    """
    content = F.col("content") if content is None else content
    rows, refs = salted(members.withColumn("bytes_", content))
    held = members.select("group_id", *FILE, "path", content.alias("ref_"))
    ref = refs.join(held, ["group_id", *FILE, "path"]).select("group_id", "salt", "ref_")
    same = rows.join(ref, ["group_id", "salt"]).where(F.col("bytes_") == F.col("ref_")).drop("bytes_", "ref_", "salt")
    left = several(same, ["group_id"]).select("group_id")
    return same.join(left, "group_id", "left_semi")
