"""Which copy of a group stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.model import Rule

PROTECTED = "in a protected/reference folder"
UNREADABLE = "alphabetically first (no file's modification time was readable)"
# Reasons as reports give them.
REASONS = {
    Rule.ALPHABETICAL: "alphabetically first",
    Rule.NEWEST: "most recent modification time",
    Rule.OLDEST: "oldest modification time",
    Rule.SHORTEST_PATH: "shortest path",
    Rule.LONGEST_PATH: "longest path",
}


def _rank(rule: Rule) -> Column:
    """Least for the path to keep; ties go to the first path."""
    path, mtime = F.col("path"), F.col("mtime_ns")
    if rule is Rule.NEWEST:
        return F.coalesce(-mtime, F.lit((1 << 63) - 1))
    if rule is Rule.OLDEST:
        return F.coalesce(mtime, F.lit((1 << 63) - 1))
    deep = paths.depth(path).cast("long")
    return {Rule.ALPHABETICAL: F.lit(0).cast("long"), Rule.SHORTEST_PATH: deep, Rule.LONGEST_PATH: -deep}[rule]


def kept(members: DataFrame, rule: Rule = Rule.ALPHABETICAL, protected: Sequence[str] = ()) -> DataFrame:
    """A row for each group: group_id, kept, keep_reason, kept_dev, kept_ino.

    The first protected path of a group stays whatever the rule. The least row of a group is an aggregate, combined
    before it moves, so a large group is no burden.
    """
    safe = paths.under_any(F.col("path"), protected)
    timed = rule in (Rule.NEWEST, Rule.OLDEST)
    order = F.struct((~safe).alias("unsafe"), F.when(safe, F.lit(0).cast("long")).otherwise(_rank(rule)).alias("rank"), paths.components(F.col("path")).alias("parts"), F.col("path").alias("path"), F.col("dev").alias("dev"), F.col("ino").alias("ino"), *([F.col("mtime_ns").isNull().alias("untimed")] if timed else []))
    least = members.groupBy("group_id").agg(F.min(order).alias("k"))
    reason = F.lit(REASONS[rule])
    if timed:
        reason = F.when(F.col("k.untimed"), F.lit(UNREADABLE)).otherwise(reason)
    return least.select("group_id", F.col("k.path").alias("kept"), F.when(~F.col("k.unsafe"), F.lit(PROTECTED)).otherwise(reason).alias("keep_reason"), F.col("k.dev").alias("kept_dev"), F.col("k.ino").alias("kept_ino"))


def text_key(path: Column) -> Column:
    """Orders paths as text by UTF-16 units, as desktop tools do, with the path itself at hand; /a-b comes before /a/b."""
    return F.struct(F.encode(path, "UTF-16BE").alias("units"), path.alias("path"))


def kept_folders(clusters: DataFrame, by_text: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """sig, file_count, kept, removed (how many) of exact clusters (sig, file_count, dir), combined before anything moves.

    The first folder stays, by path components, or by text. chosen: dir of folders picked by hand, which go first.
    """
    key = (text_key if by_text else paths.sort_key)(F.col("dir"))
    if chosen is not None:
        picked = chosen.select("dir", F.lit(True).alias("picked")).distinct()
        clusters = clusters.join(picked, "dir", "left")
        key = F.struct(F.col("picked").isNull().alias("other"), key.alias("key"), F.col("dir").alias("path"))
    return clusters.groupBy("sig", "file_count").agg(F.min(key)["path"].alias("kept"), (F.count("*") - 1).alias("removed"))
