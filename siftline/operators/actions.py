"""What to do with the copies that don't stay, as tables. Nothing here touches a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.model import Action, NoConfirmedDuplicate, Rule
from siftline.operators.keep import kept


def planned(members: DataFrame, action: Action, rule: Rule = Rule.ALPHABETICAL, protected: Sequence[str] = (), archive_dir: str | None = None) -> DataFrame:
    """A row for each file to act on: group_id, size, kept, path, kind, keep_reason, archive_to, physical.

    The kept file's other paths and protected files are left alone; a file without an id is no alias. physical: whether
    the row is its file id's first, so summing size over those counts the space that is really freed.
    """
    rows = members.join(kept(members, rule, protected), "group_id")
    alias = F.coalesce((F.col("dev") == F.col("kept_dev")) & (F.col("ino") == F.col("kept_ino")), F.lit(False))
    rows = rows.where((F.col("path") != F.col("kept")) & ~alias & ~paths.under_any(F.col("path"), protected))
    first = rows.groupBy("group_id", "dev", "ino").agg(F.min("path").alias("first_path"))
    rows = rows.join(first, (rows["group_id"] == first["group_id"]) & rows["dev"].eqNullSafe(first["dev"]) & rows["ino"].eqNullSafe(first["ino"])).drop(first["group_id"]).drop(first["dev"]).drop(first["ino"])
    moved = paths.archived(F.col("path"), archive_dir) if archive_dir else F.lit(None).cast("string")
    unknown = F.col("dev").isNull() | F.col("ino").isNull()
    return rows.select("group_id", "size", "kept", "path", F.lit(action.value).alias("kind"), "keep_reason", moved.alias("archive_to"), (unknown | (F.col("path") == F.col("first_path"))).alias("physical"))


def totals(plan: DataFrame) -> DataFrame:
    """One row: groups, files, bytes_reclaimed (each path counts; 0 for copies), physical_bytes."""
    freed = F.when(F.col("kind") == Action.COPY.value, 0).otherwise(F.col("size"))
    return plan.agg(
        F.countDistinct("group_id").alias("groups"),
        F.count("*").alias("files"),
        F.coalesce(F.sum(freed), F.lit(0)).alias("bytes_reclaimed"),
        F.coalesce(F.sum(F.when(F.col("physical"), freed)), F.lit(0)).alias("physical_bytes"),
    )


def stale(plan: DataFrame, live: DataFrame) -> DataFrame:
    """group_id, stale: whether any stamped file of the group is missing, no regular file, or has another size or mtime.

    plan: group_id, path, size, mtime_ns of kept and target files. live: path, size, mtime_ns, is_file.
    """
    now = live.select("path", F.col("size").alias("now_size"), F.col("mtime_ns").alias("now_ns"), "is_file")
    ok = F.coalesce(F.col("is_file") & (F.col("now_size") == F.col("size")) & (F.col("now_ns") == F.col("mtime_ns")), F.lit(False))
    return plan.join(now, "path", "left").groupBy("group_id").agg(F.max(~ok).alias("stale"))


def outcomes(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Planned rows with ok and error of what was done (path, ok, error); null where nothing was."""
    return plan.join(results, "path", "left")


def folder_pairs(files: DataFrame, members: DataFrame, removed: str, keep: str, protected: Sequence[str] = ()) -> DataFrame:
    """remove, keep, size of each file below `removed`, each confirmed to have its copy at the same place below `keep`.

    files must be all files, unfiltered. Protected ones are left out. Raises NoConfirmedDuplicate if any isn't confirmed.
    """
    own = files.where(paths.under(F.col("path"), removed) & ~paths.under_any(F.col("path"), protected)).select(
        "path", "size", F.concat(F.lit(keep.rstrip("/") + "/"), paths.relative(F.col("path"), removed)).alias("partner")
    )
    group = members.select(F.col("path").alias("p"), "group_id", F.col("size").alias("group_size"))
    a, b = group.alias("a"), group.alias("b")
    pairs = own.join(a, (F.col("path") == F.col("a.p")) & (F.col("size") == F.col("a.group_size")), "left").select("path", "size", "partner", "group_id")
    pairs = pairs.join(b.select(F.col("p").alias("partner"), F.col("group_id").alias("partner_group")), "partner", "left")
    pairs = pairs.select(F.col("path").alias("remove"), F.col("partner").alias("keep"), "size", F.coalesce(F.col("group_id") == F.col("partner_group"), F.lit(False)).alias("confirmed"))
    if bad := pairs.where(~F.col("confirmed")).orderBy("remove").first():
        raise NoConfirmedDuplicate(f"{bad['remove']} has no confirmed duplicate at {bad['keep']}")
    return pairs.drop("confirmed")


def uncovered(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of groups that aren't wholly below the folders in `roots` (root)."""
    up = members.select("group_id", "path", F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("root"))
    inside = up.join(roots.select("root").distinct(), "root", "left_semi").select("group_id", "path").distinct()
    rest = members.join(inside, ["group_id", "path"], "left_anti").select("group_id").distinct()
    return members.join(rest, "group_id", "left_semi")
