"""Events as JSON lines, reports as text, and figures over groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.values import LABELS, category, rounded
from siftline.tables import saved


def _event(df: DataFrame, kind: str, *columns) -> DataFrame:
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *columns)).alias("value"))


def group_events(groups: DataFrame) -> DataFrame:
    return _event(groups, "duplicate_group", "size", "paths", F.lit(None).cast("string").alias("action"))


def action_events(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """Group events with what is planned for each."""
    per = plan.groupBy("group_id").agg(
        F.first("kind").alias("kind"), F.first("kept").alias("kept"), F.first("keep_reason").alias("keep_reason"), F.sort_array(F.collect_list("path")).alias("planned"), F.sum("size").alias("bytes_reclaimed")
    )
    action = F.when(F.col("kind").isNotNull(), F.struct("kind", "kept", "keep_reason", F.lit(False).alias("applied"), "planned", F.array().cast("array<string>").alias("succeeded"), F.array().cast("array<string>").alias("failed"), "bytes_reclaimed"))
    return _event(groups.join(per, "group_id", "left"), "duplicate_group", "size", "paths", action.alias("action"))


def error_events(errors: DataFrame) -> DataFrame:
    return _event(errors, "error", "path", "message")


def folder_events(matches: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>").alias("action")
    exact = _event(matches.where("kind = 'exact'"), "folder_exact", "folders", "file_count", "bytes", none)
    return exact.unionByName(_event(matches.where("kind = 'contained'"), "folder_contained", "subset", "superset", "file_count", "bytes", none))


def similar_events(similar: DataFrame) -> DataFrame:
    return _event(similar, "similar_images", "paths", "max_distance")


def progress_event(spark, files_scanned: int, bytes_scanned: int) -> DataFrame:
    return _event(spark.range(1), "progress", F.lit(files_scanned).alias("files_scanned"), F.lit(bytes_scanned).alias("bytes_scanned"))


def hash_progress_events(counters: DataFrame) -> DataFrame:
    return _event(counters, "hash_progress", "files_read", "bytes_read", "files_checked", "files_total", "bytes_checked", "bytes_total")


def action_summary_event(totals: DataFrame, kind: str, applied: bool) -> DataFrame:
    return _event(totals, "action_summary", F.lit(kind).alias("kind"), F.lit(applied).alias("applied"), "bytes_reclaimed", "files")


def finished_event(summary: DataFrame) -> DataFrame:
    return _event(summary, "finished", "files_scanned", "bytes_scanned", "duplicate_groups", "duplicate_files")


def stream(*events: DataFrame, finished: DataFrame) -> Iterator[str]:
    """All events a line each; the finished one is last."""
    for df in (*events, finished):
        for row in df.toLocalIterator():
            yield row["value"]


def text(groups: DataFrame, summary: DataFrame | None = None, matches: DataFrame | None = None, similar: DataFrame | None = None) -> Iterator[str]:
    """A report for reading, group by group."""
    for r in groups.toLocalIterator():
        yield f"--- {r['size']} bytes, {len(r['paths'])} copies ---"
        yield from r["paths"]
    for r in matches.toLocalIterator() if matches is not None else ():
        if r["kind"] == "exact":
            yield f"--- duplicate folders: {r['bytes']} bytes, {r['file_count']} files ---"
            yield from r["folders"]
        else:
            yield f"--- folder contained in another: {r['bytes']} bytes, {r['file_count']} files ---"
            yield f"  subset:   {r['subset']}"
            yield f"  superset: {r['superset']}"
    for r in similar.toLocalIterator() if similar is not None else ():
        yield f"--- similar images (max distance {r['max_distance']}/64): {len(r['paths'])} files ---"
        yield from r["paths"]
    if summary is not None:
        s = summary.first()
        yield f"scanned {s['files_scanned']} files ({s['bytes_scanned']} bytes), found {s['duplicate_groups']} duplicate groups ({s['duplicate_files']} files)"


def reclaimable(members: DataFrame) -> DataFrame:
    """One row: bytes that all but one copy of each group take."""
    per = members.groupBy("group_id", "size").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).alias("bytes"))


def by_category(members: DataFrame) -> DataFrame:
    """category, label, bytes, pct of reclaimable bytes, by the category of each group's first path."""
    per = members.groupBy("group_id", "size").agg(F.count("*").alias("n"), F.min(paths.sort_key(F.col("path"))).alias("first"))
    sums = per.where("n > 1").groupBy(category(F.col("first.path")).alias("category")).agg(F.sum(F.col("size") * (F.col("n") - 1)).alias("bytes"))
    total = sums.agg(F.sum("bytes").alias("total"))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("category")]
    return sums.crossJoin(F.broadcast(total)).select("category", label.alias("label"), "bytes", rounded(F.col("bytes") / F.col("total") * 100).alias("pct"))  # six rows by one


def per_folder(members: DataFrame) -> DataFrame:
    """dir, items, tier: groups with a copy directly in a folder; folders above such are tier ancestor."""
    direct = members.groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.countDistinct("group_id").alias("items"))
    above = direct.select(F.explode(paths.ancestors(F.col("dir"))).alias("dir")).distinct().join(direct.select("dir"), "dir", "left_anti")
    return direct.withColumn("tier", F.lit("direct")).unionByName(above.select("dir", F.lit(0).cast("long").alias("items"), F.lit("ancestor").alias("tier")))


def worst_errors(errors: DataFrame, most: int = 5) -> tuple[list, int]:
    """The first errors, and how many more there are."""
    return errors.orderBy("path").limit(most).collect(), max(0, errors.count() - most)


def review_rows(items: DataFrame, root: str) -> DataFrame:
    """Items (path) with the chain of their folders, name, place below its top folder, and how many folders each shares
    with the one before it in the order of chain and name.

    Ranges of that order are sorted by themselves; each hands its last chain and its number of items, by top folder, to
    those that follow. So a top folder may be of any size.
    """
    by, here, all_ = ["chain", "name", "path"], ["part_", "top_"], Window.partitionBy("top_").orderBy("part_")
    shown = items.withColumn("chain", paths.chain(F.col("path"), root)).withColumn("name", paths.name(F.col("path")))
    # items of different top folders share none
    shown = shown.withColumn("top_", F.coalesce(F.get("chain", F.lit(0)), F.lit("")))
    cut = saved(shown.repartitionByRange(*by).withColumn("part_", F.spark_partition_id()), "review")
    ends = cut.groupBy(*here).agg(F.count("*").alias("n_"), F.max(F.struct(*by))["chain"].alias("end_"))
    ends = ends.select(*here, F.coalesce(F.sum("n_").over(all_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.lag("end_").over(all_).alias("last_"))
    order = Window.partitionBy(*here).orderBy(*by)
    last = F.coalesce(F.lag("chain").over(order), F.col("last_"))
    both = F.transform(F.arrays_zip(F.col("chain").alias("a"), F.coalesce(last, F.array().cast("array<string>")).alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    common = F.when(F.forall(both, lambda x: x), F.size(both)).otherwise(F.array_position(both, False) - 1)
    rows = cut.join(ends, here)
    rows = rows.withColumn("place", (F.row_number().over(order) + F.col("before_")).cast("int")).withColumn("shared", common.cast("int"))
    return rows.drop(*here, "before_", "last_")
