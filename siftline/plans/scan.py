"""Whole scans of directory trees: walk, funnel, folders, images.

What a scan learns it can give to the next: a walk index, so only changed folders are listed, and a hash store, to which
files are hashed in batches that are committed one by one, so a scan that is killed goes on from its last batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftline.model import HASH_CACHE, InvalidRoot, PerceptualOptions, ScanOptions
from siftline.operators import cache as caches
from siftline.operators import exact
from siftline.operators.filters import image_options
from siftline.operators.folders import folder_matches
from siftline.operators.similar import image_hashes, similar_groups
from siftline.sources import fswalk, treewalk
from siftline.sources.hashstore import HashStore
from siftline.sources.tables import images
from siftline.tables import saved

#: Bytes and files that are hashed between two commits to a hash store.
BATCH_BYTES, BATCH_FILES = 64 << 30, 1_000_000


@dataclass
class Counters:
    """Figures of a scan, from metrics that its jobs collect on their way; no job counts only.

    at: paths walked, paths of shared size, file ids sampled, hashed and taken from a cache, folders listed and reused.
    files_read: opened for a sample, for a hash, and two for each comparison of bytes, failures included; bytes_read: what
    was really read. Checked are paths that need no more hashing: unique sizes at once, the others as stages settle them.
    """

    progress: Callable[[dict], None] | None = None
    at: dict[str, int] = field(default_factory=dict)
    files_read: int = 0
    bytes_read: int = 0
    files_total: int = 0
    bytes_total: int = 0
    files_checked: int = 0
    bytes_checked: int = 0

    def walked(self, files: int, size: int) -> None:
        self.files_total, self.bytes_total = files, size
        self.tell({"type": "progress", "files_scanned": files, "bytes_scanned": size})

    def read(self, files: int | None, size: int | None) -> None:
        self.files_read += files or 0
        self.bytes_read += size or 0

    def pending(self, files: int | None, size: int | None) -> None:
        """All but so many paths and bytes are checked."""
        self.files_checked, self.bytes_checked = self.files_total - (files or 0), self.bytes_total - (size or 0)
        self.tell({"type": "hash_progress"} | self.reads())

    def reads(self) -> dict[str, int]:
        return {k: getattr(self, k) for k in ("files_read", "bytes_read", "files_checked", "files_total", "bytes_checked", "bytes_total")}

    def tell(self, event: dict) -> None:
        if self.progress:
            self.progress(event)


def _observed(df: DataFrame, name: str, **sums) -> tuple[DataFrame, dict]:  # noqa: ANN003
    """The rows as a saved table, with sums of expressions that the same job takes; None of no rows."""
    seen = Observation()
    out = saved(df.observe(seen, *(F.sum(v).alias(k) for k, v in sums.items())), name)
    return out, seen.get


@dataclass
class Scan:
    """What a scan found; index: the new walk index; counters: see Counters."""

    root: str
    options: ScanOptions
    files: DataFrame
    members: DataFrame
    errors: DataFrame
    cache: DataFrame
    index: DataFrame
    counters: dict[str, int]

    def groups(self) -> DataFrame:
        return exact.groups(self.members)

    def summary(self) -> DataFrame:
        return exact.summary(self.files, self.members)

    def folders(self) -> DataFrame:
        return folder_matches(self.files, self.members, self.root)

    def similar(self, options: PerceptualOptions | None = None) -> DataFrame:
        spark = self.files.sparkSession
        files = treewalk.tree(spark, self.root, image_options(self.options)).files
        hashes = image_hashes(images(spark, self.root)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        return similar_groups(hashes.join(files.select("path"), "path", "left_semi"), (options or PerceptualOptions()).max_hamming_distance)


def _equal_bytes(a: str, b: str) -> tuple[bool, int]:
    """Whether two files have the same bytes, and how many were read of both."""
    n = 0
    with open(a, "rb") as x, open(b, "rb") as y:
        while True:
            p, q = x.read(1 << 20), y.read(1 << 20)
            n += len(p) + len(q)
            if p != q:
                return False, n
            if not p:
                return True, n


def verified(members: DataFrame, counters: Counters | None = None) -> tuple[DataFrame, DataFrame]:
    """Members whose bytes on disk equal those of their group's lowest file id, and the files that couldn't be read.

    One path of each file id is read; empty files are equal without. A group whose lowest id can't be read goes as a whole, with one error.
    """
    key = F.min(F.struct("dev", "ino", "path"))
    full = members.where("size > 0")
    reps = full.groupBy("group_id", "dev", "ino").agg(F.min("path").alias("path"))
    least = reps.groupBy("group_id").agg(key["path"].alias("ref"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, error, read = [], [], []
            for path, ref in zip(batch.column("path").to_pylist(), batch.column("ref").to_pylist()):
                ok, why, n = False, None, 0
                try:
                    ok, n = _equal_bytes(ref, path)
                except OSError as e:
                    # that the first can't be read is told once
                    why = str(e) if e.filename == path else None
                same.append(ok)
                error.append(why)
                read.append(n)
            kept = [batch.column(c) for c in ("group_id", "dev", "ino", "path")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(same, pa.bool_()), pa.array(error, pa.string()), pa.array(read, pa.int64())], ["group_id", "dev", "ino", "path", "same", "error", "read"])

    rows = reps.join(least, "group_id").mapInArrow(compare, "group_id string, dev long, ino long, path string, same boolean, error string, read long")
    checked, sums = _observed(rows, "verified", files=F.lit(2), bytes=F.col("read"))
    if counters:
        counters.read(sums["files"], sums["bytes"])
    same = checked.where("same")
    left = same.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    kept = full.join(same.select("group_id", "dev", "ino"), ["group_id", "dev", "ino"], "left_semi").join(left, "group_id", "left_semi")
    return members.where("size = 0").select(*kept.columns).unionByName(kept), checked.where("error IS NOT NULL").select("path", F.lit("verify").alias("stage"), F.col("error").alias("message"))


def restated(reps: DataFrame) -> DataFrame:
    """File ids with their mtime of now, and an error where a file is gone or has another size than was listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, errors = [], []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                try:
                    st = os.stat(path)
                    times.append(st.st_mtime_ns)
                    errors.append(None if st.st_size == size else f"size changed since it was listed ({size} -> {st.st_size})")
                except OSError as e:
                    times.append(None)
                    errors.append(str(e))
            kept = [c for c in batch.schema.names if c != "mtime_ns"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(times, pa.int64()), pa.array(errors, pa.string())], [*kept, "mtime_ns", "error"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields if f.name != "mtime_ns")
    return reps.mapInArrow(run, f"{kept}, mtime_ns long, error string")


def _failed(rows: DataFrame, stage: str) -> DataFrame:
    return rows.where("error IS NOT NULL").select("path", F.lit(stage).alias("stage"), F.col("error").alias("message"))


def scan(
    spark: SparkSession,
    root: str,
    options: ScanOptions | None = None,
    cache: DataFrame | None = None,
    imported: DataFrame | None = None,
    index: DataFrame | None = None,
    store: str | None = None,
    progress: Callable[[dict], None] | None = None,
    batch: tuple[int, int] = (BATCH_BYTES, BATCH_FILES),
) -> Scan:
    """Duplicate files below a folder. Only what shares a size is read, large files by samples first.

    cache: hashes of earlier runs. imported: another tool's, which makes all digests xxh3-128, as they can't be mixed.
    index: the walk index of an earlier scan; files that share a size are looked at again before a cached hash is taken.
    store: the folder of a hash store, which is a cache too and gets new hashes after each batch of so many bytes and
    files. progress: gets events as they come, of type progress while walking and hash_progress afterwards.
    """
    options = options or ScanOptions()
    if not os.path.isdir(root):
        raise InvalidRoot(root)
    algorithm = "xxh3_128" if imported is not None else "sha256"
    held = HashStore(spark, f"{store}/{algorithm}") if store else None
    cache = cache if cache is not None else spark.createDataFrame([], HASH_CACHE)
    if held:
        stored = held.read()
        cache = stored.unionByName(cache.join(stored.select("path"), "path", "left_anti").select(*stored.columns))
    counters = Counters(progress)
    tree = treewalk.tree(spark, root, options, index, counters.walked)
    files, errors = tree.files, tree.errors
    shared, sums = _observed(files.join(exact.several(files, ["size"]).select("size"), "size", "left_semi"), "same-size", files=F.lit(1))
    counters.at = {"files": tree.files_scanned, "same_size": sums["files"] or 0, "folders_listed": tree.listed, "folders_reused": tree.reused}
    empty = shared.where("size = 0").withColumn("digest", F.lit(""))
    # one path of each file id is read
    reps = exact.collapsed(shared.where("size > 0")).join(shared.select(F.col("path").alias("rep_path"), "mtime_ns"), "rep_path").withColumnRenamed("rep_path", "path")
    columns, bad = reps.columns, []
    of_paths = {"paths": F.col("aliases"), "bytes": F.col("aliases") * F.col("size")}
    if index is not None:
        reps, sums = _observed(restated(reps), "candidates", **of_paths)
        bad.append(_failed(reps, "stat"))
        reps = reps.where("error IS NULL").select(*columns)
    else:
        reps, sums = _observed(reps, "candidates", **of_paths)
    counters.pending(sums["paths"], sums["bytes"])
    is_large = F.col("size") > options.small_file_threshold
    large, sums = _observed(fswalk.read_hashes(reps.where(is_large), options.partial_hash_sample_size, algorithm), "samples", files=F.lit(1), bytes=F.col("read"))
    counters.read(sums["files"], sums["bytes"])
    counters.at["sampled"] = sums["files"] or 0
    bad.append(_failed(large, "partial hash"))
    sampled = large.where("error IS NULL").withColumnRenamed("digest", "partial").drop("error", "read")
    sampled = sampled.join(exact.several(sampled, ["size", "partial"]).select("size", "partial"), ["size", "partial"], "left_semi")
    todo = reps.where(~is_large).select(*columns).unionByName(sampled.select(*columns))
    if imported is None:
        known = caches.hits(todo, cache)
    else:
        todo = saved(todo, "to-hash")
        own = caches.hits(todo, cache)
        known = own.unionByName(caches.imported(todo.join(own.select("path"), "path", "left_anti"), imported))
    # each with its cached hash, or none
    todo, sums = _observed(todo.join(known.select("path", "hash"), "path", "left"), "to-hash", cached=F.col("hash").isNotNull().cast("long"), missing=F.col("hash").isNull().cast("long"), size=F.when(F.col("hash").isNull(), F.col("size")), paths=F.when(F.col("hash").isNull(), F.col("aliases")), bytes=F.when(F.col("hash").isNull(), F.col("aliases") * F.col("size")))
    counters.at["cached"], counters.at["hashed"] = sums["cached"] or 0, sums["missing"] or 0
    left_paths, left_bytes = sums["paths"] or 0, sums["bytes"] or 0
    counters.pending(left_paths, left_bytes)
    misses, parts = todo.where("hash IS NULL").drop("hash"), []
    waves = max(1, -(-(sums["size"] or 0) // batch[0]), -(-(sums["missing"] or 0) // batch[1]))
    for wave in range(waves):
        some = misses.where(F.pmod(F.xxhash64("path"), F.lit(waves)) == wave) if waves > 1 else misses
        part, sums = _observed(fswalk.read_hashes(some, None, algorithm), "hashes", files=F.lit(1), read=F.col("read"), **of_paths)
        if held and sums["files"]:
            held.append(part.where("error IS NULL").withColumnRenamed("digest", "hash"))
        parts.append(part)
        left_paths, left_bytes = left_paths - (sums["paths"] or 0), left_bytes - (sums["bytes"] or 0)
        counters.read(sums["files"], sums["read"])
        counters.pending(left_paths, left_bytes)
    fresh = treewalk.union(parts)
    bad.append(_failed(fresh, "full hash"))
    hashed = todo.where("hash IS NOT NULL").withColumnRenamed("hash", "digest").unionByName(fresh.where("error IS NULL").select(*columns, "digest"))
    of = shared.where("size > 0").join(hashed.select("size", "dev", "ino", "digest"), ["size", "dev", "ino"])
    if index is not None:
        now = hashed.select("size", "dev", "ino", F.col("mtime_ns").alias("now_ns"))
        of = of.join(now, ["size", "dev", "ino"]).withColumn("mtime_ns", F.col("now_ns")).drop("now_ns")
    members = saved(exact.members(of.unionByName(empty.select(*of.columns))), "members")
    if options.verify:
        members, unread = verified(members, counters)
        counters.pending(0, 0)
        bad.append(unread)
    for e in bad:
        errors = errors.unionByName(e)
    new = fresh.where("error IS NULL").select("path", "size", "mtime_ns", F.col("digest").alias("hash"))
    return Scan(root, options, files, members, errors, caches.updated(cache, new), tree.index, counters.at | counters.reads())
