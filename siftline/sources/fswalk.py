"""Spark sources over directory trees: files with their ids, errors, and contents.

Scans walk in rounds, see treewalk; this data source is for `spark.read`. The driver lists a tree's first levels and deals the folders found to partitions; executors list what is below. So
driver and executors must see the same tree, and a lost executor's folders are just listed again.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftline.model import InvalidRoot, ScanOptions

SCHEMA = "path string, size long, dev long, ino long, mtime_ns long, error string"
SIGNED = 1 << 63


def signed(n: int) -> int:
    """An unsigned 64-bit number as the signed one with its bits."""
    return n - 2 * SIGNED if n >= SIGNED else n


@dataclass
class Folders(InputPartition):
    """Folders to walk, each with the ids of the folders above it; files that the driver saw are rows already."""

    todo: list[tuple[str, frozenset]]
    rows: list[tuple]


class Walk:
    """A walk with its rules."""

    def __init__(self, root: str, options: dict) -> None:
        self.root, self.options = root, ScanOptions(**options)
        self.dev = os.stat(root).st_dev

    def excluded(self, path: str) -> bool:
        return any(path == x or path.startswith(x.rstrip("/") + "/") for x in self.options.exclude_paths)

    def wanted(self, name: str, size: int) -> bool:
        o = self.options
        if (o.min_size is not None and size < o.min_size) or (o.max_size is not None and size > o.max_size):
            return False
        dot = name.rfind(".")
        ext = name[dot + 1 :].lower() if dot > 0 else None
        if o.include_extensions and ext not in {x.lower() for x in o.include_extensions}:
            return False
        return not (o.exclude_extensions and ext in {x.lower() for x in o.exclude_extensions})

    def list(self, folder: str, above: frozenset) -> tuple[list[tuple], list[tuple[str, frozenset]]]:
        """Rows of a folder's files and errors, and the folders below."""
        rows, below = [], []
        try:
            here = os.stat(folder)
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            return [(folder, None, None, None, None, str(e))], []
        ids = above | {(here.st_dev, here.st_ino)}
        for entry in entries:
            path = os.path.join(folder, entry.name)
            try:
                path.encode()
            except UnicodeEncodeError:
                rows.append((path.encode("utf-8", "replace").decode(), None, None, None, None, "name is not UTF-8"))
                continue
            if self.excluded(path):
                continue
            try:
                if entry.is_symlink() and not self.options.follow_symlinks:
                    continue
                st = entry.stat(follow_symlinks=self.options.follow_symlinks)
            except OSError as e:
                rows.append((path, None, None, None, None, str(e)))
                continue
            if not self.options.cross_filesystems and st.st_dev != self.dev:
                continue
            if stat.S_ISDIR(st.st_mode):
                if (st.st_dev, st.st_ino) in ids:
                    rows.append((path, None, None, None, None, "a link back to a folder above"))
                else:
                    below.append((path, ids))
            elif stat.S_ISREG(st.st_mode) and self.wanted(entry.name, st.st_size):
                rows.append((path, st.st_size, signed(st.st_dev), signed(st.st_ino), st.st_mtime_ns, None))
        return rows, below


class WalkReader(DataSourceReader):
    def __init__(self, root: str, options: dict, parts: int) -> None:
        self.root, self.options, self.parts = root, options, parts

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.root):
            raise InvalidRoot(self.root)
        if not os.path.isdir(self.root):
            st = os.stat(self.root)
            return [Folders([], [(self.root, st.st_size, signed(st.st_dev), signed(st.st_ino), st.st_mtime_ns, None)])]
        walk = Walk(self.root, self.options)
        todo, rows = [(self.root, frozenset())], []
        for _ in range(6):  # levels, until there are enough folders to deal
            if len(todo) >= 4 * self.parts or not todo:
                break
            level, todo = todo, []
            for folder, above in level:
                found, below = walk.list(folder, above)
                rows += found
                todo += below
        return [Folders([], rows), *(Folders(todo[i :: self.parts], []) for i in range(min(self.parts, len(todo))))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        yield from partition.rows
        walk = Walk(self.root, self.options) if partition.todo else None
        todo = list(partition.todo)
        while todo:
            rows, below = walk.list(*todo.pop())
            yield from rows
            todo += below


class WalkSource(DataSource):
    """format("fswalk"), load(root); options as ScanOptions has them, in JSON."""

    @classmethod
    def name(cls) -> str:
        return "fswalk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        import json

        return WalkReader(self.options["path"], json.loads(self.options.get("scan", "{}")), int(self.options.get("parts", 16)))


def walk(spark: SparkSession, root: str, options: ScanOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """files (path, size, dev, ino, mtime_ns) and errors (path, stage, message) of a tree or a single file."""
    import json

    options = options or ScanOptions()
    if not os.path.exists(root):
        raise InvalidRoot(root)
    spark.dataSource.register(WalkSource)
    plain = {k: v for k, v in asdict(options).items() if k in ("follow_symlinks", "cross_filesystems", "min_size", "max_size", "include_extensions", "exclude_extensions", "exclude_paths")}
    found = spark.read.format("fswalk").option("scan", json.dumps(plain)).option("parts", options.read_parallelism or spark.sparkContext.defaultParallelism).load(root)
    return found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("path", F.lit("traversal").alias("stage"), F.col("error").alias("message"))


def subfolders(files: DataFrame, folder: str) -> DataFrame:
    """name, path, has_children of the folders right below one, hidden ones left out, in order without regard to case."""
    from siftline.functions import paths

    up = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    own = up.where((paths.parent(F.col("path")) == folder) & ~paths.name(F.col("path")).startswith("."))
    inner = up.where(~paths.name(F.col("path")).startswith(".")).select(paths.parent(F.col("path")).alias("path")).distinct().withColumn("has", F.lit(True))
    return own.join(inner, "path", "left").select(paths.name(F.col("path")).alias("name"), "path", F.coalesce("has", F.lit(False)).alias("has_children")).orderBy(F.lower("name"))


def _chunks(path: str, ranges: list[tuple[int, int]] | None) -> Iterator[bytes]:
    with open(path, "rb") as f:
        if ranges is None:
            while block := f.read(1 << 20):
                yield block
        else:
            for at, n in ranges:
                f.seek(at)
                yield f.read(n)


def read_hashes(files: DataFrame, sample: int | None = None, algorithm: str = "sha256") -> DataFrame:
    """files with digest, error and the number of bytes read: of the whole content, or with `sample` of its head, middle and tail.

    algorithm: sha256, or xxh3_128 to agree with caches of tools that use it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            digests, errors, read = [], [], []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                if algorithm == "sha256":
                    h = hashlib.sha256()
                else:
                    import xxhash

                    h = xxhash.xxh3_128()
                n = 0
                try:
                    ranges = None
                    if sample is not None:
                        s = max(sample, 1)
                        ranges = [(0, min(s, size)), (max(size // 2 - s // 2, 0), min(s, size)), (max(size - s, 0), min(s, size))]
                    for block in _chunks(path, ranges):
                        h.update(block)
                        n += len(block)
                    digests.append(h.hexdigest())
                    errors.append(None)
                except OSError as e:
                    digests.append(None)
                    errors.append(str(e))
                read.append(n)
            columns = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), pa.array(errors, pa.string()), pa.array(read, pa.int64())], [*batch.schema.names, "digest", "error", "read"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(list(files.schema.fields)).add("digest", StringType()).add("error", StringType()).add("read", LongType())
    return files.mapInArrow(run, schema)
