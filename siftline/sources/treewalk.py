"""Walks of directory trees in rounds, with a walk index that lets unchanged folders go unlisted.

A round is one job over items of work: folders to list, and slices of the names of a very large folder to look up. A task
lists its folders and goes on below them until it has listed a number of folders that grows with the rounds; what is left
are items of the next round, which are dealt to all tasks anew. So neither a deep nor a lopsided tree keeps few tasks busy.

The index is a table of folders with their files and subfolders. All its folders are looked at first, in one job, by a
stat each: those with the recorded mtime become rows of files without being listed, changed ones are listed, and so is
whatever is found below listed folders or is recorded below kept ones without a record of its own. An edit in place
doesn't change a folder's mtime, so sizes and mtimes of files below kept folders are those of the recorded listing.
Driver and executors must see the same tree; the tables of a round are in the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftline.model import ERRORS, FILES, WALK_INDEX, InvalidRoot, ScanOptions
from siftline.sources.fswalk import Walk, signed
from siftline.tables import saved

#: Options that change what a walk yields.
WALKED = ("follow_symlinks", "cross_filesystems", "min_size", "max_size", "include_extensions", "exclude_extensions", "exclude_paths")
#: Names that a task looks up at once; folders with more are dealt out.
SLICE = 10_000
#: Folders that a task lists below its own: at first, and at most.
DESCENT = 64, 16_384
#: A folder changed this shortly before it was listed may change again without another mtime, so it isn't recorded.
RACY_NS = 2_000_000_000
ITEMS = "dir string, names array<string>, above array<long>"
ROWS = f"kind string, {ITEMS}, name string, size long, dev long, ino long, mtime_ns long, message string"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
KINDS = dict(zip(COLUMNS, (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), *[pa.int64()] * 4, pa.string())))


@dataclass
class Tree:
    """What a walk found. files, errors: as FILES and ERRORS; index: the new walk index; the rest are counts."""

    files: DataFrame
    errors: DataFrame
    index: DataFrame
    files_scanned: int = 0
    bytes_scanned: int = 0
    listed: int = 0
    reused: int = 0


def rules_of(root: str, options: ScanOptions) -> tuple[dict, str]:
    """The options that a walk follows, and a fingerprint of them and the root."""
    plain = {k: v for k, v in asdict(options).items() if k in WALKED}
    return plain, hashlib.sha256(json.dumps([root, plain], sort_keys=True, default=list).encode()).hexdigest()


class Worker:
    """Works on items in a task; rows are tuples of COLUMNS."""

    def __init__(self, root: str, options: dict) -> None:
        self.walk = Walk(root, options)

    def error(self, folder: str, path: str, message: str) -> tuple:
        return ("error", folder, None, None, path.encode("utf-8", "replace").decode(), None, None, None, None, message)

    def listing(self, folder: str, above: list[int]) -> Iterator[tuple]:
        """A folder's row, then those of its entries or items for slices of them."""
        try:
            now, here = time.time_ns(), os.stat(folder)
            names = sorted(os.listdir(folder))
        except OSError as e:
            yield self.error(folder, folder, str(e))
            return
        yield ("dir", folder, None, None, None, None, None, None, here.st_mtime_ns, "too new" if now - here.st_mtime_ns < RACY_NS else None)
        ids = [*above, signed(here.st_dev), signed(here.st_ino)] if self.walk.options.follow_symlinks else []
        if len(names) <= SLICE:
            yield from self.looked_up(folder, names, ids)
        else:
            good = [n for n in names if n.isascii() or _utf8(n)]
            yield from (self.error(folder, os.path.join(folder, n), "name is not UTF-8") for n in set(names) - set(good))
            yield from (("todo", folder, good[i : i + SLICE], ids, None, None, None, None, None, None) for i in range(0, len(good), SLICE))

    def looked_up(self, folder: str, names: list[str], ids: list[int]) -> Iterator[tuple]:
        follow, known = self.walk.options.follow_symlinks, set(zip(ids[::2], ids[1::2]))
        for name in names:
            path = os.path.join(folder, name)
            if not _utf8(name):
                yield self.error(folder, path, "name is not UTF-8")
                continue
            if self.walk.excluded(path):
                continue
            try:
                st = os.stat(path, follow_symlinks=follow)
            except OSError as e:
                yield self.error(folder, path, str(e))
                continue
            if not self.walk.options.cross_filesystems and st.st_dev != self.walk.dev:
                continue
            if stat.S_ISDIR(st.st_mode):
                if (signed(st.st_dev), signed(st.st_ino)) in known:
                    yield self.error(folder, path, "a link back to a folder above")
                else:
                    yield ("sub", folder, None, ids, name, None, None, None, None, None)
            elif stat.S_ISREG(st.st_mode) and self.walk.wanted(name, st.st_size):
                yield ("file", folder, None, None, name, st.st_size, signed(st.st_dev), signed(st.st_ino), st.st_mtime_ns, None)

    def work(self, items: Iterator[tuple], descent: int) -> Iterator[tuple]:
        """Rows of items, and of up to `descent` folders below them; of others, todo rows."""
        for folder, names, above in items:
            stack = [(folder, names, above)]
            while stack:
                folder, names, above = stack.pop()
                for row in self.looked_up(folder, names, above) if names is not None else self.listing(folder, above):
                    yield row
                    if row[0] == "sub":
                        if descent > 0:
                            descent -= 1
                            stack.append((os.path.join(folder, row[4]), None, row[3]))
                        else:
                            yield ("todo", os.path.join(folder, row[4]), None, row[3], None, None, None, None, None, None)


def _utf8(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), KINDS.values())], COLUMNS)


def state_of(folder: str, mtime_ns: int, root: str, dev: int | None, real: dict[str, bool]) -> str:
    """kept, changed or gone: what a recorded folder is now. real: whether folders are no links, and none above them is."""

    def is_real(path: str) -> bool:
        if path == root:
            return True
        if path not in real:
            try:
                real[path] = stat.S_ISDIR(os.lstat(path).st_mode) and is_real(os.path.dirname(path))
            except OSError:
                real[path] = False
        return real[path]

    try:
        if not is_real(folder):
            return "gone"
        st = os.stat(folder)
    except OSError:
        return "gone"
    if not stat.S_ISDIR(st.st_mode) or (dev is not None and st.st_dev != dev):
        return "gone"
    return "kept" if st.st_mtime_ns == mtime_ns else "changed"


def looked_at(folders: DataFrame, root: str, options: dict, parts: int) -> DataFrame:
    """dir, state of recorded folders (dir, mtime_ns): a stat each."""
    dev = None if options["cross_filesystems"] else os.stat(root).st_dev

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real: dict[str, bool] = {}
        for batch in batches:
            if len(real) > 1_000_000:
                real.clear()
            dirs = batch.column("dir")
            states = [state_of(d, ns, root, dev, real) for d, ns in zip(dirs.to_pylist(), batch.column("mtime_ns").to_pylist())]
            yield pa.RecordBatch.from_arrays([dirs, pa.array(states, pa.string())], ["dir", "state"])

    return folders.repartitionByRange(parts, "dir").sortWithinPartitions("dir").mapInArrow(run, "dir string, state string")


def below(df: DataFrame) -> DataFrame:
    """The folder that each row's name is in dir."""
    return df.select(F.concat_ws("/", F.regexp_replace("dir", "/$", ""), "name").alias("dir"))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def tree(spark: SparkSession, root: str, options: ScanOptions | None = None, index: DataFrame | None = None, progress: Callable[[int, int], None] | None = None) -> Tree:
    """Walks a folder, or takes a single file as it is.

    index: of an earlier walk. It counts only for the same root and rules. options.rescan_all lists all folders and gives
    a whole new index; a walk that follows links neither uses one nor gives one. progress: gets the numbers of files and
    bytes after each round.
    """
    options = options or ScanOptions()
    root = root.rstrip("/") or "/"
    if not os.path.exists(root):
        raise InvalidRoot(root)
    plain, rules = rules_of(root, options)
    if not os.path.isdir(root):
        st = os.stat(root)
        row = (root, st.st_size, signed(st.st_dev), signed(st.st_ino), st.st_mtime_ns)
        return Tree(spark.createDataFrame([row], FILES), spark.createDataFrame([], ERRORS), spark.createDataFrame([], WALK_INDEX), 1, st.st_size)
    parts = options.read_parallelism or spark.sparkContext.defaultParallelism
    todo, tables, kept_rows, known, states = spark.createDataFrame([(root, None, [])], ITEMS), [], None, None, None
    out = Tree(todo, todo, todo)
    if index is not None and not options.follow_symlinks and not options.rescan_all:
        mine = index.where(F.col("rules") == rules)
        found, seen = Observation(), Observation()
        states = looked_at(mine.where("kind = 'dir'").select("dir", "mtime_ns"), root, plain, parts)
        states = saved(states.observe(found, F.count_if(F.col("state") != "gone").alias("known")), "folder-states")
    if states is not None and found.get["known"]:
        known = states.where("state <> 'gone'").select("dir")
        held = mine.join(states.where("state = 'kept'").select("dir"), "dir").select(*mine.columns)
        is_file = F.col("kind") == "file"
        counts = F.count_if(is_file).alias("files"), F.sum(F.when(is_file, F.col("size"))).alias("bytes"), F.count_if(F.col("kind") == "dir").alias("dirs")
        kept_rows = saved(held.observe(seen, *counts), "kept-folders")
        out.files_scanned, out.bytes_scanned, out.reused = seen.get["files"], seen.get["bytes"] or 0, seen.get["dirs"]
        first = todo.select("dir").unionByName(below(kept_rows.where("kind = 'sub'"))).join(known, "dir", "left_anti")
        changed = states.where("state = 'changed'").select("dir")
        todo = first.unionByName(changed).select("dir", F.lit(None).cast("array<string>").alias("names"), F.array().cast("array<long>").alias("above"))
    number = 0
    while True:
        # folders with a record of their own are no work of a round, so with an index a task doesn't go below its items
        descent = 0 if known is not None else min(DESCENT[0] * 4**number, DESCENT[1])
        rows, more = _round(todo, root, plain, descent, 1 if number == 0 and known is None else parts, out)
        tables.append(rows)
        if progress:
            progress(out.files_scanned, out.bytes_scanned)
        if not more:
            break
        todo = rows.where("kind = 'todo'").select("dir", "names", "above")
        if known is not None:
            todo = todo.where("names IS NOT NULL").unionByName(todo.where("names IS NULL").join(known, "dir", "left_anti"))
        number += 1
    rows = union(tables)
    path = F.concat_ws("/", F.regexp_replace("dir", "/$", ""), "name").alias("path")
    stats = "size", "dev", "ino", "mtime_ns"
    files = rows.where("kind = 'file'").select(path, *stats)
    bad = rows.where("kind = 'error'")
    # a folder is recorded if all of it was listed, and it had been left alone for long enough before
    whole = rows.where("kind = 'dir' AND message IS NULL").select("dir").join(bad.select("dir"), "dir", "left_anti")
    fresh = rows.where("kind IN ('dir', 'file', 'sub')").join(whole, "dir", "left_semi").select(F.lit(rules).alias("rules"), "dir", "kind", "name", *stats)
    if options.follow_symlinks:
        fresh = fresh.limit(0)
    if kept_rows is not None:
        files = kept_rows.where("kind = 'file'").select(path, *stats).unionByName(files)
        fresh = kept_rows.unionByName(fresh)
    out.files = files
    out.errors = bad.select(F.col("name").alias("path"), F.lit("traversal").alias("stage"), "message")
    out.index = fresh
    return out


def _round(todo: DataFrame, root: str, options: dict, descent: int, parts: int, out: Tree) -> tuple[DataFrame, int]:
    """The saved rows of a round, counted on the way, and how many of them are items of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ((d, n, a or []) for b in batches for d, n, a in zip(*(b.column(c).to_pylist() for c in ("dir", "names", "above"))))
        yield from _batches(Worker(root, options).work(items, descent))

    seen, of = Observation(), lambda kind: F.count_if(F.col("kind") == kind)
    counts = of("file").alias("files"), F.sum(F.when(F.col("kind") == "file", F.col("size"))).alias("bytes"), of("dir").alias("dirs"), of("todo").alias("todo")
    rows = saved(todo.repartition(parts).mapInArrow(run, ROWS).observe(seen, *counts), "walked")
    got = seen.get
    out.files_scanned += got["files"]
    out.bytes_scanned += got["bytes"] or 0
    out.listed += got["dirs"]
    return rows, got["todo"]
