"""A whole scan acted upon, in the order that is safe: folder matches first, then the groups that they leave."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import replace
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.model import Action, NoConfirmedDuplicate, NotADirectory, Rule
from siftline.operators import actions, exact, history
from siftline.plans import execute
from siftline.plans.scan import Scan
from siftline.sources import treewalk
from siftline.sources.records import Journal

#: Rows that come to the driver at once.
ROWS = 10_000


def _parts(rows: Iterator, size: int = ROWS) -> Iterator[list]:
    while part := list(islice(rows, size)):
        yield part


def _below(path: str, roots: Sequence[str]) -> bool:
    return any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots)


def _stamped(rows: DataFrame, path: str, kept: str, members: DataFrame) -> Iterator[tuple]:
    """path, kept, size and the mtimes that the scan saw, row by row."""
    of = lambda name, ns: members.select(F.col("path").alias(name), F.col("mtime_ns").alias(ns))
    both = rows.select(F.col(path).alias("path_"), F.col(kept).alias("kept_"), "size").join(of("path_", "ns"), "path_").join(of("kept_", "kept_ns"), "kept_")
    return (tuple(r) for r in both.select("path_", "kept_", "size", "ns", "kept_ns").toLocalIterator())


def folder_actions(matches: Iterator) -> Iterator[tuple[str, str]]:
    """(removed, kept) folders: of equal ones the first stays; of a contained one, what holds it, if it isn't removed itself."""
    removed: list[str] = []
    for m in sorted(matches, key=lambda m: (m["kind"] != "exact", m["folders"] or [m["subset"], m["superset"]])):
        pairs = [(f, m["folders"][0]) for f in m["folders"][1:]] if m["kind"] == "exact" else [(m["subset"], m["superset"])]
        for out, kept in pairs:
            if not _below(out, removed) and not _below(kept, [*removed, out]):
                removed.append(out)
                yield out, kept


def act(scan: Scan, action: Action, rule: Rule = Rule.ALPHABETICAL, protected: Sequence[str] = (), archive_dir: str | None = None, folders: bool = False, apply: bool = False, journal_file: str | None = None, history_folder: str | None = None) -> execute.Report:
    """Keeps one copy of each group and acts on the others: a dry run unless apply is given.

    With folders, whole folders go first, while all files that they rest on are there: each file of a folder only with a
    confirmed copy at the same place in the one that stays, else the folder is left alone. Groups that aren't wholly below
    claimed folders follow, without the files that went with a folder. Right before each action, both the file and its kept
    copy must be the regular files that the scan saw, by size and mtime; else the row, or the whole folder, is stale and
    nothing is done to it. The journal is written as files are acted on, and the history at the end, of applied actions alone.
    """
    done = execute.Report()
    spark, members = scan.files.sparkSession, scan.members
    journal = Journal(journal_file) if journal_file else None
    if action is Action.REPORT:
        return _recorded(scan, action, done, apply, history_folder)
    if folders:
        whole = replace(scan.options, min_size=None, max_size=None, include_extensions=None, exclude_extensions=None)
        files = scan.files if whole == scan.options else treewalk.tree(spark, scan.root, whole).files
        matches = scan.folders().collect()  # claimed matches: folders, not files
        for removed, kept in folder_actions(matches):
            try:
                pairs = actions.folder_pairs(files, members, removed, kept, protected)
                rows = list(_stamped(pairs, "remove", "keep", scan.members))
                shielded = files.where(paths.under(F.col("path"), removed) & paths.under_any(F.col("path"), protected)).count()
                one = execute.apply_folder(removed, rows, action, archive_dir, shielded, apply, journal)
            except (NoConfirmedDuplicate, NotADirectory) as e:
                done.failed.append((removed, str(e)))
                continue
            done.succeeded += one.succeeded
            done.failed += one.failed
            done.stale += one.stale
            done.bytes_reclaimed += one.bytes_reclaimed
        claimed = [f for m in matches for f in (m["folders"] if m["kind"] == "exact" else [m["subset"]])]
        if claimed:
            members = actions.uncovered(members, spark.createDataFrame([(f,) for f in claimed], "root string"))
        if done.succeeded:
            members = members.join(spark.createDataFrame([(p,) for p in done.succeeded], "path string"), "path", "left_anti")
        members = members.join(exact.several(members, ["group_id"]).select("group_id"), "group_id", "left_semi")
    plan = actions.planned(members, action, rule, protected, archive_dir)
    for part in _parts(_stamped(plan, "path", "kept", scan.members)):
        execute.apply_rows(part, action, archive_dir, apply, journal, done)
    return _recorded(scan, action, done, apply, history_folder)


def _recorded(scan: Scan, action: Action, done: execute.Report, apply: bool, folder: str | None) -> execute.Report:
    if folder:
        spark = scan.files.sparkSession
        rows: DataFrame | None = None
        if apply and (done.succeeded or done.failed):
            sizes = scan.files.select("path", F.col("size").alias("bytes"))
            tried = [(p, True, None) for p in done.succeeded] + [(p, False, e) for p, e in done.failed]
            rows = spark.createDataFrame(tried, "path string, succeeded boolean, error string").join(sizes, "path", "left").withColumn("kind", F.lit(action.value))
        found = scan.summary().first()
        row = {**found.asDict(), "root": scan.root, "started_at": int(time.time()), "action_kind": None if action is Action.REPORT else action.value, "action_applied": apply, "bytes_reclaimed": done.bytes_reclaimed if apply else 0, "files_acted_on": len(done.succeeded) if apply else 0}
        history.record(spark, folder, row, rows)
    return done
