"""Folder roll-up and containment, against the plain way."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import takewhile

import pytest
from pyspark.sql import functions as F

from siftline.operators import folders
from siftline.tables import saved


def above(path: str, root: str) -> list[str]:
    parts = path.split("/")
    return [d for d in ("/".join(parts[:i]) or "/" for i in range(1, len(parts))) if d == root or d.startswith(root.rstrip("/") + "/")]


def plain(files: list[tuple[str, int, str | None]], root: str) -> tuple[set, set]:
    """Exact clusters and (subset, superset) pairs."""
    content: dict[str, dict[str, str | None]] = defaultdict(dict)
    for path, _, gid in files:
        for d in above(path, root):
            content[d][path[len(d.rstrip("/")) + 1 :]] = gid
    whole = {d: frozenset(c.items()) for d, c in content.items() if None not in c.values()}
    same = defaultdict(set)
    for d, c in whole.items():
        same[c].add(d)
    clusters = {frozenset(x) for x in same.values() if len(x) > 1}
    alone = {d for x in same.values() if len(x) == 1 for d in x}
    held = {(s, t) for s in alone for t, c in content.items() if s != t and whole[s] <= set(c.items())}
    return clusters, held


def table(spark, files, root: str):  # noqa: ANN001, ANN201
    every = spark.createDataFrame([(p, s) for p, s, _ in files], "path string, size long")
    members = spark.createDataFrame([(p, g) for p, _, g in files if g is not None], "path string, group_id string")
    own = saved(folders.entries(every, members, root), "entries")
    return folders.rolled(own, root), own


def check(spark, files, root: str):  # noqa: ANN001, ANN201
    found, own = table(spark, files, root)
    clusters, held = plain(files, root)
    got = defaultdict(set)
    for r in folders.exact(found, own).collect():
        got[r["sig"]].add(r["dir"])
    assert {frozenset(x) for x in got.values()} == clusters
    assert {(r["subset"], r["superset"]) for r in folders.contained(found, own).collect()} == held
    sizes, counts = defaultdict(int), defaultdict(int)
    for path, size, _ in files:
        for d in above(path, root):
            sizes[d] += size
            counts[d] += 1
    assert {r["dir"]: (r["file_count"], r["bytes"]) for r in found.collect()} == {d: (counts[d], sizes[d]) for d in counts}
    return clusters, held


@pytest.mark.parametrize("seed", range(5))
def test_random_trees(spark, seed: int) -> None:  # noqa: ANN001
    r = random.Random(seed)
    files = {}
    for _ in range(260):
        path = "/t/" + "/".join(r.choice("abc") for _ in range(r.randint(0, 4)))
        files[f"{path.rstrip('/')}/{r.choice(['f', 'g', 'h'])}.x"] = r.choice(["1", "2", "3", None] if seed % 2 else ["1", "2"])
    rows = [(p, 10 if g is None else int(g), g) for p, g in files.items()]
    clusters, held = check(spark, rows, "/t")
    assert clusters and held


def test_odd_trees(spark) -> None:  # noqa: ANN001
    assert check(spark, [("/x/1", 1, "a"), ("/y/1", 1, "a"), ("/y/2", 1, "b"), ("/1", 1, "a")], "/")[1]
    # outside of the root, names that begin alike, null groups, a folder that holds itself deeper down
    files = [("/t/a/f", 1, "1"), ("/t/a/a/f", 1, "1"), ("/t/a/a/g", 2, "2"), ("/t/ab/f", 1, "1"), ("/t/ab/g", 3, None), ("/tt/a/f", 1, "1"), ("/t/c/d/f", 1, "1"), ("/t/c/d/h", 1, None)]
    check(spark, files, "/t")
    found, own = table(spark, [], "/t")
    assert found.count() == folders.exact(found, own).count() == folders.contained(found, own).count() == 0


def test_rows_grow_with_folders_not_with_depth(spark) -> None:  # noqa: ANN001
    """A chain of folders above many files: one entry a file, one row a folder, and no candidate that sizes rule out."""
    deep = "/t/" + "/".join(f"d{i}" for i in range(30))
    files = [(f"{deep}/f{i}", 1, f"g{i}") for i in range(50)] + [(f"/t/copy/f{i}", 1, f"g{i}") for i in range(49)]
    found, own = table(spark, files, "/t")
    assert own.count() == 99 and found.count() == 32
    pairs = folders.candidates(found, own).collect()
    assert {(p["subset"], p["superset"]) for p in pairs} == {("/t/copy", deep)}
    assert [(r["subset"], r["superset"]) for r in folders.contained(found, own).collect()] == [("/t/copy", deep)]


def test_common_files_leave_few_candidates(spark, monkeypatch) -> None:  # noqa: ANN001
    """Where each file is met in very many folders, several together narrow candidates down; nesting is kept."""
    monkeypatch.setattr(folders, "FEW", 4)
    r = random.Random(11)
    rows = []
    for i in range(150):
        for side in "ab"[: r.randint(1, 2)]:
            rows += [(f"/t/{i}/{side}/{n}", 1, r.choice("123")) for n in range(r.randint(3, 6))]
    clusters, held = check(spark, rows, "/t")
    assert clusters and held
    found, own = table(spark, rows, "/t")
    pairs = folders.candidates(found, own).collect()
    asked = {p["subset"] for p in pairs}
    assert len(pairs) <= folders.FEW * len(asked) + len(held)  # the rarest file alone leaves many times as many


def test_a_shared_signature_is_not_enough(spark, monkeypatch) -> None:  # noqa: ANN001
    """Folders whose hashes collide are told apart by what is in them."""
    monkeypatch.setattr(folders, "_lanes", lambda *c: [F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")])
    files = [("/t/a/f", 1, "1"), ("/t/b/f", 1, "1"), ("/t/c/f", 1, "2"), ("/t/d/e", 1, "1")]
    found, own = table(spark, files, "/t")
    assert {r["dir"] for r in folders.exact(found, own).collect()} == {"/t/a", "/t/b"}


def test_which_folder_stays(spark) -> None:  # noqa: ANN001
    from siftline.operators import keep

    rows = [("x", 2, d) for d in ("/a/b", "/a-b", "/z")] + [("y", 1, d) for d in ("/\U0001f600", "/\ufb00")]
    clusters = spark.createDataFrame(rows, "sig string, file_count long, dir string")
    of = lambda df: {r["sig"]: (r["kept"], r["removed"]) for r in df.collect()}
    assert of(keep.kept_folders(clusters)) == {"x": ("/a/b", 2), "y": ("/\ufb00", 1)}
    # UTF-16 puts what lies beyond 16 bits before the last characters below
    assert of(keep.kept_folders(clusters, by_text=True)) == {"x": ("/a-b", 2), "y": ("/\U0001f600", 1)}
    chosen = spark.createDataFrame([("/z",), ("/elsewhere",)], "dir string")
    assert of(keep.kept_folders(clusters, chosen=chosen)) == {"x": ("/z", 2), "y": ("/\ufb00", 1)}


def test_line_entries_move_twice(spark) -> None:  # noqa: ANN001
    """By part and by order; without the rarest file, entries meet no numbers, and folders come out the same."""
    from siftline import queries

    own = queries._line_entries(spark, "/root/testdata/sf0.001")
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join") == 1 and plan.count("Window [") == 1
    held = saved(own, "entries")
    plain_, rare = (folders.rolled(held, "/t", r) for r in (False, True))
    assert "rare" not in plain_.columns
    assert sorted(map(tuple, plain_.collect())) == sorted(map(tuple, rare.drop("rare").collect()))


@pytest.mark.parametrize("few", [1, 3, 16])
def test_flat_matches(spark, monkeypatch, few: int) -> None:  # noqa: ANN001
    """By own files alone, whether files are met seldom, often, or in one folder both; as the plain way, clusters too."""
    monkeypatch.setattr(folders, "FEW", few)
    r = random.Random(few)
    rows = []
    for i in range(160):
        # contents of the later names are met less often
        rows += [(f"/t/{i}/{n}", r.randrange(9), r.choice(["1", "2", *"345678"[: n * 2]]) if r.random() < 0.97 else None) for n in range(r.randint(1, 4))]
    every = spark.createDataFrame(rows, "path string, size long, gid string")
    own = saved(folders.marked(folders.placed(every)), "entries")
    same, within = folders.flat_matches(own)
    clusters, held = plain(rows, "/t")
    got, sizes, counts = defaultdict(set), defaultdict(int), defaultdict(int)
    for path, size, _ in rows:
        sizes[above(path, "/t")[-1]] += size
        counts[above(path, "/t")[-1]] += 1
    for x in same.collect():
        got[x["sig"]].add(x["dir"])
        assert (x["file_count"], x["bytes"]) == (counts[x["dir"]], sizes[x["dir"]])
    assert {frozenset(x) for x in got.values()} == clusters
    found = [(x["subset"], x["superset"], x["file_count"], x["bytes"]) for x in within.collect()]
    assert sorted(found) == sorted((s, t, counts[s], sizes[s]) for s, t in held if t != "/t") and found
    empty = saved(folders.marked(folders.placed(every.limit(0))), "entries")
    assert [df.count() for df in folders.flat_matches(empty)] == [0, 0]


@pytest.mark.parametrize("name", ["folder_contained", "event_folders"])
def test_pairs_of_line_folders_are_few(spark, monkeypatch, name: str) -> None:  # noqa: ANN001
    """Line items are written once, by one move, and hardly a pair is written that doesn't match."""
    from siftline import queries

    written = defaultdict(int)
    save = folders.saved

    def counted(df, label):  # noqa: ANN001, ANN202
        out = save(df, label)
        if label == "entries":
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1
        written[label] += out.count()
        return out

    monkeypatch.setattr(folders, "saved", counted)
    monkeypatch.setattr(queries, "saved", counted)
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01").count()
    items = written.pop("entries")
    assert items == spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert rows and sum(written.values()) < items


def test_no_saved_table_is_gathered_by_its_file_size(spark, monkeypatch) -> None:  # noqa: ANN001
    """Saved tables are small as files and many times larger in memory: only what a shuffle has measured, or a count, is handed to all tasks."""
    from siftline import queries

    save, gathered = folders.saved, []

    def looked_at(df, label):  # noqa: ANN001, ANN202
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for k, line in enumerate(lines):
            if "BroadcastExchange" in line:
                at = line.index("BroadcastExchange")
                below = list(takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > at, lines[k + 1 :]))
                if not any("Exchange" in x for x in below):
                    gathered.append((label, *below))
        return save(df, label)

    monkeypatch.setattr(folders, "HANDED", 0, raising=False)
    monkeypatch.setattr(folders, "saved", looked_at)
    assert queries.QUERIES["folder_matches"](spark, "/root/testdata/sf0.001").count() > 0
    assert not gathered
