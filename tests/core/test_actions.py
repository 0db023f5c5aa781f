"""Plans, journals, executors, history, profiles and the stream, on temporary trees alone."""

from __future__ import annotations

import json
import os

import pytest

from siftline.functions import values
from siftline.model import SCANS, Action, NoConfirmedDuplicate, PlanFileError, Rule
from siftline.operators import actions, history, keep
from siftline.operators.components import components
from siftline.plans import act, execute
from siftline.plans.scan import scan
from siftline.sources.records import Journal, Profiles, read_plan, write_plan
from siftline.streaming import arrivals
from tests.core.test_files import put


def test_plan_apply_undo(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path / "t", {"a": b"same", "b": b"same", "d/c": b"same", "x": b"other", "y": b"other"})
    os.link(f"{root}/a", f"{root}/a2")
    s = scan(spark, root)
    plan = actions.planned(s.members, Action.MOVE, archive_dir=str(tmp_path / "old"))
    assert sorted(os.path.relpath(r["path"], root) for r in plan.collect()) == ["b", "d/c", "y"]
    assert tuple(actions.totals(plan).first()) == (2, 3, 13, 13)
    file = str(tmp_path / "plan.json")
    assert write_plan(plan, root, Action.MOVE, file, str(tmp_path / "old")) == 3
    journal = str(tmp_path / "journal")
    dry = execute.apply_plan(file)
    assert len(dry.succeeded) == 3 and os.path.exists(f"{root}/b")
    done = execute.apply_plan(file, apply=True, journal_file=journal)
    assert len(done.succeeded) == 3 and not done.failed and done.bytes_reclaimed == 13 and not os.path.exists(f"{root}/b")
    assert len(execute.apply_plan(file).stale) == 2
    assert [r["op"] for r in Journal(journal).rows(spark).orderBy("seq").collect()] == ["move"] * 3
    back = execute.undo(journal, apply=True)
    assert len(back.succeeded) == 3 and open(f"{root}/d/c", "rb").read() == b"same"
    assert len(execute.undo(journal, apply=True).failed) == 3


def test_stale_groups(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path / "t", {"a": b"11", "b": b"11", "c": b"22", "d": b"22"})
    file = str(tmp_path / "plan.json")
    write_plan(actions.planned(scan(spark, root).members, Action.DELETE), root, Action.DELETE, file)
    os.utime(f"{root}/a", ns=(1, 1))
    done = execute.apply_plan(file, apply=True)
    assert len(done.stale) == 1 and [os.path.basename(p) for p in done.succeeded] == ["d"] and os.path.exists(f"{root}/b")


@pytest.mark.parametrize("change", [{"format": "x"}, {"version": 9}, {"more": 1}, {"action": {"kind": "move"}}, {"groups": [{"size": 1}]}])
def test_bad_plans(spark, tmp_path, change: dict) -> None:  # noqa: ANN001
    root = put(tmp_path / "t", {"a": b"1", "b": b"1"})
    file = tmp_path / "plan.json"
    write_plan(actions.planned(scan(spark, root).members, Action.DELETE), root, Action.DELETE, str(file))
    assert read_plan(str(file))["version"] == 1
    file.write_text(json.dumps(json.loads(file.read_text()) | change))
    with pytest.raises((PlanFileError, ValueError)):
        read_plan(str(file))
    file.write_text("{\n]")
    with pytest.raises(PlanFileError, match="line 2"):
        read_plan(str(file))


def test_bad_journal(tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "j").write_text('{"op":"delete","path":"/a"}\n\n{"op":"delete"}\n')
    with pytest.raises(PlanFileError, match="line 3"):
        Journal(str(tmp_path / "j")).entries()


def test_executors(tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"k": b"1", "h": b"1", "d": b"1", "m": b"1", "c": b"1", "t": b"1"})
    act = lambda a, n: execute.act(a, f"{root}/{n}", f"{root}/k", f"{root}/arch")
    act(Action.HARDLINK, "h")
    assert os.path.samefile(f"{root}/h", f"{root}/k")
    act(Action.DELETE, "d")
    assert not os.path.exists(f"{root}/d")
    to = act(Action.MOVE, "m")["to"]
    assert os.path.exists(to) and to == f"{root}/arch{root}/m"
    act(Action.COPY, "c")
    assert os.path.exists(f"{root}/c") and os.path.exists(f"{root}/arch{root}/c")
    with pytest.raises(FileExistsError):
        act(Action.COPY, "c")
    execute.trash(f"{root}/t", f"{root}/Trash")
    assert os.listdir(f"{root}/Trash/files") == ["t"]
    try:
        act(Action.REFLINK, "c")
    except OSError:
        assert not [n for n in os.listdir(root) if n.startswith(".siftline")]
    assert open(f"{root}/c", "rb").read() == b"1"
    done = execute.apply_rows([(f"{root}/gone", f"{root}/k", 1), (f"{root}/c", f"{root}/k", 1)], Action.DELETE, apply=True)
    assert len(done.failed) == len(done.succeeded) == 1


def test_folder_plans(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"a/1": b"1", "a/s/2": b"22", "b/1": b"1", "b/s/2": b"22", "c/1": b"1", "c/only": b"zzz"})
    s = scan(spark, root)
    pairs = actions.folder_pairs(s.files, s.members, f"{root}/b", f"{root}/a")
    rows = sorted((r["remove"], r["keep"], r["size"]) for r in pairs.collect())
    assert [os.path.relpath(x, root) for r in rows for x in r[:2]] == ["b/1", "a/1", "b/s/2", "a/s/2"]
    with pytest.raises(NoConfirmedDuplicate):
        actions.folder_pairs(s.files, s.members, f"{root}/c", f"{root}/a")
    kept = actions.folder_pairs(s.files, s.members, f"{root}/c", f"{root}/a", [f"{root}/c/only"])
    assert kept.count() == 1
    assert not execute.apply_folder(f"{root}/b", rows, Action.DELETE).directory_removed
    done = execute.apply_folder(f"{root}/b", rows, Action.DELETE, apply=True)
    assert done.directory_removed and not os.path.exists(f"{root}/b")
    left = execute.apply_folder(f"{root}/c", [(f"{root}/c/1", f"{root}/a/1", 1)], Action.DELETE, apply=True)
    assert not left.directory_removed and os.path.exists(f"{root}/c/only")


def test_keep_rules(spark) -> None:  # noqa: ANN001
    rows = [("g", "/a/x/1", 5, 1), ("g", "/b", 9, 2), ("g", "/c/2", 9, 3), ("h", "/p", None, 4), ("h", "/o", None, 5)]
    m = spark.createDataFrame([(g, p, 1, t, 0, i) for g, p, t, i in rows], "group_id string, path string, size long, mtime_ns long, dev long, ino long")
    pick = lambda rule, *safe: {r["group_id"]: (r["kept"], r["keep_reason"]) for r in keep.kept(m, rule, safe).collect()}
    assert pick(Rule.ALPHABETICAL)["g"] == ("/a/x/1", "alphabetically first")
    assert pick(Rule.NEWEST) == {"g": ("/b", "most recent modification time"), "h": ("/o", keep.UNREADABLE)}
    assert pick(Rule.OLDEST)["g"] == ("/a/x/1", "oldest modification time")
    assert pick(Rule.SHORTEST_PATH)["g"] == ("/b", "shortest path")
    assert pick(Rule.LONGEST_PATH)["g"] == ("/a/x/1", "longest path")
    assert pick(Rule.NEWEST, "/c")["g"] == ("/c/2", keep.PROTECTED)


def test_history(spark, tmp_path) -> None:  # noqa: ANN001
    folder = str(tmp_path)
    assert history.read(spark, folder).count() == 0
    assert history.stats(history.read(spark, folder)).first()["bytes_scanned"] == 0
    for k in range(3):
        acts = spark.createDataFrame([("/x", "delete", 3, True, None)], "path string, kind string, bytes long, succeeded boolean, error string") if k else None
        assert history.record(spark, folder, {"root": "/r", "started_at": 100 + k % 2, "files_scanned": 5, "bytes_scanned": 7, "duplicate_groups": 1, "duplicate_files": 2}, acts) == k + 1
    assert [r["id"] for r in history.latest(history.read(spark, folder), 2).collect()] == [2, 3]
    assert history.stats(history.read(spark, folder), since=101).first()["scans"] == 1
    assert history.read(spark, folder, "actions").count() == 2
    assert len(history.exported(history.read(spark, folder))) == 3


def test_profiles(tmp_path) -> None:  # noqa: ANN001
    p = Profiles(str(tmp_path / "p.json"))
    assert p.all() == []
    p.save("a", "/1", {})
    p.save("b", "/2", {"min_size": 1})
    p.save("a", "/3", {})
    assert [x["root"] for x in p.all()] == ["/3", "/2"]
    p.remove("a")
    assert [x["name"] for x in p.all()] == ["b"]


def test_stream(spark, tmp_path) -> None:  # noqa: ANN001
    schema = "path string, size long, mtime_ns long, content binary"
    for batch, rows in enumerate(([("/a", 1, 1, b"1"), ("/b", 1, 1, b"1")], [("/c", 1, 2, b"1"), ("/b", 1, 3, b"2")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arrivals.keep(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/ck").awaitTermination()
        now = arrivals.groups(arrivals.current(spark, f"{tmp_path}/cache")).collect()
        small = arrivals.compacted(spark, f"{tmp_path}/cache", f"{tmp_path}/cache-{len(os.listdir(tmp_path))}")
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, arrivals.current(spark, f"{tmp_path}/cache").collect()))
        assert [r["files"] for r in now] == [2], batch


def test_components(spark) -> None:  # noqa: ANN001
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(1000, 7), (7, 1000), (5, 5)] + [(3000, 3000 + i) for i in range(1, 100)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert found == {**{i: i // 50 * 50 for i in range(200) if i % 50}, 1000: 0, **{3000 + i: 3000 for i in range(1, 100)}}


def test_option_helpers(spark) -> None:  # noqa: ANN001
    assert values.parse_size(' "4 KB" ') == 4096 and values.parse_size("1.5m") == 1572864 and values.parse_size("") is None
    assert values.parse_list(" 'a', b ,,") == ["a", "b"]
    assert values.confirmed(" Yes ") and not values.confirmed("no")
    assert values.cache_batch(1) == 256 and values.cache_batch(1 << 31) == 1
    with pytest.raises(ValueError, match="archive"):
        Action.parse("move")
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        values.from_little_endian(F.lit("db8881b16c4f743a75c09b4fec87d411")).alias("h"), values.human_bytes(F.lit(1536)).alias("b"), values.ago(F.lit(0), F.lit(7_200_000)).alias("a"), values.percent(F.lit(0), F.lit(0)).alias("p")
    ).first()
    assert tuple(row) == ("11d487ec4f9bc0753a744f6cb18188db", "1.5 KB", "2h ago", 100.0)
    assert int(row["h"], 16) == 23700399710133407773276464628843514075


def tree(folder) -> str:  # noqa: ANN001
    """Two equal folders, one contained in another, a group half inside a claimed folder, and one outside."""
    return put(folder, {"p/a": b"one", "p/b": b"two!", "q/a": b"one", "q/b": b"two!", "big/x": b"three", "big/y": b"four4", "sub/x": b"three", "alone/a": b"one", "alone/z": b"no other", "m": b"fives", "n": b"fives"})


@pytest.mark.parametrize("action", [Action.DELETE, Action.TRASH, Action.HARDLINK, Action.MOVE, Action.COPY])
def test_act_with_folders(spark, tmp_path, monkeypatch, action: Action) -> None:  # noqa: ANN001
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "home"))
    root, archive, hist, journal = tree(tmp_path / "t"), str(tmp_path / "old"), str(tmp_path / "h"), str(tmp_path / "j")
    s = scan(spark, root)
    here = lambda: sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    before = here()
    dry = act.act(s, action, archive_dir=archive, folders=True)
    assert here() == before and not dry.failed
    done = act.act(s, action, archive_dir=archive, folders=True, apply=True, journal_file=journal, history_folder=hist)
    names = sorted(os.path.relpath(p, root) for p in done.succeeded)
    assert sorted(dry.succeeded) == sorted(done.succeeded) and not done.failed and not done.stale
    assert names == ["n", "p/a", "q/a", "q/b", "sub/x"] and "alone/a" in here()
    if action in (Action.DELETE, Action.TRASH, Action.MOVE):
        assert not os.path.exists(f"{root}/q") and not os.path.exists(f"{root}/sub")
    else:
        assert here() == before
    # whatever was done, each content is still there
    assert {open(os.path.join(root, f), "rb").read() for f in here()} == {b"one", b"two!", b"three", b"four4", b"fives", b"no other"}
    assert history.read(spark, hist).first()["files_acted_on"] == len(names)
    assert history.read(spark, hist, "actions").where("succeeded").count() == len(set(names))
    assert len(Journal(journal).entries()) == len(names)


def test_act_leaves_what_it_must(spark, tmp_path) -> None:  # noqa: ANN001
    root = tree(tmp_path / "t")
    s = scan(spark, root)
    done = act.act(s, Action.DELETE, protected=[f"{root}/q", f"{root}/n"], folders=True, apply=True)
    assert os.path.exists(f"{root}/q/a") and os.path.exists(f"{root}/n") and not os.path.exists(f"{root}/m")
    assert not done.failed
    again = tree(tmp_path / "u")
    s = scan(spark, again)
    os.unlink(f"{again}/m")  # the file that would stay is gone
    done = act.act(s, Action.DELETE, apply=True)
    assert os.path.exists(f"{again}/n") and f"{again}/n" in done.stale
    assert act.act(s, Action.REPORT, apply=True).succeeded == []


def test_folders_are_claimed_as_one_by_one(spark) -> None:  # noqa: ANN001
    """Rounds on tables claim what a walk over all folders in order claims."""
    import random

    from siftline.operators import folders

    r = random.Random(5)
    for tree_number in range(6):
        dirs = ["/t"]
        for k in range(50):
            dirs.append(f"{r.choice(dirs)}/{k % 7}{r.choice('ab')}")
        dirs = sorted(set(dirs))
        of = {d: r.randrange(14) for d in dirs if r.random() < 0.7}
        subs = [d for d in dirs if d not in of and r.random() < 0.5]
        if tree_number < 5:  # the last needs several rounds
            continue
        taken: set[str] = set()
        done: set[int] = set()
        free = lambda d: not any(d == t or d.startswith(t + "/") for t in taken)  # noqa: B023, E731
        for d in sorted({*of, *subs}, key=lambda d: (d.count("/"), d.split("/"))):
            if not free(d):
                continue
            if d in subs:
                taken.add(d)
            elif of[d] not in done:
                done.add(of[d])
                own = [x for x in of if of[x] == of[d] and free(x)]
                taken.update(own if len(own) > 1 else ())
        clusters = spark.createDataFrame([(str(k), d) for d, k in of.items()], "sig string, dir string")
        subsets = spark.createDataFrame([(d,) for d in subs], "subset string")
        assert {x["dir"] for x in folders.claimed(clusters, subsets).collect()} == taken


def test_writers_of_history_at_once(spark, tmp_path) -> None:  # noqa: ANN001
    from concurrent.futures import ThreadPoolExecutor

    folder = f"file://{tmp_path}/h"
    row = {"root": "/r", "started_at": 1, "files_scanned": 5, "bytes_scanned": 7, "duplicate_groups": 1, "duplicate_files": 2}
    acts = spark.createDataFrame([("/a", "delete", 3, True, None)], "path string, kind string, bytes long, succeeded boolean, error string")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda _: history.record(spark, folder, row, acts), range(4)))
    assert sorted(ids) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in history.read(spark, folder).collect()) == [1, 2, 3, 4]
    assert sorted(r["scan_id"] for r in history.read(spark, folder, "actions").collect()) == [1, 2, 3, 4]
    # a writer that dies before it commits leaves an id unused, and nothing to see
    assert history.claimed(spark, folder) == 5
    spark.createDataFrame([tuple({**row, "id": 5}.get(f.split()[0]) for f in SCANS.split(", "))], SCANS).write.parquet(f"{folder}/scans/5")
    assert history.read(spark, folder).count() == 4
    assert history.record(spark, folder, row) == 6 and history.read(spark, folder).count() == 5


def _edited(path: str) -> None:
    st = os.stat(path)
    with open(path, "r+b") as f:
        f.write(b"!")  # as long as before
    os.utime(path, ns=(st.st_atime_ns, st.st_mtime_ns + 1))


def _linked(path: str) -> None:
    os.rename(path, f"{path}.real")
    os.symlink(f"{path}.real", path)


@pytest.mark.parametrize("change", [_edited, _linked, os.unlink], ids=["edited", "linked", "gone"])
@pytest.mark.parametrize("side", ["target", "kept"])
@pytest.mark.parametrize("folders", [False, True])
def test_nothing_is_done_to_files_that_changed_after_the_scan(spark, tmp_path, change, side: str, folders: bool) -> None:  # noqa: ANN001
    from siftline.plans import act

    root = put(tmp_path, {"a/1": b"same", "a/2": b"other", "b/1": b"same", "b/2": b"other", "x": b"third", "y": b"third"})
    s = scan(spark, root)
    if folders:
        stale, kept = ["b/1"], "a/1"
    else:
        stale, kept = ["y"], "x"
    change(f"{root}/{stale[0] if side == 'target' else kept}")
    done = act.act(s, Action.DELETE, folders=folders, apply=True)
    assert [os.path.relpath(p, root) for p in done.stale] == stale and not done.failed
    gone = {"b/1", "b/2", "y"} - set(stale) - ({"b/2"} if folders else set())
    assert {os.path.relpath(p, root) for p in done.succeeded} == gone
    touched = {stale[0] if side == "target" else kept}
    here = {os.path.relpath(os.path.join(d, f), root).removesuffix(".real") for d, _, fs in os.walk(root) for f in fs}
    assert here == {"a/1", "a/2", "b/1", "b/2", "x", "y"} - gone - (touched if change is os.unlink else set())
