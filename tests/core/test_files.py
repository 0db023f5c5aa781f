"""Scans of real trees: walking, the funnel, caches, folders and images."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.model import InvalidRoot, ScanOptions
from siftline.operators import cache, report, similar
from siftline.plans.scan import scan, verified
from siftline.sources import fswalk, treewalk
from siftline.sources.hashstore import HashStore
from siftline.tables import saved

SMALL = ScanOptions(small_file_threshold=128, partial_hash_sample_size=128)


def put(root, files: dict[str, bytes]) -> str:  # noqa: ANN001
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def found(s, root: str) -> list[list[str]]:  # noqa: ANN001
    return sorted([os.path.relpath(p, root) for p in r["paths"]] for r in s.groups().collect())


def test_funnel(spark, tmp_path) -> None:  # noqa: ANN001
    big = bytes(range(256)) * 16
    root = put(tmp_path, {"a": b"same content", "b": b"same content", "c": b"different!!!", "e1": b"", "sub/e2": b"", "big1": big, "big2": big, "big3": big[:-1] + b"x", "big4": big[:1000] + b"y" + big[1001:], "lonely": b"z" * 99, ".hidden": b"same content", "_u": b"q"})
    os.link(f"{root}/lonely", f"{root}/lonely-link")
    os.link(f"{root}/a", f"{root}/a-link")
    os.symlink(f"{root}/a", f"{root}/soft")
    s = scan(spark, root, SMALL)
    assert found(s, root) == [[".hidden", "a", "a-link", "b"], ["big1", "big2"], ["e1", "sub/e2"]]
    total = s.summary().first()
    assert (total["files_scanned"], total["duplicate_groups"], total["duplicate_files"]) == (14, 3, 8)
    assert s.counters["sampled"] == 4 and s.counters["hashed"] < s.counters["same_size"]
    assert s.errors.count() == 0
    for sample in (1, 7, 4096):
        assert found(scan(spark, root, ScanOptions(small_file_threshold=16, partial_hash_sample_size=sample)), root) == found(s, root)
    assert found(scan(spark, root, ScanOptions(verify=True)), root) == found(s, root)


def test_cache(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {f"f{k}": bytes([k // 2]) * 64 for k in range(12)})
    first = scan(spark, root)
    again = scan(spark, root, cache=first.cache)
    assert found(again, root) == found(first, root) and again.counters["hashed"] == 0 and again.counters["cached"] == 12
    (tmp_path / "f1").write_bytes(b"new" + b"!" * 61)
    os.utime(tmp_path / "f1", ns=(1, 1))
    changed = scan(spark, root, cache=first.cache)
    assert ["f0", "f1"] not in found(changed, root) and changed.counters["hashed"] == 1
    assert changed.cache.count() == 12


def test_imported_hashes(spark, tmp_path) -> None:  # noqa: ANN001
    import xxhash

    root = put(tmp_path, {"a": b"1" * 50, "b": b"1" * 50, "c": b"2" * 50})
    st = os.stat(f"{root}/a")
    row = (fswalk.signed(st.st_dev), st.st_ino, 0, 4096, st.st_mtime_ns // 10**6, 50, 50, xxhash.xxh3_128_hexdigest(b"1" * 50))
    held = spark.createDataFrame([row], "dev long, ino long, chunk_pos long, chunk_len long, modified_ms long, file_len long, data_len long, hash string")
    s = scan(spark, root, imported=held)
    assert found(s, root) == [["a", "b"]] and s.counters["cached"] == 1


def test_walk(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"a.JPG": b"1" * 10, "b.tmp": b"2" * 21, "c": b"3" * 20, "x/d.png": b"4" * 9, "x/y/e.jpg": b"5" * 15, "xy/f.jpg": b"6" * 15})
    names = lambda **o: sorted(os.path.relpath(r["path"], root) for r in fswalk.walk(spark, root, ScanOptions(**o))[0].collect())
    assert names() == ["a.JPG", "b.tmp", "c", "x/d.png", "x/y/e.jpg", "xy/f.jpg"]
    assert names(min_size=10, max_size=20) == ["a.JPG", "c", "x/y/e.jpg", "xy/f.jpg"]
    assert names(include_extensions=("jpg", "PNG"), exclude_extensions=("png",)) == ["a.JPG", "x/y/e.jpg", "xy/f.jpg"]
    assert names(include_extensions=()) == names()
    assert names(exclude_paths=(f"{root}/x", f"{root}/c")) == ["a.JPG", "b.tmp", "xy/f.jpg"]
    files, _ = fswalk.walk(spark, f"{root}/c")
    assert [r["path"] for r in files.collect()] == [f"{root}/c"]
    with pytest.raises(InvalidRoot):
        fswalk.walk(spark, f"{root}/nothing")
    with pytest.raises(InvalidRoot):
        scan(spark, f"{root}/c")


def test_links(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"d/a": b"1"})
    os.symlink(f"{root}/d", f"{root}/d/loop")
    files, errors = fswalk.walk(spark, root, ScanOptions(follow_symlinks=True))
    assert files.count() == 1 and errors.count() == 1
    os.chmod(f"{root}/d", 0o755)
    os.symlink(f"{root}/gone", f"{root}/broken")
    files, errors = fswalk.walk(spark, root, ScanOptions(follow_symlinks=True))
    assert sorted(r["stage"] for r in errors.collect()) == ["traversal", "traversal"]


def aged(root: str, *without: str) -> None:
    """All folders were last changed long ago."""
    for d, _, _ in os.walk(root, topdown=False):
        if os.path.relpath(d, root) not in without:
            os.utime(d, ns=(10**18, 10**18))


def rows_of(t, root: str) -> list[tuple]:  # noqa: ANN001
    return sorted((os.path.relpath(r["path"], root), r["size"], r["dev"], r["ino"], r["mtime_ns"]) for r in t.files.collect())


def test_second_walk_lists_only_what_changed(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"a/1": b"1", "a/b/2": b"22", "a/b/deep/er/5": b"5", "c/3": b"333", "d/old/x": b"x"})
    aged(root)
    first = treewalk.tree(spark, root)
    assert (first.listed, first.reused, first.files_scanned, first.bytes_scanned) == (8, 0, 5, 8)
    index = saved(first.index, "index")
    again = treewalk.tree(spark, root, index=index)
    assert (again.listed, again.reused) == (0, 8) and rows_of(again, root) == rows_of(first, root)
    assert (again.files_scanned, again.bytes_scanned) == (5, 8)
    key = lambda t: sorted(map(str, t.collect()))
    assert key(again.index) == key(index)
    # a new file, a new tree, a folder that is gone, one that is a link now, and one put back
    put(tmp_path, {"c/4": b"4444", "c/new/er/6": b"6"})
    os.rename(f"{root}/d/old", f"{root}/d/moved")
    os.rename(f"{root}/a/b/deep", f"{root}/elsewhere")
    os.symlink(f"{root}/elsewhere", f"{root}/a/b/deep")
    now = treewalk.tree(spark, root, index=index)
    assert rows_of(now, root) == rows_of(treewalk.tree(spark, root), root)
    assert (now.listed, now.reused) == (9, 1)  # all but a/: root, a/b, c, c/new, c/new/er, d, d/moved, elsewhere, elsewhere/er
    everything = treewalk.tree(spark, root, ScanOptions(rescan_all=True), index)
    assert everything.reused == 0 and rows_of(everything, root) == rows_of(now, root)


def test_an_index_reuses_stats(spark, tmp_path) -> None:  # noqa: ANN001
    """An edit in place leaves the folder as it was, so its listing stands; a scan looks at what it hashes again."""
    root = put(tmp_path, {"a/1": b"same!", "a/2": b"same!", "b/3": b"same!", "b/4": b"alone", "c/5": b"longer"})
    aged(root)
    first = scan(spark, root)
    index, cache = saved(first.index, "index"), saved(first.cache, "cache")
    put(tmp_path, {"a/1": b"other", "c/5": b"now it is far longer"})
    aged(root)
    again = scan(spark, root, index=index, cache=cache)
    assert again.counters["folders_listed"] == 0 and again.counters["folders_reused"] == 4
    assert found(again, root) == [["a/2", "b/3"]] and again.counters["hashed"] == 1 and again.counters["cached"] == 3
    put(tmp_path, {"b/4": b"other, longer"})
    aged(root)
    third = scan(spark, root, index=index)
    assert [(os.path.relpath(r["path"], root), r["stage"]) for r in third.errors.collect()] == [("b/4", "stat")]
    assert found(third, root) == [["a/2", "b/3"]]
    assert found(scan(spark, root, ScanOptions(rescan_all=True), index=index), root) == [["a/2", "b/3"]]


def test_what_an_index_does_not_hold(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"a/1.tmp": b"1", "a/2": b"22", "bad/3": b"333", "young/4": b"4", "deep/below/5": b"5"})
    with open(os.path.join(os.fsencode(root), b"bad", b"\xff"), "wb"):
        pass
    aged(root, "young")
    first = treewalk.tree(spark, root)
    assert first.errors.count() == 1
    index = saved(first.index, "index")
    held = {os.path.relpath(r["dir"], root) for r in index.where("kind = 'dir'").collect()}
    assert held == {".", "a", "deep", "deep/below"}
    again = treewalk.tree(spark, root, index=index)
    assert (again.listed, again.reused) == (2, 4) and rows_of(again, root) == rows_of(first, root) and again.errors.count() == 1
    # other rules don't fit it, the same ones do
    for options in (ScanOptions(exclude_extensions=("tmp",)), ScanOptions(exclude_paths=(f"{root}/deep",)), ScanOptions(min_size=2), ScanOptions(cross_filesystems=True), ScanOptions(follow_symlinks=True)):
        other = treewalk.tree(spark, root, options, index)
        assert other.reused == 0 and rows_of(other, root) == rows_of(treewalk.tree(spark, root, options), root)
    narrow = ScanOptions(exclude_extensions=("tmp",), exclude_paths=(f"{root}/deep",))
    own = saved(treewalk.tree(spark, root, narrow).index, "index")
    again = treewalk.tree(spark, root, narrow, own)
    assert again.reused == 3 and rows_of(again, root) == rows_of(treewalk.tree(spark, root, narrow), root)  # young/ has aged
    assert treewalk.tree(spark, root, ScanOptions(follow_symlinks=True)).index.count() == 0


def test_lopsided_trees_are_dealt_to_all(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    """Nine tenths below one folder, a long chain, and a folder of very many files."""
    monkeypatch.setattr(treewalk, "DESCENT", (4, 16))
    monkeypatch.setattr(treewalk, "SLICE", 50)
    files = {f"big/{i}/{j}/f": b"x" for i in range(12) for j in range(6)} | {f"flat/{i}": b"y" for i in range(420)} | {"/".join(["chain"] * 40) + "/end": b"z", "s/f": b"s"}
    root = put(tmp_path, files)
    rounds = []
    real = treewalk._round

    def watched(todo, root, options, descent, parts, out):  # noqa: ANN001, ANN202
        rows, more = real(todo, root, options, descent, parts, out)
        rounds.append(sorted(r["n"] for r in rows.where("kind IN ('dir', 'file')").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()))
        return rows, more

    monkeypatch.setattr(treewalk, "_round", watched)
    t = treewalk.tree(spark, root, ScanOptions(read_parallelism=4))
    assert [r[0] for r in rows_of(t, root)] == sorted(files) and t.errors.count() == 0
    assert max(len(r) for r in rounds) == 4
    # no task of a later round does more than a slice for each item and its descent
    assert max(n for r in rounds for n in r) < 250 < sum(map(sum, rounds))


class Killed(Exception):
    pass


def test_a_killed_scan_goes_on_from_its_last_batch(spark, tmp_path) -> None:  # noqa: ANN001
    root, store = put(tmp_path / "t", {f"f{k:02}": bytes([k // 2]) * 100 for k in range(40)}), f"file://{tmp_path}/store"
    seen = []

    def until_third(event: dict) -> None:
        seen.append(event)
        if event["type"] == "hash_progress" and event["files_read"] and len({e["files_read"] for e in seen if "files_read" in e}) == 4:
            raise Killed

    with pytest.raises(Killed):
        scan(spark, root, store=store, progress=until_third, batch=(500, 1000))
    done = seen[-1]["files_read"]
    assert 0 < done < 40
    again = scan(spark, root, store=store, batch=(500, 1000))
    assert again.counters["cached"] == done and again.counters["hashed"] == again.counters["files_read"] == 40 - done
    assert found(again, root) == [[f"f{k:02}", f"f{k + 1:02}"] for k in range(0, 40, 2)]
    # a part that was written but not committed doesn't count
    held = HashStore(spark, f"{store}/sha256")
    parts = held.committed()
    os.unlink(f"{tmp_path}/store/sha256/commits/{parts[0]}")
    lost = held.rows(parts[:1]).count()
    third = scan(spark, root, store=store)
    assert third.counters["hashed"] == lost and third.counters["cached"] == 40 - lost
    held.compact()
    assert len(held.committed()) == 1 and scan(spark, root, store=store).counters["cached"] == 40
    put(tmp_path / "t", {"f00": b"?" * 100})
    os.utime(f"{root}/f00", ns=(1, 1))
    last = scan(spark, root, store=store)
    assert last.counters["hashed"] == 1 and found(last, root) == found(again, root)[1:]
    assert held.read().count() == 40


def test_counters_and_progress(spark, tmp_path) -> None:  # noqa: ANN001
    """Against a count by hand."""
    big, other = b"a" * 1000, b"a" * 400 + b"b" * 200 + b"a" * 400
    root = put(tmp_path, {"u": b"unique", "e1": b"", "e2": b"", "s1": b"small!!", "s2": b"small!!", "s3": b"smaLl!!", "b1": big, "b2": big, "b3": other})
    os.link(f"{root}/s1", f"{root}/s1-link")
    events = []
    s = scan(spark, root, ScanOptions(small_file_threshold=100, partial_hash_sample_size=100, verify=True), progress=events.append)
    # 3 samples of 300 bytes; 3 small files and 2 large ones hashed; both files of a group compared with its first
    c = s.counters
    assert c["files_read"] == 3 + 3 + 2 + 4 * 2
    assert c["bytes_read"] == 3 * 300 + 3 * 7 + 2 * 1000 + 4 * 7 + 4 * 1000
    assert (c["files"], c["same_size"], c["sampled"], c["hashed"], c["cached"]) == (10, 9, 3, 5, 0)
    assert (c["files_checked"], c["files_total"], c["bytes_checked"], c["bytes_total"]) == (10, 10, 3034, 3034)
    assert found(s, root) == [["b1", "b2"], ["e1", "e2"], ["s1", "s1-link", "s2"]]
    kinds = [e["type"] for e in events]
    assert kinds == ["progress"] + ["hash_progress"] * (len(kinds) - 1) and len(kinds) > 3
    assert [e["files_checked"] for e in events[1:]] == [3, 4, 10, 10]
    for name in ("files_read", "bytes_read", "files_checked", "bytes_checked"):
        values = [e[name] for e in events[1:]]
        assert values == sorted(values) and values[-1] == c[name]


def test_verify_reports_a_reference_once(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"a": b"same", "b": b"same", "c": b"same", "x": b"other", "y": b"other"})
    s = scan(spark, root)
    least = min("abc", key=lambda n: os.stat(f"{root}/{n}").st_ino)
    os.unlink(f"{root}/{least}")
    os.unlink(f"{root}/{max('xy', key=lambda n: os.stat(f'{root}/{n}').st_ino)}")
    kept, errors = verified(s.members)
    assert kept.count() == 0 and errors.count() == 2


def test_folders(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {
        "a/top": b"1", "a/sub/nested": b"22", "b/top": b"1", "b/sub/nested": b"22",
        "small/x": b"333", "big/x": b"333", "big/extra": b"unique", "outer/unique": b"u!", "outer/sub/dup": b"4444", "elsewhere/dup": b"4444",
    })
    rel = lambda p: p and os.path.relpath(p, root)
    rows = sorted((r["kind"], [rel(f) for f in r["folders"] or []], rel(r["subset"]), rel(r["superset"]), r["file_count"], r["bytes"]) for r in scan(spark, root).folders().collect())
    assert rows == [("contained", [], "small", "big", 1, 3), ("exact", ["a", "b"], None, None, 2, 3), ("exact", ["elsewhere", "outer/sub"], None, None, 1, 4)]


def test_folder_claims_do_not_depend_on_order(spark, tmp_path) -> None:  # noqa: ANN001
    root = put(tmp_path, {"p/x/f": b"1", "m/x/f": b"1", "q/f": b"1"})
    rows = [sorted(os.path.relpath(f, root) for f in r["folders"]) for r in scan(spark, root).folders().collect()]
    assert rows == [["m", "p"]]


def png(pixels: np.ndarray) -> bytes:
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = pixels.shape
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path) -> None:  # noqa: ANN001
    x, y = np.meshgrid(np.arange(64), np.arange(64))
    base = np.stack([200 - 2 * x, 3 * y % 200, x + y], 2).astype(np.uint8)
    board = np.where((x // 8 + y // 8) % 2, 255, 0)[:, :, None].repeat(3, 2).astype(np.uint8)
    root = put(tmp_path, {"a.png": png(base), "b.png": png(base + 5), "board.png": png(board), "bogus.png": b"no image", "n.txt": b""})
    rows = scan(spark, root).similar().collect()
    assert [[os.path.basename(p) for p in r["paths"]] for r in rows] == [["a.png", "b.png"]]


def test_similar_chain(spark) -> None:  # noqa: ANN001
    images = spark.createDataFrame([("/0", 0), ("/1", 1), ("/3", 3), ("/far", -1)], "path string, dhash long")
    rows = similar.similar_groups(images, 1).collect()
    assert [(r["paths"], r["max_distance"]) for r in rows] == [(["/0", "/1", "/3"], 2)]


def test_similar_pairs_at_all_distances(spark) -> None:  # noqa: ANN001
    r = np.random.default_rng(3)
    h = [int(v) for v in r.integers(-(2**63), 2**63, 30)]
    h += [int(np.int64(x) ^ np.int64(sum(1 << int(b) for b in r.choice(63, k, replace=False)))) for k in range(1, 14) for x in h[:5]]
    df = spark.createDataFrame(list(enumerate(h)), "id long, hash long")
    for k in (0, 1, 5, 10):
        wanted = {(i, j) for j in range(len(h)) for i in range(j) if (h[i] ^ h[j]).__and__((1 << 64) - 1).bit_count() <= k}
        assert {(p["a"], p["b"]) for p in similar.pairs(df, k).collect()} == wanted


def test_bands_leave_no_pair_out() -> None:
    for k in (0, 1, 3, 5, 10, 20, 63):
        cuts = similar.bands(k)
        assert sum(w for _, w, _ in cuts) == 64 and sum(e + 1 for _, _, e in cuts) == k + 1
    assert [(w, e) for _, w, e in similar.bands(10)] == [(16, 2), (16, 2), (16, 2), (16, 1)]
    assert len(similar.errors(16, 2)) == 1 + 16 + 120


def test_equal_and_near_images(spark) -> None:  # noqa: ANN001
    images = spark.createDataFrame([(f"/{i}", h) for i, h in enumerate([5, 5, 5, 4, -1, -1, 1 << 40, -(1 << 63)])], "path string, dhash long")
    rows = sorted((r["paths"], r["max_distance"]) for r in similar.similar_groups(images, 1).collect())
    assert rows == [(["/0", "/1", "/2", "/3"], 1), (["/4", "/5"], 0)]
    # 4, 1 << 40 and the lowest long have one bit each, so any two are 2 apart, and 5 is 3 from two of them
    assert (["/0", "/1", "/2", "/3", "/6", "/7"], 3) in [(r["paths"], r["max_distance"]) for r in similar.similar_groups(images, 2).collect()]


def test_wide_groups_by_blocks(spark, monkeypatch) -> None:  # noqa: ANN001
    """With a large k, blocks find the groups and distances that all pairs give, signs included; no pairs are listed."""
    monkeypatch.setattr(similar, "BLOCK", 40)
    monkeypatch.setattr(similar, "SMALL", 8)
    r = np.random.default_rng(5)
    for spread, k in ((12, 14), (64, 20)):
        heads = r.integers(-(2**63), 2**63, 12)
        flips = [sum(1 << int(b) for b in r.choice(64, int(r.integers(0, spread // 2)), replace=False)) for _ in range(400)]
        h = [int(x) for x in {int((np.uint64(heads[i % 12].view(np.uint64)) ^ np.uint64(f)).view(np.int64)) for i, f in enumerate(flips)}]
        far = np.bitwise_count(np.array(h).view(np.uint64)[:, None] ^ np.array(h).view(np.uint64)[None])
        comp = np.arange(len(h))
        while (new := np.where(far <= k, comp[None], len(h)).min(1)).tolist() != comp.tolist():
            comp = new
        wanted = {i: int(c) for i, c in enumerate(comp) if (comp == c).sum() > 1}
        wide = {c: int(far[np.ix_(comp == c, comp == c)].max()) for c in set(wanted.values())}
        hashes = spark.createDataFrame([*enumerate(h), (5000, h[0])], "id long, hash long")
        assert similar.chance(k) > similar.CHANCE
        found = saved(similar.similar(hashes, k), "found")
        assert {x["id"]: x["group"] for x in found.collect()} == wanted | {5000: wanted.get(0, 0)} | {0: wanted.get(0, 0)}
        assert {x["group"]: x["max_distance"] for x in similar.widest(found, hashes).collect()} == {0: 0} | wide
        with monkeypatch.context() as m:
            m.setattr(similar, "pairs", None)
            rows = similar.similar_groups(hashes.selectExpr("'/' || id AS path", "hash AS dhash"), k).collect()
        assert sorted(len(x["paths"]) for x in rows) == sorted(sum(c == g for c in (wanted | {5000: wanted.get(0, 0), 0: wanted.get(0, 0)}).values()) for g in {0: 0} | wide)


def test_many_equal_hashes(spark) -> None:  # noqa: ANN001
    """100,000 equal hashes are one to the search, and 3,000 random ones meet few others by chance."""
    r = np.random.default_rng(8)
    h = [int(v) for v in r.integers(-(2**63), 2**63, 3000)]
    images = spark.range(100_000).select(F.concat(F.lit("/e/"), "id").alias("path"), F.lit(h[0]).alias("dhash")).unionByName(spark.createDataFrame([(f"/{i}", v) for i, v in enumerate(h)], "path string, dhash long"))
    rows = similar.similar_groups(images).collect()
    assert [(len(x["paths"]), x["max_distance"]) for x in rows] == [(100_001, 0)]
    near = sum(len(similar.errors(w, e)) / 2**w for _, w, e in similar.bands(10))
    assert near < 0.01  # of all pairs, where ten wide bands of few bits would look at a sixth


def test_funnel_by_a_size_column(spark) -> None:  # noqa: ANN001
    from siftline.operators import exact

    rows = [(i, f"text {i // 2}" if i < 40 else f"{'x' * i}") for i in range(100)] + [(100, None), (101, None), (102, "text 3")]
    files = spark.createDataFrame([(f"/{i}", None if i == 102 else len(t or ""), 0, i, t) for i, t in rows], "path string, n long, dev long, ino long, content string")
    files = files.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).withColumn("content", F.coalesce("content", F.lit("")).cast("binary"))
    funneled = exact.funneled(files, "n")
    assert funneled.count() == 43  # those with a length of their own aren't hashed
    key = lambda df: sorted((r["path"], r["group_id"]) for r in exact.members(df).collect())
    assert key(funneled) == key(exact.digested(files)) and len(key(funneled)) == 43


def test_a_large_group_is_verified_in_parts(spark) -> None:  # noqa: ANN001
    from siftline.operators import exact

    rows = [(f"/{i}", "big", 4, 0, i, b"same" if i % 100 else b"diff" if i else b"same") for i in range(2000)] + [("/x", "two", 1, 0, 5000, b"x"), ("/y", "two", 1, 0, 5001, b"y"), ("/n", "none", 1, 0, 6000, None), ("/m", "none", 1, 0, 6001, b"z")]
    members = spark.createDataFrame(rows, "path string, group_id string, size long, dev long, ino long, content binary")
    got = exact.verified(members)
    assert sorted(r["path"] for r in got.collect()) == sorted(p for p, g, *_, c in rows if g == "big" and c == b"same")
    assert set(got.columns) == set(members.columns)
    salted, refs = exact.salted(members)
    assert salted.count() == len(rows) and refs.where("group_id = 'big'").count() == 125
    assert salted.groupBy("group_id", "salt").count().agg(F.max("count")).first()[0] < 3 * exact.TOGETHER


def test_review_order_over_many_ranges(spark) -> None:  # noqa: ANN001
    """One top folder in all ranges, others in one, and items without any folder."""
    import random

    r = random.Random(4)
    items = [f"/r/big/{r.choice('abc')}/{r.choice('xy')}/{i}" for i in range(300)] + [f"/r/{d}/f{i}" for d in "ab" for i in range(3)] + ["/r/top1", "/r/top2", "/r/big/0"]
    rows = report.review_rows(spark.createDataFrame([(p, 1, 2) for p in items], "path string, top int, part int"), "/r").collect()
    chain = lambda p: p.split("/")[2:-1]
    wanted, last, place = [], {}, {}
    for p in sorted(items, key=lambda p: (chain(p), p.rsplit("/", 1)[1])):
        c, top = chain(p), "".join(chain(p)[:1])
        shared = next((k for k, (x, y) in enumerate(zip(c, last.get(top, []))) if x != y), min(len(c), len(last.get(top, []))))
        place[top] = place.get(top, 0) + 1
        wanted.append((p, place[top], shared))
        last[top] = c
    assert sorted((x["path"], x["place"], x["shared"]) for x in rows) == sorted(wanted)
    assert {(x["top"], x["part"]) for x in rows} == {(1, 2)}


def test_events(spark, tmp_path) -> None:  # noqa: ANN001
    import json

    root = put(tmp_path, {"a": b"1", "b": b"1"})
    s = scan(spark, root)
    lines = [json.loads(x) for x in report.stream(report.group_events(s.groups()), report.progress_event(spark, 2, 2), finished=report.finished_event(s.summary()))]
    assert [x["type"] for x in lines] == ["duplicate_group", "progress", "finished"]
    assert lines[0]["paths"] == [f"{root}/a", f"{root}/b"] and lines[-1]["duplicate_files"] == 2
    shown = list(report.text(s.groups(), s.summary()))
    assert shown[0] == "--- 1 bytes, 2 copies ---" and shown[-1] == "scanned 2 files (2 bytes), found 1 duplicate groups (2 files)"


def test_paths(spark) -> None:  # noqa: ANN001
    p = F.col("path")
    row = spark.createDataFrame([("/a//b/./c/.bashrc",)], "path string").select(paths.normal(p).alias("n")).select(
        "n", paths.extension(F.col("n")).alias("e"), paths.depth(F.col("n")).alias("d"), paths.ancestors(F.col("n")).alias("up"), paths.under(F.col("n"), "/a/b").alias("in"), paths.under(F.col("n"), "/a/bc").alias("out")
    ).first()
    assert tuple(row) == ("/a/b/c/.bashrc", None, 5, ["/a", "/a/b", "/a/b/c"], True, False)
    order = spark.createDataFrame([("/a-b",), ("/a/b/c",), ("/a/b",)], "path string").orderBy(paths.components(p))
    assert [r["path"] for r in order.collect()] == ["/a/b", "/a/b/c", "/a-b"]


def test_cache_rows(spark) -> None:  # noqa: ANN001
    held = spark.createDataFrame([("/a", 1, 5, "x"), ("/b", 1, 5, "y")], "path string, size long, mtime_ns long, hash string")
    files = spark.createDataFrame([("/a", 1, 5), ("/b", 1, 6), ("/c", 1, 5)], "path string, size long, mtime_ns long")
    assert [r["path"] for r in cache.hits(files, held).collect()] == ["/a"]
    assert sorted(r["path"] for r in cache.misses(files, held).collect()) == ["/b", "/c"]
