from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import exact, lines, partenum, substrings
from siftline.llm.common import flat, span_hashes, word_spans
from tests.llm import brute
from tests.llm.conftest import same, table


def test_substrings(docs, rows, none) -> None:  # noqa: ANN001
    same(substrings.substring_dedup(docs), brute.substring(rows), "doc_id n_words n_removed kept_sha256")
    assert substrings.substring_dedup(none).count() == 0


def test_substrings_text(spark) -> None:  # noqa: ANN001
    w = [f"w{i}" for i in range(20)]
    found = substrings.substring_dedup(table(spark, [(1, " ".join(w)), (2, "before " + "\n".join(w[2:18]) + " after")]), with_text=True)
    assert {r["doc_id"]: r["kept_text"] for r in found.collect()} == {1: " ".join(w), 2: "before after"}


@pytest.mark.parametrize("window", [3, 5, 13])
def test_windows_of_one_hash(monkeypatch, window: int) -> None:  # noqa: ANN001
    """Windows that share a hash are told apart by their words."""
    monkeypatch.setattr(substrings, "gram_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    texts = [" ".join(f"w{(i * k) % 7}" for i in range(30)) for k in range(1, 5)]
    buf, off = flat(__import__("pyarrow").array(texts))
    string, word = substrings.repeats(buf, off, np.array([3, 1, 2, 1]), window)
    wanted = []
    split = [t.split() for t in texts]
    first: dict[tuple, int] = {}
    for t, d in zip(split, (3, 1, 2, 1)):
        for i in range(len(t) - window + 1):
            g = tuple(t[i : i + window])
            first[g] = min(d, first.get(g, d))
    for k, (t, d) in enumerate(zip(split, (3, 1, 2, 1))):
        wanted += [(k, i) for i in range(len(t) - window + 1) if first[tuple(t[i : i + window])] < d]
    assert sorted(zip(string.tolist(), word.tolist())) == sorted(wanted)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=60), min_size=1, max_size=6))
def test_spans_and_runs(texts: list[str]) -> None:
    buf, off = flat(__import__("pyarrow").array(texts))
    starts, lens, before = word_spans(buf, off)
    raw = buf.tobytes()
    got = [[raw[a : a + n] for a, n in zip(starts[x:y].tolist(), lens[x:y].tolist())] for x, y in zip(before, before[1:])]
    assert got == [t.encode().split() for t in texts]
    first, many, _ = substrings.runs_of(span_hashes(buf, starts, lens), before, 4, 2)
    windows = sorted(w for a, n in zip(first.tolist(), many.tolist()) for w in range(a, a + n))
    assert windows == [w for x, y in zip(before.tolist(), before.tolist()[1:]) for w in range(x, y - 3)]


def test_exact(docs, rows, none) -> None:  # noqa: ANN001
    same(exact.exact_dedup(docs), brute.exact(rows), "doc_id keep_id group_size kept text_sha256")
    same(exact.exact_dedup(docs, 8, 32), brute.exact(rows), "doc_id keep_id group_size kept text_sha256")
    assert exact.exact_dedup(none).count() == 0
    assert exact.without_copies(none).count() == 0


def test_without_copies(docs, rows) -> None:  # noqa: ANN001
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in left.collect())
    assert got == sorted({(i is None, i, t or "") for (i, t), (_, _, _, kept, _) in zip(rows, brute.exact(rows)) if kept})


def test_chunks_join_to_the_text(docs, rows) -> None:  # noqa: ANN001
    joined = docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", exact.chunks(F.col("t"), 16, 64).alias("c"))
    for r in joined.collect():
        assert "".join(r["c"]) == r["t"]
        assert all(0 < len(c) <= 65 for c in r["c"])


def test_colliding_identifiers_are_dealt_again(docs, rows, monkeypatch) -> None:  # noqa: ANN001
    real = exact.identifier
    monkeypatch.setattr(exact, "identifier", lambda chunk, salt: F.unhex(F.lpad(F.hex(F.length(chunk)), 32, "0")) if salt == 0 else real(chunk, salt))
    same(exact.exact_dedup(docs), brute.exact(rows), "doc_id keep_id group_size kept text_sha256")


def test_lines(docs, rows, none) -> None:  # noqa: ANN001
    same(lines.line_dedup(docs), brute.lines(rows), "doc_id n_lines n_dropped kept_sha256")
    same(lines.line_dedup(docs, 4, 2), brute.lines(rows, 4, 2), "doc_id n_lines n_dropped kept_sha256")
    assert lines.line_dedup(none).count() == 0


def test_lines_in_many_shards(docs, rows, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(lines, "SHARD_KEYS", 3)
    same(lines.line_dedup(docs, 4, 2), brute.lines(rows, 4, 2), "doc_id n_lines n_dropped kept_sha256")


def test_lines_count_documents(spark) -> None:  # noqa: ANN001
    line = "a line that is certainly longer than forty characters"
    rows = [(1, line)] * 4 + [(2, line)]
    found = lines.line_dedup(table(spark, rows), with_text=True).collect()
    assert all(r["kept_text"] == line for r in found)
    found = lines.line_dedup(table(spark, [*rows, (3, line), (4, line), (5, line + "\n" + line)]), with_text=True).collect()
    assert {(r["doc_id"], r["kept_text"]) for r in found} == {(1, ""), (2, ""), (3, ""), (4, ""), (5, line + "\n" + line)}


def test_cuckoo() -> None:
    r = random.Random(3)
    keys = np.array([r.getrandbits(64) for _ in range(5000)], np.uint64)
    f = lines.Cuckoo.of(keys)
    assert f.has(keys).all()
    others = np.array([r.getrandbits(64) for _ in range(20_000)], np.uint64)
    assert f.has(others).mean() < 0.001
    assert all(f.remove(k) for k in keys[:2500].tolist())
    assert f.has(keys[2500:]).all()
    assert f.has(keys[:2500]).mean() < 0.01
    small = lines.Cuckoo.sized(8)
    held = [k for k in keys[:200].tolist() if small.add(k)]
    assert small.has(np.array(held, np.uint64)).all()


def test_line_deletions_undo_insertions(spark, rows) -> None:  # noqa: ANN001
    named = [(i, t) for i, t in rows if i is not None]
    old, new = table(spark, [x for x in named if x[0] % 3]), table(spark, [x for x in named if not x[0] % 3])
    before = lines.counts(old, 4)
    after = lines.changed(before, new, 1, least=4)
    named = [x for x in named if not any(x[0] == y[0] and x[0] % 3 != y[0] % 3 for y in named)]
    key = lambda df: sorted((bytes(r["key"]), r["docs"], r["last"]) for r in df.collect())
    assert key(after) == key(lines.counts(table(spark, named), 4))
    assert key(lines.changed(after, new, -1, old, 4)) == key(before)
    made = lines.filters(before.where("docs >= 2"), 3)
    moved = lines.refiltered(made, before, after, 3, 2)
    hot = [bytes(r["key"]) for r in after.where("docs >= 2").collect()]
    held = {r["shard"]: lines.Cuckoo(np.frombuffer(r["filter"], np.uint16).reshape(-1, 4)) for r in moved.collect()}
    of = lines.shard8(hot, 3)
    for k, s in zip(hot, of.tolist()):
        assert not len(held[s].table) or held[s].has(lines.first8([k])).all()
    same(lines.line_dedup(old, 4, 2, table=lines.changed(after, new, -1, old, 4)), brute.lines([x for x in named if x[0] % 3], 4, 2), "doc_id n_lines n_dropped kept_sha256")


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard(docs, rows, n: int, percent: int) -> None:  # noqa: ANN001
    same(partenum.jaccard_components(docs, n, percent), brute.jaccard(rows, n, percent), "doc_id n_shingles component_id")


@pytest.mark.parametrize(("n", "percent", "grid"), [(2, 60, 3), (3, 80, 8)])
def test_jaccard_with_grids(docs, rows, monkeypatch, n: int, percent: int, grid: int) -> None:  # noqa: ANN001
    """Signatures of more documents than a task compares at once."""
    monkeypatch.setattr(partenum, "GRID", grid)
    same(partenum.jaccard_components(docs, n, percent), brute.jaccard(rows, n, percent), "doc_id n_shingles component_id")


def test_cells_let_all_meet(spark) -> None:  # noqa: ANN001
    """In a grid, each pair of different components meets in just one cell, and no cell has more than two blocks."""
    r = random.Random(1)
    rows = [(sig, did, 7 if did % 3 else 100 + did % 5, 0) for sig, size in ((1, 60), (2, 9), (3, 25)) for did in range(size)]
    rows += [(4, did, did, 0) for did in range(30)]
    held: dict[tuple, list] = {}
    totals = Counter(x[0] for x in rows)
    for x in partenum.cells(spark.createDataFrame([(*x, totals[x[0]]) for x in rows], "sig long, did long, component long, hub long, total long"), 10).collect():
        held.setdefault((x["sig"], x["x"], x["y"]), []).append(x)
    met = sorted((c[0], *sorted((a["did"], b["did"]))) for c, mine in held.items() for k, a in enumerate(mine) for b in mine[:k] if a["component"] != b["component"] and (a["half"] == 2 or a["half"] != b["half"]))
    comp = {(s, d): c for s, d, c, _ in rows}
    assert met == sorted((s, e, d) for s, d in comp for e in range(d) if (s, e) in comp and comp[s, d] != comp[s, e])


@pytest.mark.parametrize("crowd", [1, 3])
def test_jaccard_with_stars_in_blocks(docs, rows, monkeypatch, crowd: int) -> None:  # noqa: ANN001
    monkeypatch.setattr(partenum, "CROWD", crowd)
    same(partenum.jaccard_components(docs, 2, 60), brute.jaccard(rows, 2, 60), "doc_id n_shingles component_id")
    same(partenum.jaccard_components(docs), brute.jaccard(rows), "doc_id n_shingles component_id")


def test_near_sketches() -> None:
    """Sketches of all sizes are compared at the smaller one's; sizes that can't link leave nothing to compare."""
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (5, 200, 256, 257, 300, 4000)]
    sets += [s[: len(s) * 19 // 20] for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    bits, n = [partenum.sketch(s) for s in sets], np.array([len(s) for s in sets])
    a, b = (np.array(x) for x in zip(*pairs))
    ok = partenum.near(__import__("pyarrow").array([bits[i] for i in a]), n[a], __import__("pyarrow").array([bits[j] for j in b]), n[b], 80)
    for (i, j), near in zip(pairs, ok.tolist()):
        assert near or not partenum.linked(sets[i], sets[j], 80)
        assert not near or i % 6 == j % 6 or min(n[i], n[j]) < 50
    assert not partenum.near(__import__("pyarrow").array([bits[0]]), n[:1], __import__("pyarrow").array([bits[5]]), n[5:6], 80).any()


def test_jaccard_of_nothing(none) -> None:  # noqa: ANN001
    assert partenum.jaccard_components(none).count() == 0


def test_no_link_is_lost_where_stars_fail(spark) -> None:  # noqa: ANN001
    """A hub that links with none of its bucket, and a chain that needs links between others."""
    r = random.Random(11)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in range(5 * (k // 6), 5 * (k // 6) + 3):
            w[(at * 7) % 300] = f"n{k}-{at}"
        w[(k * 11) % 300] = r.choice("abc")
        rows.append((k, " ".join(w)))
    rows = [(0, " ".join(base[:-30])), *[(i + 1, t) for i, t in rows]]
    same(partenum.jaccard_components(table(spark, rows)), brute.jaccard(rows), "doc_id n_shingles component_id")


def test_many_near_sets_of_one_signature(spark) -> None:  # noqa: ANN001
    """More open pairs than rows: components' nearest pairs first, round by round, to the same result."""
    r = random.Random(21)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(2):
            w[r.randrange(120)] = f"n{k}{r.random()}"
        rows.append((k, " ".join(w)))
    wanted = brute.jaccard(rows)
    same(partenum.jaccard_components(table(spark, rows)), wanted, "doc_id n_shingles component_id")
    comp = np.arange(80)
    bits = np.zeros((80, 32), np.uint64)
    apart, all_ = np.full(80, -1), np.full(80, 2)
    found, left = partenum.open_pairs(np.arange(80), comp, apart, all_, np.full(80, 118), bits, [set()] * 80, 90)
    assert len(left) == 80 and 0 < len(found) <= 80
    found, left = partenum.open_pairs(np.arange(80), comp // 40, apart, all_, np.full(80, 118), bits, [set()] * 79 + [{0}], 90)
    assert len(left) == 80 and len(found) == 1
    bits[3] = ~bits[3]  # far from all
    assert 3 not in partenum.open_pairs(np.arange(80), comp, apart, all_, np.full(80, 118), bits, [set()] * 80, 90)[1]
    found, left = partenum.open_pairs(np.arange(3), comp[:3], apart[:3], all_[:3], np.full(3, 118), bits[:3], [{1}, {0}, set()], 90)
    assert not len(left) and sorted(found) == [(0, 2), (1, 2)]
    found, left = partenum.open_pairs(np.arange(3), comp[:3], np.zeros(3, np.int64), all_[:3], np.full(3, 118), bits[:3], [set()] * 3, 90)
    assert not len(left) and sorted(found) == [(1, 2)]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.sampled_from([60, 80, 90, 95]), st.integers(0, 2**32))
def test_similar_sets_share_a_signature(size: int, percent: int, seed: int) -> None:
    r = np.random.default_rng(seed)
    a = r.integers(0, 2**63, size).astype(np.uint64)
    change = int(r.integers(0, size + 1))
    b = np.concatenate([a[change:], r.integers(0, 2**63, int(r.integers(0, change + 2))).astype(np.uint64)])
    a, b = np.unique(a), np.unique(b)
    if not len(b) or not partenum.linked(a, b, percent):
        return
    sig, of = partenum.signatures([a, b], percent)
    assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_copies_meet_once(spark, monkeypatch) -> None:  # noqa: ANN001
    """Copies in all blocks and signatures in common: each set is looked at a few times where stars fail; documents of several sets keep them."""
    r = random.Random(31)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for k in range(24):
        w = list(base)
        for at in r.sample(range(200), 4 + k % 3):
            w[at] = f"n{k}-{at}"
        texts.append(" ".join(w))
    copies = [(100 * c + k, t) for c in range(6) for k, t in enumerate(texts)]
    # one document with the set of another and one of its own, to which a third is near
    lone = [f"u{i}" for i in range(60)]
    several = [(2000, texts[3]), (2000, " ".join(lone)), (2001, " ".join([*lone, "z"])), (5, " ".join([*lone[1:], "y"])), (1000, ""), (1000, texts[7])]
    rows = copies + several
    save, live = partenum.saved, []

    def counted(df, name):  # noqa: ANN001, ANN202
        out = save(df, name)
        if name == "live":
            live.append(out.count())
        return out

    monkeypatch.setattr(partenum, "saved", counted)
    same(partenum.jaccard_components(table(spark, rows).repartition(6)), brute.jaccard(rows), "doc_id n_shingles component_id")
    assert live and live[0] <= 10 * len(texts), live
