"""Operators whose core is an array kernel: MinHash chunks, fill-in-middle and phrases from suffix arrays."""

from __future__ import annotations

import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import fim, hamming, partenum, phrases
from tests.llm import brute
from tests.llm.conftest import same, table


def test_fill_in_middle(docs, rows, none) -> None:  # noqa: ANN001
    wanted = brute.fill_in_middle(rows)
    made = fim.fill_in_middle(docs)
    same(made, wanted, "doc_id n form prefix_chars middle_chars output")
    assert {x[2] for x in wanted} == {"plain", "psm", "spm"}
    same(made.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("t")), [(i, t or "") for i, t in rows], "doc_id t")
    same(fim.fill_in_middle(docs, 7, 100, 30), brute.fill_in_middle(rows, 7, 100, 30), "doc_id n form prefix_chars middle_chars output")
    assert fim.fill_in_middle(none).count() == 0


def test_marks_stay_plain(spark) -> None:  # noqa: ANN001
    texts = ["a <P> b", "<S>", "x<M>", "<P", ">", "<", "P>", "<M", "<Q>", None, "", " ", "\n\n", "a ", " a"]
    rows = [(i, t) for i in range(40) for t in texts]
    made = fim.fill_in_middle(table(spark, rows), rate=100)
    same(made, brute.fill_in_middle(rows, rate=100), "doc_id n form prefix_chars middle_chars output")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té😀<PSM>", max_size=40), min_size=1, max_size=6), st.integers(0, 2**32))
def test_cuts_of_a_batch(texts: list[str], seed: int) -> None:
    rows = [(i + seed, t) for i, t in enumerate(texts)]
    draws = np.array([[int(brute.sha(f"42:{i}")[8 * k : 8 * k + 8], 16) for i, _ in rows] for k in range(4)])
    made = fim.cut(pa.array(["before ", *texts, "after"]).slice(1, len(texts)), draws, 50, 80)
    assert list(zip(*(v.to_pylist() for v in made.values()))) == [x[1:] for x in brute.fill_in_middle(rows)]


def with_langs(spark, rows):  # noqa: ANN001, ANN201
    rows = [(i, t, None if k % 7 == 0 else ("und", "de", "en")[k % 3]) for k, (i, t) in enumerate(rows)]
    clash = F.lit("x").alias("phrase"), F.lit(1).alias("n"), F.lit(2).alias("h")
    return [(lang, t) for _, t, lang in rows], spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *clash).repartition(3)


PHRASE = "lang rank phrase a l r n score"


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(5, 100, 100, 2000), (5, 4, 100, 2000), (5, 3, 50, 10), (2, 5, 100, 7), (3, 2, 100, 2000)])
def test_collocations(spark, rows, longest: int, least: int, share: int, top: int) -> None:  # noqa: ANN001
    plain, docs = with_langs(spark, [*rows, *[(i, "New York, new york city! a a a a a\x0ba a  a") for i in range(40)]])
    same(phrases.collocations(docs, longest, least, share, top), brute.collocations(plain, longest, least, share, top), PHRASE)


def test_collocations_of_nothing(none, spark) -> None:  # noqa: ANN001
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), (None, " .,\n"), ("en", "")], "lang string, text string"), least=1).count() == 0


def test_small_shards_and_full_filters(spark, rows, monkeypatch) -> None:  # noqa: ANN001
    plain, docs = with_langs(spark, rows)
    monkeypatch.setattr(phrases, "SHARD", 500)
    monkeypatch.setattr(phrases, "PARTS", 3)
    monkeypatch.setattr("siftline.llm.common.BLOOM_BITS", 64)
    same(phrases.collocations(docs, 5, 3), brute.collocations(plain, 5, 3), PHRASE)


def test_scores_beyond_64_bits(spark) -> None:  # noqa: ANN001
    big = 30_000_000_000_000_001
    row = spark.createDataFrame([(big, big - 7, big // 3, big // 5)], "a long, n long, l long, r long").select(phrases.score("a", "n", "l", "r").alias("s")).first()
    assert row["s"] == 1000 * big * (big - 7) // ((big // 3) * (big // 5))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.booleans(), min_size=60, max_size=60), st.integers(2, 3), st.integers(3, 6))
def test_intervals(words: list[int], link: list[bool], low: int, high: int) -> None:
    """Suffix arrays, their LCPs and intervals, against the plain way."""
    ids, on = np.array(words, np.uint64), np.array(link[: len(words)], bool)
    on[-1:] = False
    runs, now = [], []
    for w, more in zip(words, on.tolist()):
        now.append(w)
        if not more:
            runs, now = [*runs, now], []
    wanted: dict[tuple, int] = {}
    for run in runs:
        for n in range(low, high + 1) if len(run) >= low else ():
            for i in range(len(run) - n + 1):
                wanted[tuple(run[i : i + n])] = wanted.get(tuple(run[i : i + n]), 0) + 1
    chain = phrases.chains(on, low)
    got = {}
    if len(chain):
        for n, first, counts in phrases.intervals(ids, chain, low, high):
            got |= {tuple(words[p : p + n]): c for p, c in zip(first.tolist(), counts.tolist())}
        symbols = np.append(ids[chain[chain >= 0]].astype(np.int64), 9)
        order = phrases.suffix_array(symbols, 64)
        suffixes = [symbols[i:].tolist() for i in order.tolist()]
        assert all(a <= b for a, b in pairwise(suffixes))
        lcp = phrases.common_prefixes(symbols, order, 4)
        assert lcp.tolist() == [0, *(min(4, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))) for a, b in pairwise(suffixes))]
    assert got == wanted


def kept(rows: list[tuple]) -> list[tuple]:
    return [(i, n, c, i is None or i == c) for i, n, c in rows]


NEAR = "doc_id n_shingles component_id kept"


@pytest.mark.parametrize(("n", "percent"), [(2, 80), (5, 80), (1, 95)])
def test_near_duplicates(docs, rows, n: int, percent: int) -> None:  # noqa: ANN001
    same(hamming.near_duplicates(docs, n, percent), kept(brute.jaccard(rows, n, percent)), NEAR)


def test_near_duplicates_of_nothing(none) -> None:  # noqa: ANN001
    assert hamming.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("grid", "nearest"), [(1024, 8), (5, 1)])
def test_near_sets_that_stars_leave_apart(spark, monkeypatch, grid: int, nearest: int) -> None:  # noqa: ANN001
    """A smallest document that links with none, chains that need links between others, and groups beyond one cell."""
    monkeypatch.setattr(hamming, "GRID", grid)
    monkeypatch.setattr(hamming, "NEAREST", nearest)
    r = random.Random(5)
    base = [f"t{i}" for i in range(200)]
    rows = [(0, " ".join(base[:130]))]
    for k in range(40):
        w = list(base)
        for at in range(10 * (k // 8), 10 * (k // 8) + 9):
            w[(at * 7) % 200] = f"n{k // 2}-{at}"
        w[(k * 11) % 200] = r.choice("abc")
        rows += [(k + 1, " ".join(w)), (k + 100, " ".join(w).upper())]
    wanted = kept(brute.jaccard(rows, 2, 80))
    assert len({c for _, _, c, _ in wanted}) > 3
    same(hamming.near_duplicates(table(spark, rows)), wanted, NEAR)


def test_near_copies_meet_once(spark, monkeypatch) -> None:  # noqa: ANN001
    """A group of near copies of which few link is looked at once, not under each of the keys they share."""
    rows_of = []
    save = hamming.saved

    def counted(df, name):  # noqa: ANN001, ANN202
        out = save(df, name)
        if name == "live":
            rows_of.append(out.count())
        return out

    monkeypatch.setattr(hamming, "saved", counted)
    r = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):
        w = list(base)
        for at in r.sample(range(60), 3):
            w[at] = f"x{k}-{at}"
        rows.append((k, " ".join(w)))
    wanted = kept(brute.jaccard(rows, 2, 80))
    assert len({c for _, _, c, _ in wanted}) > 60
    same(hamming.near_duplicates(table(spark, rows)), wanted, NEAR)
    assert rows_of and max(rows_of) <= 25 * len(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, hamming.REACH), st.integers(0, 2**32))
def test_all_pairs_within_reach_share_a_key(errors: int, seed: int) -> None:
    r = np.random.default_rng(seed)
    a = r.integers(0, 256, hamming.SIZE).astype(np.uint8)
    b = a.copy()
    at = r.choice(hamming.SIZE, errors, replace=False)
    b[at] ^= r.integers(1, 256, errors).astype(np.uint8)
    one, two = hamming.chunk_keys(np.stack([a, b]))
    assert (a != b).sum() == errors and (one == two).any()


def test_signatures_follow_similarity() -> None:
    r = np.random.default_rng(2)
    missed, differ = 0, []
    for size in (5, 40, 600, 9000):
        for _ in range(60):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            b = np.concatenate([a[: int(np.ceil(len(a) * 8 / 9))], r.integers(0, 2**63, len(a) // 9).astype(np.uint64)])
            assert partenum.linked(np.unique(a), np.unique(b), 80)
            one, two = np.stack([hamming.signature(a), hamming.signature(b)])
            keys = hamming.chunk_keys(np.stack([one, two]))
            missed += not (keys[0] == keys[1]).any()
            if size >= 600:
                differ.append((one != two).sum())
    assert missed == 0 and abs(np.mean(differ) - 0.2 * hamming.SIZE) < 1
