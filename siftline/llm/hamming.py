"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has SIZE MinHash values of one byte each. It is split into CHUNKS chunks of WIDTH values. By the
pigeonhole rule, two signatures that differ in at most REACH = CHUNKS * (ERRORS + 1) - 1 values differ in at most ERRORS in
some chunk. The errors a chunk is allowed are enumerated: each choice of ERRORS places to leave out gives a key of the
rest, and two chunks with no more errors share the key of the choice that covers them. So all pairs within REACH share a
key. Documents of a similarity of 0.8 differ in 22 values of 112 on average, and those that differ in more than 31
still share a key if the errors aren't spread over all chunks alike: one pair in a million does not.

Documents that share a key are compared with the smallest document among them only (a star); where that leaves
documents of one key in different components, they are compared with each other, round by round, in bounded cells. Near
copies are under much the same keys: keys of one smallest document are looked at as one where that takes no more
comparisons, so their documents meet once and not under each key. So no link between different texts is lost. Pairs whose parity sketches show that their sets differ too much are set aside,
which rules out no link; all others are confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import ODD, keyed, mixed, saved, slices, trim
from siftline.llm.partenum import cells, compared, folded, near, sets_of, shingle_sets, sketch, within
from siftline.operators.components import components
from siftline.tables import dropped

WORDS, PERCENT = 2, 80
CHUNKS, WIDTH, ERRORS = 16, 7, 1
SIZE = CHUNKS * WIDTH
REACH = CHUNKS * (ERRORS + 1) - 1
#: Documents of a key that are compared in one task; of each component, the nearest pairs that a first round looks at,
#: and how many times as many each further round does.
GRID, NEAREST, MORE = 1024, 32, 8
#: Bytes of sketches that are compared at once.
BLOCK = 8 << 20
#: Odd multipliers, by a rule.
TURNS = (mixed(np.arange(1, SIZE + 1, dtype=np.uint64) * ODD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
KEPT = np.array([[i for i in range(WIDTH) if i not in out] for out in combinations(range(WIDTH), ERRORS)])
COLUMNS = 4096


def signature(shingles: np.ndarray) -> np.ndarray:
    """The last byte of a hash of the least of the shingles in each of SIZE orders."""
    low = (mixed(shingles ^ ODD) >> np.uint64(32)).astype(np.uint32)
    least = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), COLUMNS):
        np.minimum(least, (low[None, a : a + COLUMNS] * TURNS[:, None]).min(1), out=least)
    return (mixed(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature, a row each: a 64-bit hash of chunk, choice of places and the values at the others."""
    chunks = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    shifts = np.arange(KEPT.shape[1], dtype=np.uint64) * np.uint64(8)
    values = (chunks[:, :, KEPT] << shifts).sum(3, dtype=np.uint64)
    names = (np.arange(CHUNKS * len(KEPT), dtype=np.uint64) + np.uint64(1)).reshape(CHUNKS, -1)
    return mixed(values ^ mixed(names * ODD)).reshape(len(signatures), -1)


def signed(base: DataFrame, n: int) -> DataFrame:
    """did, n, one, two, sig, bits, same of each row: the number of shingles, two sums that name their set, the signature, a
    parity sketch, and the smallest did of the same set in this block of input; only that row has the signature and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            did = batch.column("did").to_numpy()
            sets = shingle_sets(batch.column("text"), n)
            names = [(len(s), int(mixed(s).sum(dtype=np.uint64)), int(mixed(s ^ ODD).sum(dtype=np.uint64))) for s in sets]
            least: dict[tuple, int] = {}
            for i in np.argsort(did, kind="stable").tolist():
                least.setdefault(names[i], i)
            own, bits = ([f(s) if len(s) and least[k] == i else None for i, (k, s) in enumerate(zip(names, sets))] for f in (lambda s: signature(s).tobytes(), sketch))
            sums = np.array(names, np.uint64).view(np.int64)
            columns = [batch.column("did"), *map(pa.array, sums.T), pa.array(own, pa.binary()), pa.array(bits, pa.binary()), pa.array(did[[least[k] for k in names]])]
            yield pa.RecordBatch.from_arrays(columns, ["did", "n", "one", "two", "sig", "bits", "same"])
        trim()

    return base.select("did", "text").mapInArrow(run, "did long, n long, one long, two long, sig binary, bits binary, same long")


def keys_of(reps: DataFrame) -> DataFrame:
    """key, did of all keys of the representatives (did, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = chunk_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SIZE))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column("did").to_numpy(), keys.shape[1]))], ["key", "did"])

    return reps.select("did", "sig").mapInArrow(run, "key long, did long")


def close_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs that sizes and sketches let link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "two_bits", 4 << 20):
            ok = near(batch.column("one_bits"), batch.column("one_n").to_numpy(), batch.column("two_bits"), batch.column("two_n").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one, two = (reps.select(F.col("did").alias(x), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "bits"))) for x, side in (("a", "one"), ("b", "two")))
    met = pairs.join(two, "b").join(one, "a")
    return met.mapInArrow(check, "a long, b long").distinct()


def meeting(did: np.ndarray, hub: int, comp: np.ndarray, half: np.ndarray, n: np.ndarray, bits: pa.Array, failed: list[set[int]], nearest: int, percent: int) -> tuple[np.ndarray, bool]:
    """Pairs of rows in different components that may link and haven't been compared, and whether these are all.

    All have been compared with the hub. Halves meet each other, and a half of 2 itself. Of each component the `nearest` pairs are taken.
    """
    held = [np.frombuffer(x, np.uint8) for x in bits.to_pylist()]
    size = min(map(len, held))
    words = np.stack([folded(x, size) for x in held]).view(np.uint64)
    found, step = [np.zeros((3, 0), np.int64)], max(1, BLOCK // (len(did) * size))
    for a in range(0, len(did), step):
        i, j = np.arange(a, min(a + step, len(did)))[:, None], np.arange(len(did))[None, :]
        ok = (j > i) & (comp[i] != comp[j]) & (did[i] != did[j]) & (did[i] != hub) & (did[j] != hub) & ((half[i] == 2) | (half[i] != half[j]))
        if ok.any():
            # rows and columns that have a pair to look at
            i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            far = np.bitwise_count(words[a + i, None] ^ words[None, j]).sum(2, dtype=np.int64)
            one, two = n[a + i][:, None], n[j][None, :]
            x, y = np.nonzero(ok[i][:, j] & within(one, two, far, percent) & within(one, two, np.abs(one - two), percent))
            far, x, y = far[x, y], i[x] + a, j[y]
            ok = near(bits.take(pa.array(x)), n[x], bits.take(pa.array(y)), n[y], percent)  # at their own sizes
            found.append(np.stack([x, y, far])[:, ok])
    x, y, far = np.concatenate(found, 1)
    if any(failed):
        new = np.array([did[q] not in failed[p] for p, q in zip(x.tolist(), y.tolist())], bool)
        x, y, far = x[new], y[new], far[new]
    # each pair once for either component, nearest first, and its turn there
    sides = np.concatenate([comp[x], comp[y]])
    order = np.lexsort((np.tile(far, 2), sides))
    heads = np.flatnonzero(np.append(True, sides[order][1:] != sides[order][:-1])[: len(order)])
    turn = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    taken = np.zeros(len(x), bool)
    taken[order[turn < nearest] % max(1, len(x))] = True
    whole = bool(taken.all())
    x, y = x[taken], y[taken]
    return np.stack([np.minimum(did[x], did[y]), np.maximum(did[x], did[y])], 1), whole


def families(shared: DataFrame) -> DataFrame:
    """sig, did, hub of the keys (key, did, hub, docs) of three or more documents, saved.

    Each document of a key has met the hub. Keys of one hub are one sig of all their documents, each once, if that leaves no
    more pairs than the keys have apart.
    """
    keys = shared.where("docs > 2")
    apart = keys.where("did = hub").groupBy("hub").agg(F.sum(F.col("docs").cast("double") * F.col("docs")).alias("apart"))
    every = saved(keys.select("hub", "did").distinct(), "hub-members")
    sizes = every.groupBy("hub").agg(F.count("*").cast("double").alias("n")).join(apart, "hub")
    sizes = saved(sizes.select("hub", (F.col("n") * F.col("n") <= F.col("apart")).alias("one")), "hubs")
    as_one = every.join(sizes.where("one").select("hub"), "hub", "left_semi").select(F.xxhash64("hub").alias("sig"), "did", "hub")
    each = keys.join(sizes.where("not one").select("hub"), "hub", "left_semi").select(F.col("key").alias("sig"), "did", "hub")
    out = saved(as_one.unionByName(each), "families")
    dropped(every, sizes)
    return out


def open_pairs(members: DataFrame, reps: DataFrame, labels: DataFrame, failed: DataFrame, nearest: int, percent: int, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of members (sig, did, hub) of a key that are in different components, may link and haven't failed (a, b);
    and sig: the keys that have more such pairs than were given. only: keys (sig) to look at."""

    def pairs(table: pa.Table) -> pa.Table:
        did, hub, comp, half, n = (table.column(c).to_numpy() for c in ("did", "hub", "component", "half", "n"))
        found, whole = meeting(did, int(hub[0]), comp, half, n, table.column("bits").combine_chunks(), [set(f or ()) for f in table.column("failed").to_pylist()], nearest, percent)
        # the key alone stands for its members
        rest, none = table.column("sig").slice(0, 0 if whole else 1).to_pylist(), [None] * len(found)
        columns = {"a": [*found[:, 0].tolist(), *[None] * len(rest)], "b": [*found[:, 1].tolist(), *[None] * len(rest)], "sig": [*none, *rest]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    of = labels.select(F.col("node").alias("did"), "component")
    now = members.join(of, "did", "left").select("sig", "did", "hub", F.coalesce("component", "did").alias("component"))
    name = lambda seed: F.sum(F.xxhash64("did", F.lit(seed)).cast("decimal(38,0)"))
    several = now.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("total"), name(1).alias("p"), name(2).alias("q")).where("x <> y")
    if only is not None:
        several = several.join(only, "sig", "left_semi")
    # keys of the same documents count once
    once = several.groupBy("total", "p", "q").agg(F.min("sig").alias("sig")).select("sig", "total")
    live = saved(now.join(once, "sig").select("sig", "did", "component", "hub", "total"), "live")
    both = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = reps.select("did", "n", "bits").join(both.groupBy(F.col("a").alias("did")).agg(F.collect_set("b").alias("failed")), "did", "left")
    found = saved(cells(live, GRID).join(known, "did").groupBy("sig", "x", "y").applyInArrow(pairs, "a long, b long, sig long"), "open")
    dropped(live)
    return found.where("sig IS NULL").select("a", "b").distinct(), found.where("sig IS NOT NULL").select("sig").distinct()


def compare(base: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, link of pairs by the full sets, saved."""
    sets = saved(sets_of(base, pairs.select(F.explode(F.array("a", "b")).alias("did")).distinct(), n), "sets")
    out = saved(compared(pairs, sets, percent), "compared")
    dropped(sets)
    return out


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included), kept.

    Two documents link when 100 * shared >= percent * all of their shingles of n words, lower-cased in A-Z; a text with
    fewer words is one shingle, one without words or a null text has none and links with nothing. kept: whether a row is
    its component's; rows with one doc_id are one document. A null doc_id links with nothing, has no component and is
    kept. Other columns are left out; an empty table gives no rows. Sets are compared by 64-bit hashes of shingles, and
    equal ones told by two sums of 64 bits. The signature parameters are set for a percent of 80 or more.
    """
    every = keyed(docs)
    base = every.where(~F.col("none"))
    rows = saved(signed(base, n), "signatures")
    some = rows.where("sig IS NOT NULL")
    # one document stands for all with the same set
    reps = saved(some.groupBy("n", "one", "two").agg(F.min("did").alias("did"), F.min("sig").alias("sig"), F.min("bits").alias("bits")), "representatives")
    equal = some.join(reps.select("n", "one", "two", F.col("did").alias("a")), ["n", "one", "two"]).select("a", F.col("did").alias("b"))
    links = equal.unionByName(rows.where("n > 0").select(F.col("same").alias("a"), F.col("did").alias("b"))).where("a <> b").distinct()
    keys = keys_of(reps)
    hubs = keys.groupBy("key").agg(F.min("did").alias("hub"), F.max("did").alias("last"), F.count("*").alias("docs")).where("hub <> last")
    shared = saved(keys.join(hubs, "key").select("key", "did", "hub", "docs"), "shared-keys")
    pairs = saved(close_pairs(shared.where("did <> hub").select(F.col("hub").alias("a"), F.col("did").alias("b")).distinct(), reps, percent), "close")
    tried = compare(base, pairs, n, percent)
    links = saved(links.unionByName(tried.where("link").select("a", "b")), "links")
    labels, failed = components(links), tried.limit(0).select("a", "b")
    members, nearest, left = families(shared), NEAREST, None
    while True:
        more, left = open_pairs(members, reps, labels, failed, nearest, percent, left)
        if more.isEmpty():
            break
        checked = compare(base, more, n, percent)
        new, old = checked.where("link").select("a", "b"), links
        if not new.isEmpty():
            links = saved(links.unionByName(new), "links")
            labels = components(links)
            dropped(old)
        if left.isEmpty():
            break
        failed = saved(failed.unionByName(checked.where("not link").select("a", "b")), "failed")
        nearest *= MORE
        dropped(checked)
    dropped(shared, pairs, links, members)
    named = rows.select("did", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("node", "did"), "did", "left")
    named = named.select(F.col("did").alias("doc_id"), "n_shingles", F.coalesce("component", "did").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(batch.column("text"), n)], pa.int64())], ["n_shingles"])

    none = F.lit(None).cast("long")
    nameless = every.where("none").select("text").mapInArrow(count, "n_shingles long").select(none.alias("doc_id"), "n_shingles", none.alias("component_id"))
    return named.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
