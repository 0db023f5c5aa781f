"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into size bands, each as wide as similar sets' sizes can differ. In a band, similar sets
differ in at most k elements. PartEnum deals the domain of elements to n1 parts of `PARTS` subparts; with n1 above k / 2,
two similar sets agree in all but one subpart of some part, so each set gets a signature for each choice of PARTS - 1
subparts of each part, and similar sets share one. A set also gets the signatures of the next band, for larger partners.
Signatures of no elements tell nothing, so `spare(n1)` more parts are dealt: similar sets then agree in so many parts
that a set with at most as many empty ones can do without them; only sets with more keep theirs, as their partners do.

Sets that share a signature are compared with the smallest document among them only (a star, first within a block of
input, then among blocks' smallest), never all with all. Where a comparison fails, the members of that signature which
are still in different components are compared with each other. So no link between components is lost. Of documents with
the same set only the smallest is looked at there, and signatures of one smallest document are taken together where that
leaves no more pairs, so that documents which share many signatures don't meet in each of them.

Before sets move to be compared, parity sketches are: two of them differ in at most as many bits as their sets do in
elements, so pairs that are too far apart go without losing any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import ODD, Bloom, flat, gram_hashes, keyed, mixed, saved, shuffle_partitions, slices, span_hashes, text_bytes, trim, word_spans
from siftline.operators.components import components
from siftline.tables import dropped

WORDS, PERCENT = 3, 90
PARTS = 3
#: Powers of two that bound the bits of a parity sketch; in between, it has two bits an element or more.
SKETCH = 10, 16
#: Bytes of text whose signatures are cut into blocks together, and that a bucket has blocks of: so many blocks as one by the other.
SLICE_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377], np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of n words, lower-cased in A-Z; fewer words are one shingle."""
    buf, off = flat(texts, lower=True)
    starts, lens, before = word_spans(buf, off)
    words = span_hashes(buf, starts, lens)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def bands(longest: int, percent: int) -> list[int]:
    """Upper ends of the size bands, up to one band past `longest`."""
    out = [0]
    while out[-1] <= longest or len(out) < 2:
        out.append((out[-1] + 1) * 100 // percent)
    return [*out[1:], (out[-1] + 1) * 100 // percent]


def spare(n1: np.ndarray) -> np.ndarray:
    """Parts with an empty signature that a set can do without."""
    return np.select([n1 >= 10, n1 >= 5, n1 >= 3], [3 + n1 // 50, 2, 1], 0)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the set each belongs to."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.array(bands(int(sizes.max()), percent))
    differ = 2 * ends * (100 - percent) // (100 + percent)
    values = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(ends, sizes)
    part, sub, weight = mixed(values ^ SEEDS[0]) >> np.uint64(32), mixed(values ^ SEEDS[1]) % np.uint64(PARTS), mixed(values ^ SEEDS[2])
    found, whose = [], []
    for step in (0, 1):
        band = own + step
        k = differ[band]
        extra = spare(k // 2 + 1)
        n1 = np.where(sizes > 0, k // 2 + 1 + extra, 0)
        base = np.concatenate([[0], np.cumsum(n1)])
        p1 = ((part * n1[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        place = (base[of] + p1) * PARTS + np.where(k[of] == 0, 0, sub.astype(np.int64))
        sums = np.zeros(base[-1] * PARTS, np.uint64)
        np.add.at(sums, place, weight)
        sums = sums.reshape(-1, PARTS)
        some = np.bincount(place, minlength=base[-1] * PARTS).reshape(-1, PARTS)
        doc = np.repeat(np.arange(len(sets)), n1)
        where = (band[doc] * 1_000_003 + np.arange(base[-1]) - base[doc]).astype(np.uint64)
        total, all_ = sums.sum(1, dtype=np.uint64), some.sum(1)
        # a part with all elements in one subpart, or with none, has an empty signature
        bare = np.bincount(doc, weights=(some == all_[:, None]).any(1), minlength=len(sets))
        thin = (bare > extra)[doc]
        for j in range(PARTS):
            # with k = 0, all is in the first subpart, and the whole set is its one signature
            left = np.where(k[doc] > 0, total - sums[:, j], total)
            keep = (k[doc] > 0) & ((some[:, j] < all_) | thin) | (k[doc] == 0) & (j == 0)
            found.append(mixed(mixed(left + ODD) + where * np.uint64(PARTS) + np.uint64(j))[keep])
            whose.append(doc[keep])
    return np.concatenate(found), np.concatenate(whose)


def star(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by key and node, and in that order the smallest node and the number of rows of each one's key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return order, nodes[heads[group]], np.diff(np.append(heads, len(keys)))[group]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketch(values: np.ndarray) -> bytes:
    """The parity of the number of elements that fall on each bit."""
    bits = 1 << min(SKETCH[1], max(SKETCH[0], max(0, 2 * len(values) - 1).bit_length()))
    return np.packbits(np.bincount((mixed(values ^ SEEDS[4]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch in `size` bytes: its parts, added up without carry."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def within(n: np.ndarray | int, m: np.ndarray | int, differ: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of n and m elements that differ in `differ` may link."""
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def near(one: pa.Array, n: np.ndarray, two: pa.Array, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether each pair of sketches leaves a link possible."""
    out = within(n, m, np.abs(n - m), percent)
    a, b = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (one, two))
    kinds, of = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    for k, (p, q) in enumerate(kinds.T.tolist()):
        rows = np.flatnonzero((of.ravel() == k) & out)
        if not len(rows):
            continue
        x, y = (np.frombuffer(b"".join(z.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1, min(p, q)) for z in (one, two))
        differ = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(1, dtype=np.int64)
        out[rows] = within(n[rows], m[rows], differ, percent)
    return out


CANDIDATE, DOCUMENT, MEMBER = 0, 1, 2
#: Open pairs of a signature for each of its documents that are all given at once.
OPEN = 1
#: A signature that more documents of one block share sends on the smallest of them only.
CROWD = 64
#: Documents of a signature that are compared in one task: those of a larger one are dealt to a grid.
GRID = 1024


def candidates(base: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, kind, hub, two, bits: pairs to compare, each row's did, number of shingles, two sums that name its set, and sketch
    (DOCUMENT), and documents by a signature, or a number for several signatures, that at least three share (MEMBER), with the
    hub that a document is paired with."""
    buckets = max(shuffle_partitions(base.sparkSession), text_bytes(base) // BUCKET_BYTES, 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", SLICE_BYTES):
            did = batch.column("did").to_numpy()
            sets = shingle_sets(batch.column("text"), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            # equal sets: the smallest document of the block stands for all
            sums = np.array([[x.sum(dtype=np.uint64) for x in (mixed(s ^ SEEDS[3]), mixed(s ^ ODD))] for s in sets], np.uint64).view(np.int64)
            rep: dict[tuple, int] = {}
            mine = []
            for i in np.argsort(did, kind="stable").tolist():
                if sizes[i] and rep.setdefault((int(sizes[i]), *sums[i].tolist()), i) == i:
                    mine.append(i)
            sig, of = signatures([sets[i] for i in mine], percent)
            node = did[np.array(mine, np.int64)][of] if mine else np.zeros(0, np.int64)
            order, hub, size = star(sig, node)
            sig, node, crowd = sig[order], node[order], size > CROWD
            edges = np.unique(np.stack([hub, node], 1)[crowd & (node != hub)], axis=0)
            held = np.c_[sig.view(np.int64), node, np.full(len(node), MEMBER), hub][crowd]
            on = ~crowd | (node == hub)
            sig, node, crowd = sig[on], node[on], crowd[on].astype(np.uint8)
            rows = np.concatenate([np.c_[edges, np.full(len(edges), CANDIDATE), edges[:, 0]], held])
            to, row_to = (sig % np.uint64(buckets)).astype(np.int64), (mixed(rows[:, 1].astype(np.uint64) ^ rows[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order, row_order = np.lexsort((node, to)), np.argsort(row_to, kind="stable")
            sig, node, crowd, to, rows, row_to = sig[order], node[order], crowd[order], to[order], rows[row_order], row_to[row_order]
            doc_to = (mixed(did.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            docs_of: dict[int, list[int]] = {}
            for i, k in enumerate(doc_to.tolist()):
                docs_of.setdefault(k, []).append(i)
            used, blocks = np.unique(np.concatenate([to, row_to, doc_to])), []
            for k in used.tolist():
                x, y = np.searchsorted(to, [k, k + 1])
                u, v = np.searchsorted(row_to, [k, k + 1])
                own = docs_of.get(k, [])
                bits = [sketch(sets[i]) for i in own]
                parts = [np.array([y - x, v - u, len(own)], "<i8"), np.diff(node[x:y], prepend=0).astype("<i8"), sig[x:y], rows[u:v].T.astype("<i8"), did[own].astype("<i8"), sizes[own].astype("<i8"), *sums[own].T.astype("<i8"), np.array([len(b) for b in bits], "<i8"), crowd[x:y]]
                blocks.append(pack.compress(b"".join(p.tobytes() for p in parts) + b"".join(bits)))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def receive(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        sig, node, crowd, rows, docs, bits, second = [], [], [], [], [], [], []
        for block in table.column("block").to_pylist():
            raw = unpack.decompress(block)
            m, r, d = np.frombuffer(raw, "<i8", 3).tolist()
            node.append(np.cumsum(np.frombuffer(raw, "<i8", m, 24)))
            sig.append(np.frombuffer(raw, "<u8", m, 24 + 8 * m))
            at = 24 + 16 * m
            rows.append(np.frombuffer(raw, "<i8", 4 * r, at).reshape(4, -1).T)
            at += 32 * r
            did, n, one, two, size = np.frombuffer(raw, "<i8", 5 * d, at).reshape(5, -1)
            docs.append(np.c_[did, n, np.full(d, DOCUMENT), one])
            second += two.tolist()
            at += 40 * d
            crowd.append(np.frombuffer(raw, np.uint8, m, at))
            at += m
            for k in size.tolist():
                bits.append(raw[at : at + k])
                at += k
        sig, node = np.concatenate(sig), np.concatenate(node)
        order, hub, size = star(sig, node)
        sig, node, crowd = sig[order], node[order], np.concatenate(crowd)[order].astype(np.int64)
        least = hub
        edges = np.unique(np.stack([hub, node], 1)[node != hub], axis=0)
        head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
        of = np.repeat(np.arange(len(head)), size[head])
        if len(head):
            # the documents of a signature of three or more, once for all signatures with just these
            crowd = np.add.reduceat(crowd, head) > 0
            name = np.where(crowd, sig[head], np.add.reduceat(mixed(node.astype(np.uint64)), head))
            open_ = (crowd | (size[head] > 2)) & np.isin(np.arange(len(head)), np.unique(name, return_index=True)[1])
            rows.append(np.c_[name[of].view(np.int64), node, np.full(len(node), MEMBER), least][open_[of]])
        rows = np.concatenate([*rows, np.c_[edges, np.full(len(edges), CANDIDATE), edges[:, 0]], *docs])
        trim()
        before = [None] * (len(rows) - len(bits))
        return pa.table({"a": rows[:, 0], "b": rows[:, 1], "kind": rows[:, 2].astype(np.int32), "hub": rows[:, 3], "two": pa.array(before + second, pa.int64()), "bits": pa.array(before + bits, pa.binary())})

    sent = base.select("did", "text").mapInArrow(send, "bucket long, block binary")
    return sent.groupBy("bucket").applyInArrow(receive, "a long, b long, kind int, hub long, two long, bits binary")


def equal_sets(rows: DataFrame) -> DataFrame:
    """did, rep, alone: documents whose set a smaller one has as well, the smallest such, and whether did has no other set."""
    docs = rows.where((F.col("kind") == DOCUMENT) & (F.col("b") > 0)).select(F.col("a").alias("did"), F.col("b").alias("n"), F.col("hub").alias("one"), "two").distinct()
    least = docs.groupBy("n", "one", "two").agg(F.min("did").alias("rep"))
    of = docs.join(least, ["n", "one", "two"]).groupBy("did").agg(F.collect_set("rep").alias("reps"), F.count("*").alias("sets"))
    return of.select("did", F.explode("reps").alias("rep"), (F.col("sets") == 1).alias("alone")).where("rep <> did")


def by_rep(df: DataFrame, column: str, twins: DataFrame) -> DataFrame:
    """df with twins' (did, rep) smallest document in place of each in the column."""
    of = twins.select(F.col("did").alias(column), F.col("rep"))
    return df.join(of, column, "left").withColumn(column, F.coalesce("rep", column)).drop("rep")


def families(members: DataFrame) -> DataFrame:
    """sig, did, hub of members (sig, did, hub) of a signature of three or more, saved. Of two, one has been compared with the other.

    Signatures of one smallest document are one of all their documents, each once, if that leaves no more pairs than they have apart.
    """
    heads = members.groupBy("sig").agg(F.min("did").alias("head"), F.count("*").cast("double").alias("docs")).where("docs > 2")
    held = saved(members.join(heads, "sig"), "held")
    every = saved(held.groupBy("head", "did").agg(F.min("hub").alias("hub")), "head-members")
    apart = held.where("did = head").groupBy("head").agg(F.sum(F.col("docs") * F.col("docs")).alias("apart"))
    sizes = every.groupBy("head").agg(F.count("*").cast("double").alias("n")).join(apart, "head")
    sizes = saved(sizes.select("head", (F.col("n") * F.col("n") <= F.col("apart")).alias("one")), "heads")
    as_one = every.join(sizes.where("one").select("head"), "head", "left_semi").select(F.xxhash64("head").alias("sig"), "did", "hub")
    each = held.join(sizes.where("not one").select("head"), "head", "left_semi").select("sig", "did", "hub")
    out = saved(as_one.unionByName(each), "families")
    dropped(held, every, sizes)
    return out


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs whose sketches (did, n, bits) leave a link possible."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "two", 4 << 20):
            ok = near(batch.column("one"), batch.column("n").to_numpy(), batch.column("two"), batch.column("m").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    one, two = (sketches.select(F.col("did").alias(x), F.col("n").alias(n), F.col("bits").alias(y)) for x, n, y in (("a", "n", "one"), ("b", "m", "two")))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "one", "n", "two", "m").mapInArrow(check, "a long, b long").distinct()


def sets_of(base: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """did, shingles (sorted hashes, 8 bytes each): of all rows whose did is among ids, and perhaps of some others."""
    held = base.sparkSession.sparkContext.broadcast(Bloom.of(ids.select(F.xxhash64("did"))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            batch = batch.filter(pa.array(held.value.passes(batch.column("k").to_numpy())))
            if batch.num_rows:
                sets = [s.tobytes() for s in shingle_sets(batch.column("text"), n)]
                yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(sets, pa.binary())], ["did", "shingles"])

    return base.select("did", "text", F.xxhash64("did").alias("k")).mapInArrow(make, "did long, shingles binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, link: whether any rows of the two documents link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "two", 4 << 20):
            link = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link, pa.bool_())], ["a", "b", "link"])

    one, two = sets.select(F.col("did").alias("a"), F.col("shingles").alias("one")), sets.select(F.col("did").alias("b"), F.col("shingles").alias("two"))
    near = pairs.join(two, "b").join(one, "a")
    return near.select("a", "b", "one", "two").mapInArrow(check, "a long, b long, link boolean").groupBy("a", "b").agg(F.max("link").alias("link"))


def compare(base: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, link of pairs, saved."""
    sets = saved(sets_of(base, pairs.select(F.explode(F.array("a", "b")).alias("did")).distinct(), n), "sets")
    out = saved(compared(pairs, sets, percent), "compared")
    dropped(sets)
    return out


def open_pairs(did: np.ndarray, comp: np.ndarray, hub: np.ndarray, half: np.ndarray, n: np.ndarray, bits: np.ndarray, failed: list[set[int]], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of different components that haven't been compared and whose sketches don't rule a link out, and, unless these
    are all, the rows that have any. A document has been compared with its hub. Halves meet each other, and a half of 2 itself.

    If there are more than OPEN a row, only each component's nearest is given: once it is compared, components merge or it is
    out of the way, and the others are looked at again.
    """
    size, found = len(did), []
    step = max(1, (1 << 20) // max(1, size * bits.shape[1]))
    for a in range(0, size - 1, step):
        i, j = np.arange(a, min(a + step, size))[:, None], np.arange(a + 1, size)[None, :]
        ok = (j > i) & (comp[i] != comp[j]) & (did[i] != did[j]) & (hub[j] != did[i]) & (did[j] != hub[i]) & ((half[i] == 2) | (half[i] != half[j]))
        ok &= within(n[i], n[j], np.abs(n[i] - n[j]), percent)
        x, y = np.nonzero(ok)
        x, y = x + a, y + a + 1
        far = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
        ok = within(n[x], n[y], far, percent)
        found.append(np.stack([x[ok], y[ok], far[ok]]))
    x, y, far = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    if any(failed):
        ok = np.array([did[k] not in failed[i] for i, k in zip(x.tolist(), y.tolist())], bool)
        x, y, far = x[ok], y[ok], far[ok]
    left = np.zeros(0, np.int64)
    if len(x) > OPEN * size:
        left = np.unique(np.concatenate([x, y]))
        order = np.argsort(far, kind="stable")
        _, first = np.unique(np.concatenate([comp[x[order]], comp[y[order]]]), return_index=True)
        near = np.unique(np.concatenate([order, order])[first])
        x, y = x[near], y[near]
    return list(zip(np.minimum(did[x], did[y]).tolist(), np.maximum(did[x], did[y]).tolist())), left


def cells(live: DataFrame, most: int) -> DataFrame:
    """live (sig, did, component, hub, total: documents of sig) with x, y, half: the cells of a signature's grid in which a document is compared.

    A signature of up to `most` documents is one cell. In a larger one, its largest component, whose documents needn't meet
    each other, and the others are cut into blocks; documents meet where their blocks cross.
    """
    rows = live.where(F.col("total") > most)
    one = [F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("half")]
    if rows.isEmpty():
        return live.select("*", *one)
    top = rows.groupBy("sig", "component").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max(F.struct("n", "component")).alias("top"))
    rows = rows.join(top, "sig").withColumn("in_top", F.col("component") == F.col("top.component"))
    across = lambda n: F.ceil(n / F.lit(most)).cast("int")
    tops, rests = across(F.col("top.n")), across(F.col("total") - F.col("top.n"))
    own = F.pmod(F.xxhash64("did"), F.when(F.col("in_top"), tops).otherwise(rests)).cast("int")
    cell = lambda x, y, half: F.struct(x.alias("x"), y.alias("y"), half.cast("int").alias("half"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    # blocks of the others are numbered from `tops` on
    with_rest = F.transform(each(rests), lambda j: cell(F.col("own"), tops + j, F.lit(0)))
    with_top = F.transform(each(tops), lambda i: cell(i, tops + F.col("own"), F.lit(1)))
    among = F.transform(each(rests), lambda j: cell(tops + F.least(F.col("own"), j), tops + F.greatest(F.col("own"), j), F.when(j == F.col("own"), 2).otherwise((F.col("own") > j).cast("int"))))
    dealt = rows.withColumn("own", own).withColumn("cell", F.explode(F.when(F.col("in_top"), with_rest).otherwise(F.concat(with_top, among))))
    small = live.where(F.col("total") <= most).select("*", *one)
    return small.unionByName(dealt.select(*live.columns, "cell.x", "cell.y", "cell.half"))


def unlinked(members: DataFrame, sketches: DataFrame, labels: DataFrame, failed: DataFrame | None, percent: int) -> DataFrame:
    """a, b: pairs of members (sig, did, hub) that share a signature, are in different components and may link; and with
    null b, sig, a and hub of members that have more such pairs than are given. Others never have any again."""

    def pairs(table: pa.Table) -> pa.Table:
        did, comp, hub, half, n = (table.column(c).to_numpy() for c in ("did", "component", "hub", "half", "n"))
        held = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        size = min(map(len, held))
        gone = [set(f or ()) for f in table.column("failed").to_pylist()]
        found, left = open_pairs(did, comp, hub, half, n, np.stack([folded(x, size) for x in held]).view(np.uint64), gone, percent)
        one, none = table.column("sig").slice(0, 1).to_pylist(), [None] * len(found)
        a, b = ([*(p[k] for p in found)] for k in (0, 1))
        return pa.table({"a": pa.array([*a, *did[left].tolist()], pa.int64()), "b": pa.array([*b, *[None] * len(left)], pa.int64()), "sig": pa.array([*none, *one * len(left)], pa.int64()), "hub": pa.array([*none, *hub[left].tolist()], pa.int64())})

    of = labels.select(F.col("node").alias("did"), "component")
    now = members.join(of, "did", "left").select("did", "sig", "hub", F.coalesce("component", "did").alias("component"))
    several = now.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("total")).where("x <> y").select("sig", "total")
    live = saved(now.join(several, "sig"), "live")
    if failed is None:
        known = sketches.withColumn("failed", F.lit(None).cast("array<long>"))
    else:
        both = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = sketches.join(both.groupBy(F.col("a").alias("did")).agg(F.collect_set("b").alias("failed")), "did", "left")
    found = cells(live, GRID).join(known, "did").groupBy("sig", "x", "y").applyInArrow(pairs, "a long, b long, sig long, hub long")
    return found.distinct()


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Two documents link when 100 * shared >= percent * all of their shingles of n words, lower-cased in A-Z; a text with
    fewer words is one shingle, one without words or a null text has none and links with nothing. Rows with one doc_id
    are one document. A null doc_id links with nothing and has no component. Other columns are left out; an empty table
    gives no rows. Shingles are compared by 64-bit hashes, and equal sets told by two sums of 64 bits.
    """
    every = keyed(docs)
    base = every.where(~F.col("none"))
    rows = saved(candidates(base, n, percent), "partenum")
    sketches = rows.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("did"), F.col("b").alias("n"), "bits")
    equal = saved(equal_sets(rows), "equal")
    # where a document has no other set, the smallest with that set stands for it
    twins = equal.where("alone").select("did", "rep")
    pairs = rows.where(F.col("kind") == CANDIDATE).select("a", "b").distinct()
    pairs = by_rep(by_rep(pairs, "a", twins), "b", twins).where("a <> b")
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = equal.select(F.col("rep").alias("a"), F.col("did").alias("b"))
    labels = None
    if not pairs.isEmpty():
        close = saved(possible(pairs, sketches, percent), "possible")
        checked = compare(base, close, n, percent)
        links = saved(links.unionByName(checked.where("link").select("a", "b")), "links")
        labels = components(links)
        of = rows.where(F.col("kind") == MEMBER).groupBy(F.col("a").alias("sig"), F.col("b").alias("did")).agg(F.min("hub").alias("hub"))
        of = by_rep(by_rep(of, "did", twins), "hub", twins).groupBy("sig", "did").agg(F.min("hub").alias("hub"))
        every_one = saved(of, "members")
        members, failed = families(every_one), None
        dropped(every_one)
        # a hub's pair that doesn't link leaves open whether the others of that signature do
        while True:
            found = saved(unlinked(members, sketches, labels, failed, percent), "unlinked")
            more = found.where("sig IS NULL").select("a", "b")
            if more.isEmpty():
                break
            checked, old = compare(base, more, n, percent), links
            new = checked.where("link").select("a", "b")
            if not new.isEmpty():
                links = saved(links.unionByName(new), "links")
                labels = components(links)
                dropped(old)
            # signatures whose open pairs have all been compared are done with
            again = found.where("sig IS NOT NULL").select("sig", F.col("a").alias("did"), "hub")
            if again.isEmpty():
                break
            bad = checked.where("not link").select("a", "b")
            failed = saved(bad if failed is None else failed.unionByName(bad), "failed")
            left = saved(again, "members")
            dropped(members, found, checked)
            members = left
        dropped(members, close, pairs)
    labels = components(links) if labels is None else labels
    counted = rows.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("node"), F.col("b").alias("n_shingles"))
    named = counted.join(labels, "node", "left").select(F.col("node").alias("doc_id"), "n_shingles", F.coalesce("component", "node").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(batch.column("text"), n)], pa.int64())], ["n_shingles"])

    nameless = every.where("none").select("text").mapInArrow(count, "n_shingles long")
    none = F.lit(None).cast("long")
    return named.unionByName(nameless.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))
