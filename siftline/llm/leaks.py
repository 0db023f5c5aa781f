"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, to powers of two. For a partition up to size s, each document is seen
as overlapping windows of 2 s shingles, s apart, so an item's passage lies whole in a window not much larger than itself,
whatever the document's length. One permutation of hash values dealt to BINS bins gives an item's and a window's
MinHash signature: the least value of each bin, so BINS values at most, however many shingles there are. A document is a
candidate for an item if one of its windows shares a value with the item's signature (bands of one row). An item of s
shingles that a window holds to 80 % has a Jaccard similarity of 0.19 or more with it, so all bins miss with a chance below
1e-9 where bins are full; where they are sparse, a value is only missed if another of the window is smaller in its bin.
Candidates are verified by exact shingle containment, word by word.

A window's signature is worked out only around values that some item's signature holds, which gives the same matches. Items
are read in blocks of a bounded size; each block is broadcast, and documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import doc_id, flat, gram_hashes, keyed, text_bytes, slices, span_hashes, word_spans

WORDS, PERCENT = 5, 80
#: Bytes of item texts broadcast at once.
BLOCK_BYTES = 16 << 20
#: Values of a signature at most.
BINS = 128


class Item:
    """Distinct shingles of an item, sorted by hash: each is a slice of its words joined by spaces."""

    def __init__(self, text: str, n: int) -> None:
        words = text.encode().lower().split()
        self.text, self.words = b" ".join(words), min(n, len(words))
        size = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(size + 1) - size - 1
        self.hashes, self.slices = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        if words:
            first: dict[bytes, int] = {}
            for i in range(len(words) - self.words + 1):
                j = i + self.words - 1
                first.setdefault(self.text[starts[i] : starts[j] + size[j]], i)
            at = np.array(list(first.values()), np.int64)
            buf, _ = flat(pa.array([self.text], pa.binary()))
            hashes = gram_hashes(span_hashes(buf, starts, size), self.words)[at]
            order = np.argsort(hashes, kind="stable")
            self.hashes, at = hashes[order], at[order]
            last = at + self.words - 1
            self.slices = np.stack([starts[at], starts[last] + size[last]], 1)

    def shared(self, grams: np.ndarray, at: int, whole: bytes, starts: np.ndarray, lens: np.ndarray) -> int:
        """How many shingles are in a document: grams are its shingles' hashes, whose words begin with word number `at`."""
        places = np.flatnonzero(np.isin(grams, self.hashes))
        order = places[np.argsort(grams[places], kind="stable")]
        found, first = np.unique(grams[order], return_index=True)
        spans = dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        out = 0
        for h, (x, y) in zip(self.hashes.tolist(), self.slices.tolist()):
            a, b = spans.get(h, (0, 0))
            # the first place tells, but for different shingles with one hash
            for p in order[a:b].tolist():
                if b" ".join(whole[starts[w] : starts[w] + lens[w]] for w in range(at + p, at + p + self.words)) == self.text[x:y]:
                    out += 1
                    break
        return out


class Items:
    """A block of items and their signatures."""

    def __init__(self, ids: list, texts: list[str], n: int) -> None:
        self.ids, self.items, self.parts = ids, [Item(t or "", n) for t in texts], {}
        rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            if len(own := np.unique(item.hashes)):
                upper = 1 << max(0, len(item.hashes) - 1).bit_length()
                for h in minima(own, bins_of(own, BINS)).tolist():
                    rows.setdefault((item.words, upper), []).append((h, k))
        for key, pairs in rows.items():
            pairs.sort()
            values = np.array([p[0] for p in pairs], np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.parts[key] = (values, np.array([p[1] for p in pairs], np.int64), bits)


def bins_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)


def minima(hashes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The least value of each bin."""
    order = np.lexsort((hashes, bins))
    new = np.ones(len(order), bool)
    new[1:] = bins[order][1:] != bins[order][:-1]
    return hashes[order][new]


def candidates(items: Items, words: np.ndarray, before: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs whose signatures meet; words: hashes, before: the number of words before each document."""
    out: set[tuple[int, int]] = set()
    of = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for (k, upper), (values, owners, bits) in items.parts.items():
        grams = gram_hashes(words, k)
        if not len(grams):
            continue
        at = np.flatnonzero(bits[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        at = at[of[at] == of[at + k - 1]]
        place = np.minimum(np.searchsorted(values, grams[at]), len(values) - 1)
        at = at[values[place] == grams[at]]
        seen: set[tuple[int, int]] = set()
        for i in at.tolist():
            doc = int(of[i])
            first, last = int(before[doc]), int(before[doc + 1]) - k + 1
            for w in {(i - first) // upper, max(0, (i - first) // upper - 1)}:
                if (doc, w) in seen:
                    continue
                seen.add((doc, w))
                window = grams[first + w * upper : min(last, first + (w + 2) * upper)]
                sign = minima(window, bins_of(window, BINS))
                a, b = np.searchsorted(values, sign, "left"), np.searchsorted(values, sign, "right")
                for x, y in zip(a[b > a].tolist(), b[b > a].tolist()):
                    out.update((doc, item) for item in owners[x:y].tolist())
    return out


def verified(items: Items, batch: pa.RecordBatch, text: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Row, item, shingles of the item, and those found in the row's text."""
    buf, off = flat(batch.column(text), lower=True)
    starts, lens, before = word_spans(buf, off)
    words, whole, out, grams = span_hashes(buf, starts, lens), buf.tobytes(), [], {}
    for doc, number in sorted(candidates(items, words, before)):
        item = items.items[number]
        if (doc, item.words) not in grams:
            grams = {(doc, item.words): gram_hashes(words[before[doc] : before[doc + 1]], item.words)}
        shared, size = item.shared(grams[doc, item.words], int(before[doc]), whole, starts, lens), len(item.hashes)
        if 100 * shared >= percent * size:
            out.append((doc, number, size, shared))
    return out


def blocks(items: DataFrame, n: int) -> Iterator[Items]:
    """The items in blocks that fit a broadcast, dealt by a hash."""
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    many = max(1, -(-text_bytes(rows) // BLOCK_BYTES))
    for b in range(many):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b) if many > 1 else rows
        found = part.collect()
        yield Items([r[0] for r in found], [r[1] for r in found], n)


def leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, item_shingles, shared, containment.

    A document holds an item if at least percent of the item's distinct shingles of n words, lower-cased in A-Z, are in
    the document. An item with fewer words is one shingle; one without words or with a null text is in no document.
    Equal items are found each; rows with one doc_id are searched each. Other columns are left out; an empty table on
    either side gives no rows.
    """
    spark = docs.sparkSession
    base = keyed(docs).select(doc_id(), "text")
    kind = dict(items.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, item_shingles long, shared long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items, n):
        held = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4 << 20):
                rows = verified(held.value, batch, 1, percent)
                if rows:
                    doc, item, size, shared = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc)), "item_id": pa.array([held.value.ids[i] for i in item]), "item_shingles": pa.array(size, pa.int64()), "shared": pa.array(shared, pa.int64())})

        out = out.unionByName(base.mapInArrow(search, schema))
    return out.select("doc_id", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    spark = docs.sparkSession
    text = docs.columns.index("text")
    for block in blocks(items, n):
        held = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4 << 20):
                bad = {r[0] for r in verified(held.value, batch, text, percent)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
