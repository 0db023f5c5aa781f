"""Phrase collocations, from suffix arrays over word ids.

Texts are read in shards. In each, words get ids, and a suffix array of the id sequence is built by prefix doubling: ranks
of one word give ranks of two, four and eight. Neighbours in it have a longest common prefix (LCP); the suffixes between
two places where it falls below n are an LCP interval, all the shard's occurrences of one phrase of n words. Their sizes
are added up by phrase over all shards, first inside each task.

Three passes keep this small and lose nothing: a phrase that occurs `least` times has only words and word pairs that do.
First words are counted; then cells of 48 bits, to which pairs of frequent words are hashed, packed by bucket; then all
phrases along chains of pairs in frequent cells, by their text. Which words and cells are frequent is known by Bloom
filters of at most 4 MB. A cell that two pairs share, or a filter that is too full, only lets more phrases be counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import Bloom, flat, gram_hashes, mixed, saved, shuffle_partitions, slices, span_hashes, text_bytes, texts_of, trim, word_spans
from siftline.tables import dropped

LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Bytes of text in a shard; texts for each bucket of pairs; pairs that a task holds before it sends them.
SHARD, BUCKET_BYTES, HELD = 4 << 20, 16 << 20, 1 << 21
CELL = np.uint64((1 << 48) - 1)
#: Pieces end at these, words also at blanks.
ENDS = b".,;:!?\n\x0b\x0c\r"
IS_END = np.zeros(256, bool)
IS_END[list(ENDS)] = True
BLANKED = np.where(IS_END, 32, np.arange(256)).astype(np.uint8)
#: Lists of a language's best are cut to `top` in so many parts before they meet.
PARTS = 64
COUNTS = "lang string, phrase string, h long, n long"


class Shard:
    """Words of some texts: where they are in buf, a hash of each with its language, and whether the next is in the same piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.buf, off = flat(batch.column("text"), lower=True)
        self.starts, self.lens, before = word_spans(BLANKED[self.buf], off)
        lang = batch.column("lang").dictionary_encode()
        self.langs = lang.dictionary
        doc = np.repeat(np.arange(batch.num_rows), np.diff(before))
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        names, at = flat(self.langs)
        self.hashes = mixed(span_hashes(self.buf, self.starts, self.lens) ^ mixed(span_hashes(names, at[:-1], np.diff(at)))[self.lang])
        piece = np.cumsum(IS_END[self.buf])[self.starts]
        self.next = np.zeros(len(doc), bool)
        self.next[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The n words from each word on, joined by one space."""
        source = np.append(self.buf, np.uint8(32))
        starts, lens = np.full((len(first), 2 * n - 1), len(self.buf)), np.ones((len(first), 2 * n - 1), np.int64)
        for j in range(n):
            starts[:, 2 * j], lens[:, 2 * j] = self.starts[first + j], self.lens[first + j]
        body, at = texts_of(source, starts.ravel(), lens.ravel())
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at[:: 2 * n - 1].tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())

    def rows(self, first: np.ndarray, n: int, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        langs = self.langs.take(pa.array(self.lang[first]))
        return pa.RecordBatch.from_arrays([langs, self.phrases(first, n), pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "h", "n"])


def chains(link: np.ndarray, least: int) -> np.ndarray:
    """Positions in runs of at least `least` that are linked each to the next; -1 ends each run."""
    if not len(link):
        return np.zeros(0, np.int64)
    run = np.cumsum(np.append(True, ~link[:-1])) - 1
    keep = np.flatnonzero(np.bincount(run)[run] >= least)
    _, of = np.unique(run[keep], return_inverse=True)
    out = np.full(len(keep) + (of[-1] + 1 if len(keep) else 0), -1)
    out[np.arange(len(keep)) + of] = keep
    return out


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least, by prefix doubling."""
    rank, known = symbols, 1
    while known < depth:
        after = np.zeros_like(rank)
        after[:-known] = rank[known:] + 1
        kinds, rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)
        known *= 2
        if len(kinds) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many first symbols, up to `depth`, each suffix shares with the one before it in the order."""
    padded = np.concatenate([symbols, -1 - np.arange(depth)])
    same, out = np.ones(len(order), bool), np.zeros(len(order), np.int64)
    same[:1] = False
    for t in range(depth):
        at = padded[order + t]
        same[1:] &= at[1:] == at[:-1]
        out += same
    return out


def intervals(hashes: np.ndarray, chain: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, the position of one occurrence and the number of all, of each phrase of low to high words along the chains."""
    words = chain >= 0
    _, ids = np.unique(hashes[chain[words]], return_inverse=True)
    ends = np.flatnonzero(~words)
    symbols = np.zeros(len(chain), np.int64)
    symbols[words] = ids
    symbols[ends] = len(ids) + np.arange(len(ends))  # no two ends are equal, so no phrase goes over one
    order = suffix_array(symbols, high)
    lcp = common_prefixes(symbols, order, high)
    room = (ends[np.searchsorted(ends, np.arange(len(chain)))] - np.arange(len(chain)))[order]
    for n in range(low, high + 1):
        heads = np.flatnonzero(lcp < n)
        size = np.diff(np.append(heads, len(lcp)))
        ok = room[heads] >= n
        yield n, chain[order[heads[ok]]], size[ok]


def counted(base: DataFrame, make: Callable[[Shard], Iterator[pa.RecordBatch]]) -> DataFrame:
    """lang, phrase, h, n: what make() counts in each shard, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD):
            yield from make(Shard(batch))
        trim()

    return base.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.max("h").alias("h"), F.sum("n").alias("n"))


def words_of(shard: Shard) -> Iterator[pa.RecordBatch]:
    found, first, counts = np.unique(shard.hashes, return_index=True, return_counts=True)
    yield shard.rows(first, 1, found, counts)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def packed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def frequent_cells(base: DataFrame, words: Broadcast, least: int) -> DataFrame:
    """h: a hash of each cell whose pairs of frequent words occur `least` times in all."""
    buckets = max(shuffle_partitions(base.sparkSession), text_bytes(base) // BUCKET_BYTES)

    def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        shard = Shard(batch)
        ok = words.value.passes(shard.hashes)
        link = shard.next & ok
        link[:-1] &= ok[1:]
        chain = chains(link, 2)
        if not len(chain):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        _, first, counts = next(intervals(shard.hashes, chain, 2, 2))
        return gram_hashes(shard.hashes, 2)[first] & CELL, counts

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cells, counts = summed(*map(np.concatenate, zip(*held)))
        to = (cells % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")  # in a bucket, cells stay in order
        cells, counts, to = cells[order] // np.uint64(buckets), counts[order], to[order]
        used, heads = np.unique(to, return_index=True)
        parts = [(cells[a:b], counts[a:b]) for a, b in zip(heads, [*heads[1:], len(to)])]
        blocks = [[packed(np.diff(c, prepend=np.uint64(0))) for c, _ in parts], [packed(n) for _, n in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(b, pa.binary()) for b in blocks)], ["bucket", "cells", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text", SHARD):
            held.append(pairs(batch))
            size += len(held[-1][0])
            if size >= HELD:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)
        trim()

    def receive(table: pa.Table) -> pa.Table:
        cells = np.concatenate([np.cumsum(unpacked(b), dtype=np.uint64) for b in table.column("cells").to_pylist()])
        counts = np.concatenate([unpacked(b).astype(np.int64) for b in table.column("counts").to_pylist()])
        cells, counts = summed(cells, counts)
        cells = cells[counts >= least] * np.uint64(buckets) + np.uint64(table.column("bucket")[0].as_py())
        trim()
        return pa.table({"h": mixed(cells).view(np.int64)})

    return base.select("lang", "text").mapInArrow(send, "bucket long, cells binary, counts binary").groupBy("bucket").applyInArrow(receive, "h long")


def along(pairs: Broadcast, longest: int) -> Callable[[Shard], Iterator[pa.RecordBatch]]:
    """Counts phrases of two words or more along chains of pairs in frequent cells."""

    def make(shard: Shard) -> Iterator[pa.RecordBatch]:
        link = shard.next.copy()
        link[:-1] &= pairs.value.passes(mixed(gram_hashes(shard.hashes, 2) & CELL))
        chain = chains(link, 2)
        if len(chain):
            for n, first, counts in intervals(shard.hashes, chain, 2, longest):
                yield shard.rows(first, n, np.zeros(len(first), np.uint64), counts)

    return make


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """totals (lang, n: all words) and grams (lang, phrase, k, f): all phrases of 1 to `longest` words that occur `least` times.

    A null text is empty, a null lang is `und`. Phrases are told apart by their text; inside a shard, words by 64-bit hashes.
    """
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = saved(counted(base, words_of), "words")
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    often = F.col("n") >= least
    rows = lambda df, k: df.select("lang", "phrase", k.cast("int").alias("k"), F.col("n").alias("f"))
    grams = rows(words.where(often), F.lit(1))
    if longest > 1:
        cells = saved(frequent_cells(base, sc.broadcast(Bloom.of(words.where(often).select("h"))), least), "pair-cells")
        more = counted(base, along(sc.broadcast(Bloom.of(cells)), longest)).where(often)
        grams = grams.unionByName(rows(more, F.size(F.split("phrase", " "))))
    out = saved(grams, "phrases")
    dropped(words)
    return totals, out


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) of longs, exactly, while both products have at most 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each lang, by score, then a, then phrase.

    Texts are lower-cased in A-Z and split into pieces at [.,;:!?\\x0A-\\x0D], those into words [^\\x20\\x09]+. A phrase of 2
    to `longest` words that occurs a >= `least` times inside pieces is cut after its first words into parts that occur l
    and r times; its score is the lowest floor(1000 * a * n / (l * r)) of all cuts, the first of equal ones; n: all words.
    It is left out if a longer one contains it and 100 * f(longer) >= share * a. A null text is empty, a null lang is
    `und`; copies and rows with one doc_id count each. Other columns are left out; an empty table gives no rows.
    """
    totals, grams = phrase_counts(docs, longest, least)
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    every = grams.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> struct(i, m))))")
    inner = every.where("k > 2").withColumn("s", F.explode(spans)).select("lang", part(F.col("s.i"), F.col("s.m")).alias("phrase"), F.col("a").alias("f"))
    over = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = every.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda name, count: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score("a", "n", "l", "r").alias("score"), "cut", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    # no task sees more than `top` rows of each part
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
