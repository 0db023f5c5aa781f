"""Scores by a Brown class-based bigram model.

Each word that occurs twice or more in training has a class of its own choice, whatever the size of the vocabulary, and the
number of classes grows as its cube root. The exchange algorithm begins with units: the most frequent words (`WORDS` or
more), the end token, and for all other words the hash of their last two bytes; it moves units between classes while the
likelihood of the class bigrams grows. Then a round over all other words that occur twice moves each to the class where the
classes around it are likeliest; its counts by class come together in buckets of words. Only words seen once or never keep
their ending's unit. Class bigrams are counted anew with these classes.

A token's probability is P(its class | the class before) * P(its unit | its class) * P(it | its unit), where a word of a
class of its own is a unit; transitions are smoothed towards the classes' own frequencies, and words by adding half a count
to each and to the unknown one.

Counts are over all training documents: word counts and classes stay tables. What reaches the driver are the `HEAD` most
frequent words with their classes, and tables of units and classes. A document's other words meet theirs in a join, by
64-bit hashes, which tell words of up to eight bytes apart for certain.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import byte_strings, doc_id, flat, in_fold, keyed, mixed, saved, shuffle_partitions, slices, span_hashes, text_bytes, word_spans
from siftline.tables import dropped

#: Frequent words that are units, endings, and classes: the first and the last at least, as both grow with the vocabulary.
WORDS, SUFFIXES, CLASSES = 500, 509, 64
#: Words whose counts and classes are sent to all tasks; those of others are joined.
HEAD = 1 << 16
ROUNDS = 4
#: Weight of a class's own frequency in its transitions, in counts.
BACK = 20.0
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 4 << 20
END = b" "


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, lengths and hashes of all words, lower-cased in A-Z, and the number of words before each text."""
    buf, off = flat(batch.column("text"), lower=True)
    starts, lens, before = word_spans(buf, off)
    return buf, starts, lens, span_hashes(buf, starts, lens), before


def kinds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the number of its kind, and of each kind its hash and first word; looked up once a kind, not once a word."""
    number, own = pd.factorize(hashes)
    first = np.zeros(len(own), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, own, first


def suffix_unit(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    last = buf[starts + lens - 1].astype(np.uint64)
    other = np.where(lens > 1, buf[starts + np.maximum(lens, 2) - 2], 0).astype(np.uint64)
    return (mixed(last * np.uint64(256) + other) % np.uint64(SUFFIXES)).astype(np.int64)


def looked_up(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash is among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def with_ends(values: np.ndarray, before: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text and one end after it, and the text of each."""
    counts = np.diff(before)
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    out = np.full(len(doc), end, np.int64)
    keep = np.ones(len(doc), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = values
    return out, doc


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit. bigrams: counts of (unit before, unit)."""
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight, kind="stable")
    # the most frequent units begin a class each; the others join one by one, then all are moved again and again
    of = np.full(n, -1)
    of[order[:classes]] = np.arange(min(classes, n))
    table = np.zeros((classes, classes))
    table[: min(classes, n), : min(classes, n)] = bigrams[np.ix_(order[:classes], order[:classes])]

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            if not weight[w]:
                continue
            a, own = of[w], bigrams[w, w]
            in_ = of >= 0
            in_[w] = False
            out = np.bincount(of[in_], weights=bigrams[w, in_], minlength=classes)
            into = np.bincount(of[in_], weights=bigrams[in_, w], minlength=classes)
            if a >= 0:
                table[a] -= out
                table[:, a] -= into
                table[a, a] -= own
            # gain of adding w to each class: its row, its column, and the cell where both meet
            rows, cols = f(table + out) - f(table), f(table + into[:, None]) - f(table)
            cell = np.diag(table)
            gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols) + f(cell + out + into + own) - f(cell)
            left, right = table.sum(1), table.sum(0)
            gain -= f(left + out.sum() + own) - f(left) + f(right + into.sum() + own) - f(right)
            b = int(np.argmax(gain))
            b = b if a < 0 or gain[b] > gain[a] + 1e-9 else a
            moved += a != b
            of[w] = b
            table[b] += out
            table[:, b] += into
            table[b, b] += own
        if not moved:
            break
    return np.maximum(of, 0)


def head_words(words: DataFrame, most: int) -> DataFrame:
    """About `most` of the most frequent words, from a histogram whose bars are 1 % wide (some thousands of rows).

    Of the bar that only fits in part, as many as fit are chosen by a hash.
    """
    bar = F.floor(F.log("n") * 100)
    left, last, share = most, -1, 0
    for r in words.groupBy(bar.alias("bar")).agg(F.count("*").alias("words")).orderBy(F.desc("bar")).collect():
        if r["words"] > left:
            last, share = r["bar"], (left << 20) // r["words"]
            break
        left -= r["words"]
    return words.where((bar > last) | (bar == last) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share))


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpacked(block: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(block))


def tallied(hashes: np.ndarray, cells: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes; and of the pairs of a hash and a cell below `width`, the hash's number, the cell and the sum of n."""
    own, nth = np.unique(hashes, return_inverse=True)
    at, back = np.unique(nth * width + cells, return_inverse=True)
    return own, at // width, at % width, np.bincount(back, weights=n, minlength=len(at)).astype(np.int64)


def preferred(nth: np.ndarray, cells: np.ndarray, n: np.ndarray, words: int, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class in which each word's neighbours are likeliest, and how often the word stands.

    nth, cells, n: how often a word has a neighbour of a class, before it (cells below the number of classes) or after it.
    """
    classes = gain.shape[1]
    best, often = np.zeros(words, np.int64), np.bincount(nth[cells < classes], weights=n[cells < classes], minlength=words).astype(np.int64)
    cut = np.searchsorted(nth, np.arange(0, words + 2048, 2048))
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        first, some = 2048 * k, min(2048, words - 2048 * k)
        rows = np.bincount((nth[a:b] - first) * 2 * classes + cells[a:b], weights=n[a:b], minlength=some * 2 * classes)
        best[first : first + some] = (rows.reshape(some, -1) @ gain).argmax(1)
    return best, often


def lm_scores(docs: DataFrame, held_out: int = 1, folds: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows whose crc32(doc_id) mod folds is held_out teach nothing; a null doc_id teaches. Tokens are words
    [^\\x20\\x09-\\x0D]+ lower-cased in A-Z, and one end; a null or empty text is the end alone. base_score is that of
    smoothed token counts, score that of the class model; both are log10. Rows that repeat a doc_id are scored each. An
    empty table gives no rows; with no row to learn from, N and V are 0. Other columns are left out.
    """
    spark = docs.sparkSession
    base = keyed(docs).withColumn("held_out", in_fold(held_out, folds, doc_id()))
    train = base.where("not held_out")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            buf, starts, lens, hashes, _ = tokens(batch)
            number, _, first = kinds(hashes)
            n = np.bincount(number, minlength=len(first))
            words = byte_strings(buf, starts[first], lens[first])
            yield pa.RecordBatch.from_arrays([pa.array([*words, END], pa.binary()), pa.array([*n.tolist(), batch.num_rows], pa.int64())], ["word", "n"])

    vocab = saved(train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = vocab.where(F.col("word") != F.lit(END))
    twice = words.where("n > 1").count()
    classes = max(CLASSES, round(twice ** (1 / 3)))
    frequent = max(WORDS, 4 * classes) if classes > CLASSES else WORDS
    buckets = max(shuffle_partitions(spark), text_bytes(docs) // BUCKET_BYTES, 1)
    head = head_words(words, HEAD).collect()
    head.sort(key=lambda r: (-r["n"], r["word"]))
    ends = [r["n"] for r in vocab.where(F.col("word") == F.lit(END)).collect()]
    ends = ends[0] if ends else 0
    buf, off = flat(pa.array([r["word"] for r in head], pa.binary()))
    hashes = span_hashes(buf, off[:-1], np.diff(off))
    order = np.argsort(hashes)
    rank = np.arange(len(head))[order]
    # hash, count, and number among the clustered words or -1, of each head word
    keys, held, number = hashes[order], np.array([r["n"] for r in head], np.int64)[order], np.where(rank < frequent, rank, -1)
    end_unit, units = frequent + SUFFIXES, frequent + SUFFIXES + 1
    head_table = spark.sparkContext.broadcast((keys, held, number))

    def unit_of(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each word's unit."""
        keys, _, number = head_table.value
        at = looked_up(keys, hashes)
        num = np.where(at >= 0, number[at], -1) if len(keys) else at
        return np.where(num >= 0, num, frequent + suffix_unit(buf, starts, lens))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(units * units, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            buf, starts, lens, hashes, before = tokens(batch)
            number, own, first = kinds(hashes)
            unit, _ = with_ends(unit_of(buf, starts[first], lens[first], own)[number], before, end_unit)
            # before a text's first word stands an end
            last = np.concatenate([[end_unit], unit[:-1]])
            seen += np.bincount(last * units + unit, minlength=units * units)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["pair", "n"])

    seen = train.select("text").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most units ** 2 rows
    bigrams = np.zeros(units * units)
    bigrams[seen["pair"].to_numpy(np.int64)] = seen["n"].to_numpy()
    bigrams = bigrams.reshape(units, units)
    of = exchange(bigrams, classes)
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    # log of P(class before | class) and of P(class after | class)
    gain = np.log(np.concatenate([(table + 0.5) / (table.sum(0) + 0.5 * classes), ((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * classes)).T]))
    first_model = spark.sparkContext.broadcast((of, gain))

    def bucket_of(hashes: np.ndarray) -> np.ndarray:
        return (mixed(hashes ^ np.uint64(7)) % np.uint64(buckets)).astype(np.int64)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of words that aren't units, how often each class stands before and after them: packed by bucket."""
        of, _ = first_model.value
        for batch in slices(batches, "text", 6 << 20):
            buf, starts, lens, hashes, before = tokens(batch)
            number, own, first = kinds(hashes)
            unit = unit_of(buf, starts[first], lens[first], own)
            cls, _ = with_ends(of[unit][number], before, int(of[end_unit]))
            at = np.arange(len(number)) + np.repeat(np.arange(batch.num_rows), np.diff(before))
            some = (unit >= frequent)[number]
            left, right = np.concatenate([[of[end_unit]], cls])[at][some], cls[at + 1][some] + classes
            back, pairs = pd.factorize(np.concatenate([number[some] * (2 * classes) + left, number[some] * (2 * classes) + right]))
            nth, cell, n = pairs // (2 * classes), pairs % (2 * classes), np.bincount(back, minlength=len(pairs))
            to = bucket_of(own)
            order = np.argsort(to[nth], kind="stable")
            nth, cell, n = nth[order], cell[order], n[order]
            used, cut = np.unique(to[nth], return_index=True)
            blocks = []
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(nth)]):
                mine, place = np.unique(nth[x:y], return_inverse=True)
                blocks.append(packed(own[mine], place.astype(np.uint32), cell[x:y].astype(np.uint16), n[x:y].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def choose(found: pa.Table) -> pa.Table:
        _, gain = first_model.value
        blocks = [unpacked(x) for x in found.column("block").to_pylist()]
        own, nth, cell, n = tallied(np.concatenate([b[0][b[1]] for b in blocks]), np.concatenate([b[2] for b in blocks]).astype(np.int64), np.concatenate([b[3] for b in blocks]), 2 * classes)
        best, often = preferred(nth, cell, n, len(own), gain)
        own, best = own[often > 1], best[often > 1]
        return pa.table({"bucket": found.column("bucket").slice(0, 1), "block": pa.array([packed(own, best.astype(np.uint16))], pa.binary())})

    sent = train.select("text").mapInArrow(around, "bucket long, block binary")
    chosen = saved(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(choose, "bucket long, block binary"), "classes")

    def of_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                own, cls = unpacked(block)
                at = looked_up(head_table.value[0], own)
                yield pa.RecordBatch.from_arrays([pa.array(at[at >= 0]), pa.array(cls[at >= 0].astype(np.int64))], ["at", "cls"])

    # the class of each head word, or -1 where it is its ending's
    head_class = np.where(number >= 0, of[number], -1) if len(number) else np.zeros(0, np.int64)
    own_class = chosen.mapInArrow(of_head, "at long, cls long").toPandas()  # at most a row for each head word
    head_class[own_class["at"].to_numpy(np.int64)] = own_class["cls"].to_numpy(np.int64)
    classed = spark.sparkContext.broadcast((of, head_class))

    def class_of(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's class, or -1 if it must be joined; its place among the head words, or -1; its ending; and whether it is a unit."""
        of, head_class = classed.value
        at, ending = looked_up(head_table.value[0], hashes), suffix_unit(buf, starts, lens)
        if not len(head_class):
            return np.full(len(at), -1), at, ending, np.zeros(len(at), bool)
        own = (at >= 0) & (head_class[at] >= 0)
        return np.where(own, head_class[at], np.where(at >= 0, of[frequent + ending], -1)), at, ending, own

    def resolved(block: tuple[np.ndarray, np.ndarray] | None, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        of, at = classed.value[0][frequent + ending.astype(np.int64)], looked_up(block[0], hashes) if block else np.full(len(hashes), -1)
        return np.where(at >= 0, block[1][at].astype(np.int64), of) if block and len(block[0]) else of

    pair_schema = "bucket long, block binary, pair long, n long"

    def pair_rows(seen: np.ndarray, used: list[int], blocks: list[bytes]) -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        none = [None] * len(at)
        return pa.RecordBatch.from_arrays([pa.array([*none, *used], pa.int64()), pa.array([*none, *blocks], pa.binary()), pa.array([*at.tolist(), *[None] * len(used)], pa.int64()), pa.array([*seen[at].tolist(), *[None] * len(used)], pa.int64())], ["bucket", "block", "pair", "n"])

    def dealt(to: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
        order = np.argsort(to, kind="stable")
        used, cut = np.unique(to[order], return_index=True)
        return used.tolist(), [packed(*(c[order[x:y]] for c in columns)) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(to)])]

    def class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of class pairs; pairs with a word whose class is to be joined go to its bucket, if both are, to the first's."""
        end = int(classed.value[0][end_unit])
        for batch in slices(batches, "text", 6 << 20):
            buf, starts, lens, hashes, before = tokens(batch)
            number, own, first = kinds(hashes)
            cls, _, ending, _ = class_of(buf, starts[first], lens[first], own)
            cls, ending = with_ends(cls[number], before, end)[0], ending[number]
            hashes, ending = with_ends(hashes.view(np.int64), before, 0)[0].view(np.uint64), with_ends(ending, before, 0)[0]
            last, last_hash, last_ending = np.r_[end, cls[:-1]], np.r_[np.uint64(0), hashes[:-1]], np.r_[0, ending[:-1]]
            known = (cls >= 0) & (last >= 0)
            seen = np.bincount(last[known] * classes + cls[known], minlength=classes * classes)
            open_ = np.flatnonzero(~known)
            by_last = last[open_] < 0
            # the word to be joined, its ending, its partner's class before (or, from `classes` on, after) it, or -1 and the partner
            key, mark = np.where(by_last, last_hash[open_], hashes[open_]), np.where(by_last, last_ending[open_], ending[open_])
            cell = np.where(by_last, np.where(cls[open_] >= 0, cls[open_] + classes, -1), last[open_])
            both = cell < 0
            used, blocks = dealt(bucket_of(key), [key, mark.astype(np.uint16), cell.astype(np.int32), np.where(both, hashes[open_], np.uint64(0)), np.where(both, ending[open_], 0).astype(np.uint16)])
            yield pair_rows(seen, used, blocks)

    def join_once(found: pa.Table, held: pa.Table) -> pa.Table:
        own = unpacked(held.column("block")[0].as_py()) if held.num_rows else None
        seen, used, sent = np.zeros(classes * classes, np.int64), [], []
        for block in found.column("block").to_pylist():
            key, mark, cell, other, other_mark = unpacked(block)
            cls = resolved(own, key, mark)
            before, after, both = (cell >= 0) & (cell < classes), cell >= classes, cell < 0
            seen += np.bincount(np.r_[cell[before] * classes + cls[before], cls[after] * classes + cell[after] - classes], minlength=classes * classes)
            sent.append((other[both], other_mark[both], cls[both].astype(np.int32)))
        other, other_mark, cls = (np.concatenate(x) for x in zip(*sent)) if sent else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int32))
        nothing = [np.zeros(len(other), np.uint64), np.zeros(len(other), np.uint16)]
        used, blocks = dealt(bucket_of(other), [other, other_mark, cls, *nothing])
        return pa.Table.from_batches([pair_rows(seen, used, blocks)])

    by_bucket = chosen.groupBy("bucket")
    once = saved(train.select("text").mapInArrow(class_pairs, pair_schema), "pairs")
    again = saved(once.where("bucket IS NOT NULL").groupBy("bucket").cogroup(by_bucket).applyInArrow(join_once, pair_schema), "pairs")
    done = again.where("bucket IS NOT NULL").groupBy("bucket").cogroup(by_bucket).applyInArrow(join_once, pair_schema)
    pairs_seen = once.unionByName(again).unionByName(done).where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most classes ** 2 rows
    dropped(once, again)
    table = np.zeros(classes * classes)
    table[pairs_seen["pair"].to_numpy(np.int64)] = pairs_seen["n"].to_numpy()
    table = table.reshape(classes, classes)
    own = (table.sum(0) + 0.5) / (table.sum() + 0.5 * classes)
    step = np.log10((table + BACK * own) / (table.sum(1, keepdims=True) + BACK))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = flat(batch.column("word"))
            starts, lens = off[:-1], np.diff(off)
            hashes = span_hashes(buf, starts, lens)
            cls, at, ending, own = class_of(buf, starts, lens, hashes)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(hashes.view(np.int64)), pa.array(np.where(own, cls, -1)), pa.array(at >= 0), pa.array(ending)], ["word", "n", "hash", "cls", "head", "ending"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                own, cls = unpacked(block)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(cls.astype(np.int64))], ["hash", "found"])

    marked = words.mapInArrow(hashed, "word binary, n long, hash long, cls long, head boolean, ending long")
    tail = marked.where("not head and n > 1").join(chosen.mapInArrow(rows_of, "hash long, found long"), "hash", "left").withColumn("cls", F.coalesce("found", F.lit(-1))).select(*marked.columns)
    known_words = saved(marked.where("head or n = 1").unionByName(tail).drop("word"), "classed")
    dropped(vocab, chosen)
    in_class, unit_n, unit_v = np.zeros(classes), np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    unit = F.when(F.col("cls") >= 0, F.col("cls")).otherwise(-1 - F.col("ending"))
    for r in known_words.groupBy(unit.alias("unit")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        if r["unit"] >= 0:
            in_class[r["unit"]] += r["n"] + 0.5 * r["v"]
        else:
            unit_n[-1 - r["unit"]], unit_v[-1 - r["unit"]] = r["n"], r["v"]
    np.add.at(in_class, of[frequent:end_unit], unit_n + 0.5)
    in_class[of[end_unit]] += ends + 0.5
    # log of P(word | class) but for the word's own count: of words with a class of their own, of endings, and of the end
    own_part = -np.log10(np.maximum(in_class, 0.5))
    ending_part = np.log10((unit_n + 0.5) / in_class[of[frequent:end_unit]]) - np.log10(unit_n + 0.5 * (unit_v + 1))
    end_part = np.log10((ends + 0.5) / in_class[of[end_unit]])
    model = spark.sparkContext.broadcast((step, own_part, ending_part))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, own_part, ending_part = model.value
        end = int(classed.value[0][end_unit])
        for batch in slices(batches, "text", 4 << 20):
            buf, starts, lens, hashes, before = tokens(batch)
            number, kind, first = kinds(hashes)
            cls, at, ending, own = class_of(buf, starts[first], lens[first], kind)
            known = np.where(at >= 0, head_table.value[1][at], -1) if len(head_table.value[1]) else at
            doc = np.repeat(np.arange(batch.num_rows), np.diff(before))
            n = batch.num_rows
            log = np.where(known >= 0, np.log10(np.maximum(known, 0) + 0.5), 0)
            emit = np.where(own, own_part[cls], np.where(known >= 0, ending_part[ending], 0))
            cls, known, ending, log, emit = cls[number], known[number], ending[number], log[number], emit[number]
            seen = np.bincount(doc[known >= 0], minlength=n) + (ends > 0)
            counts = np.bincount(doc, weights=log, minlength=n)
            base_part = counts + np.log10(ends + 0.5)
            part = counts + np.bincount(doc, weights=emit, minlength=n) + end_part
            # words that aren't head words: their counts and classes come from the vocabulary
            miss = np.flatnonzero(known < 0)
            # by document and hash, so rows that repeat number their words alike
            turn = np.zeros(len(kind), np.int64)
            turn[np.argsort(kind)] = np.arange(len(kind))
            order = miss[np.argsort(doc[miss] * len(kind) + turn[number[miss]], kind="stable")]
            new = np.ones(len(order), bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (number[order][1:] != number[order][:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(order)))
            group = np.cumsum(new) - 1
            first = order[first]
            rows = np.bincount(doc[first], minlength=n)
            lists = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
            # in place of the class of such a word stands -1 less its number in the document
            cls[order] = -1 - (group - lists[doc[order]])
            cls, of_doc = with_ends(cls, before, end)
            last = np.concatenate([[end], cls[:-1]])
            whole = (cls >= 0) & (last >= 0)
            part += np.bincount(of_doc[whole], weights=step[last[whole], cls[whole]], minlength=n)
            open_ = np.flatnonzero(~whole)
            cut = np.searchsorted(of_doc[open_], np.arange(n + 1)).tolist()
            steps = np.stack([last[open_], cls[open_]], 1).astype(np.int32)
            marks = np.stack([ending[first], many], 1).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(lists), pa.array(hashes[first].view(np.int64)))
            times = pa.ListArray.from_arrays(pa.array(lists), pa.array(many, pa.int32()))
            missing = np.bincount(doc[miss], minlength=n)
            out = [*(batch.column(c) for c in ("did", "none", "h", "held_out")), *(pa.array(x) for x in (np.diff(before) + 1, seen.astype(np.int64), base_part, part, missing.astype(np.int64))), words, times]
            out += [pa.array([steps[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()), pa.array([marks[x:y].tobytes() for x, y in zip(lists.tolist(), lists[1:].tolist())], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["did", "none", "h", "held_out", "n_tokens", "seen", "base_part", "part", "missing", "words", "times", "steps", "marks"])

    schema = "did long, none boolean, h long, held_out boolean, n_tokens long, seen long, base_part double, part double, missing long, words array<long>, times array<int>, steps binary, marks binary"
    scored = saved(base.mapInArrow(score, schema), "scores")
    rest = scored.where("missing > 0").select("did", "h", F.posexplode(F.arrays_zip("words", "times")).alias("i", "w")).select("did", "h", "i", F.col("w.words").alias("hash"), F.col("w.times").alias("times"))
    # a set, not a list: rows that repeat doc_id and text say the same
    place = F.when(F.col("cls") >= 0, F.shiftleft(F.col("i").cast("long"), 32) + F.col("cls"))
    counted = rest.join(known_words.where("not head").select("hash", "n", "cls"), "hash", "left").groupBy("did", "h").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"), F.sum("times").alias("all"), F.collect_set(place).alias("places")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part with the steps and emissions of joined words."""
        step, own_part, ending_part = model.value
        of = classed.value[0][frequent:]
        for batch in slices(batches, "steps", 4 << 20):
            more = np.zeros(batch.num_rows)
            for k, (steps, marks, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("steps", "marks", "places")))):
                if steps:
                    steps, (ending, many) = np.frombuffer(steps, np.int32).reshape(-1, 2), np.frombuffer(marks, np.int32).reshape(-1, 2).T
                    cls, emit = of[ending], ending_part[ending]
                    if places:
                        at, own = np.divmod(np.array(places, np.int64), 1 << 32)
                        cls[at], emit[at] = own, own_part[own]
                    a, b = np.where(steps < 0, cls[np.maximum(-1 - steps, 0)], steps).T
                    more[k] = step[a, b].sum() + (many * emit).sum()
            part = batch.column("part").to_numpy() + more
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in left), pa.array(part)], [*left, "part"])

    left = ["did", "none", "h", "held_out", "n_tokens", "seen", "base_part", "missing", "log", "found", "all"]
    # rows that repeat doc_id and text are together in `counted`: each takes its share
    share = F.coalesce(F.col("missing") / F.col("all"), F.lit(0.0))
    log = F.coalesce("log", F.lit(0.0)) * share
    joined = scored.drop("words", "times").join(counted, ["did", "h"], "left").select(*left, "part", "steps", "marks", "places")
    out = joined.mapInArrow(finish, "did long, none boolean, h long, held_out boolean, n_tokens long, seen long, base_part double, missing long, log double, found long, all long, part double").withColumn("score", F.col("part") + log)
    return out.select(
        doc_id(), "held_out", "n_tokens", (F.col("seen") + F.round(F.coalesce("found", F.lit(0)) * share).cast("long")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_part") + log - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
