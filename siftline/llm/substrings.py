"""Substring dedup by super-k-mer partitioning over words.

A window is `window` consecutive words. Its minimiser is the least hash among its runs of `gram` words; consecutive
windows of a document that share one travel as one packed string to the bucket of that hash. Equal windows have equal
minimisers, so a bucket sees all copies of its windows: sorting their hashes brings copies together, and their words are
compared before anything is removed.

A block of input settles its own repeats first: a window that a smaller document of the block has too is known to go, and
only the smallest document's travels. So a passage that very many documents share reaches its bucket once a block, not once
a document. Map tasks pack the strings for one bucket into one compressed block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import FIRST, doc_id, eights, flat, gram_hashes, keyed, mixed, saved, settled, shuffle_partitions, slices, span_hashes, text_bytes, texts_of, word_spans

WINDOW, GRAM = 13, 3
#: Windows in one packed string at most.
LONGEST_RUN = 256
#: Bytes of text for each bucket.
BUCKET_BYTES = 4 << 20


def runs_of(words: np.ndarray, before: np.ndarray, window: int, gram: int, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows that share one, without those that begin at gone.

    words: their hashes; before: the number of words before each document.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, width, have = mixed(gram_hashes(words, gram)), window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    of = np.repeat(np.arange(len(before) - 1), np.diff(before))
    valid = of[:n] == of[window - 1 :]
    if gone is not None:
        valid[gone] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (of[1:n] != of[: n - 1]) | (least[1:] != least[:-1])
    at = np.flatnonzero(valid)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))[at]
    first = at[(at - start) % LONGEST_RUN == 0]
    ends = np.append(np.searchsorted(at, first), len(at))
    return first, np.diff(ends), least[first]


def same_words(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows that begin at words a and b have the same words."""
    at, out = eights(buf), np.ones(len(a), bool)
    for j in range(window):
        x, y = a + j, b + j
        out &= lens[x] == lens[y]
        todo, pos = np.flatnonzero(out), 0
        while len(todo):
            keep = FIRST[np.minimum(lens[x[todo]] - pos, 8)]
            out[todo[(at[starts[x[todo]] + pos] ^ at[starts[y[todo]] + pos]) & keep != 0]] = False
            pos += 8
            todo = todo[out[todo] & (lens[x[todo]] > pos)]
    return out


def ranks(did: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The place of each id among all; null ones, which none marks, are equal and last."""
    return np.unique(np.rec.fromarrays([none, np.where(none, 0, did)]), return_inverse=True)[1]


def ranges(string: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive words of a string begin and end (its last)."""
    new = np.ones(len(string), bool)
    new[1:] = (np.diff(string) != 0) | (np.diff(word) != 1)
    heads = np.flatnonzero(new)
    return heads, np.append(heads[1:], len(string)) - 1 if len(heads) else heads


def repeats(buf: np.ndarray, off: np.ndarray, did: np.ndarray, window: int, spans: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of strings and their documents: which windows also start in a smaller document, as string and offset in words.

    spans: the words' starts, lengths and number before each string, if they are known.
    """
    starts, lens, before = word_spans(buf, off) if spans is None else spans
    n = len(starts) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(off) - 1), np.diff(before))
    at = np.flatnonzero(of[:n] == of[window - 1 :])
    hashes = gram_hashes(span_hashes(buf, starts, lens), window)[at]
    order = np.argsort(hashes)
    hashes, at = hashes[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    owner = did[of[at]]
    out = owner > np.minimum.reduceat(owner, heads)[group]
    several = out | np.append(np.diff(heads) > 1, len(at) - heads[-1] > 1)[group] if len(at) else out
    check = np.flatnonzero(several)
    if len(check):
        ok = same_words(buf, starts, lens, at[check], at[heads[group[check]]], window)
        for g in np.unique(group[check[~ok]]).tolist():  # different windows with one hash: settled word by word
            mine = np.flatnonzero(group == g)
            words = [tuple(bytes(buf[starts[w] : starts[w] + lens[w]]) for w in range(at[i], at[i] + window)) for i in mine.tolist()]
            least: dict[tuple, int] = {}
            for k, d in zip(words, owner[mine].tolist()):
                least[k] = min(d, least.get(k, d))
            out[mine] = [d > least[k] for k, d in zip(words, owner[mine].tolist())]
    at = np.sort(at[out])
    return of[at], at - before[of[at]]


def covered(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """did, h, spans: the word ranges that repeated windows cover, of rows that have any."""
    spark = docs.sparkSession
    buckets = max(shuffle_partitions(spark), text_bytes(docs) // BUCKET_BYTES, 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", 5 << 20):
            buf, off = flat(batch.column("text"))
            starts, lens, before = word_spans(buf, off)
            ids, none, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "none", "h"))
            string, word = repeats(buf, off, ranks(ids, none), window, (starts, lens, before))
            first, many, least = runs_of(span_hashes(buf, starts, lens), before, window, gram, before[string] + word)
            if not len(first):
                continue
            heads, ends = ranges(string, word)
            rows = string[heads]
            known = np.stack([ids[rows], h[rows], word[heads], word[ends] + window]).astype("<i8")
            bucket = (mixed(least) % np.uint64(buckets)).astype(np.int64)
            # strings with one minimiser side by side, where they compress best
            order = np.lexsort((least, bucket))
            first, many, bucket = first[order], many[order], bucket[order]
            doc = np.searchsorted(before, first, "right") - 1
            begin, last = starts[first], first + many + window - 2
            size = starts[last] + lens[last] - begin
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            blocks = []
            # what is known to go travels with any block of this one
            lot = int(mixed(least[:1])[0] % np.uint64(len(cut)))
            for k, (a, b) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)])):
                text, _ = texts_of(buf, begin[a:b], size[a:b])
                own, nth = np.unique(doc[a:b], return_inverse=True)
                more = known if k == lot else known[:, :0]
                parts = [np.array([len(own), b - a, more.shape[1]], "<i8"), more, ids[own].astype("<i8"), h[own].astype("<i8"), none[own].astype("<i8"), nth.astype("<u4"), (first[a:b] - before[doc[a:b]]).astype("<u4"), size[a:b].astype("<u4"), text]
                blocks.append(pack.compress(b"".join(p.tobytes() for p in parts)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def receive(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        did, h, none, begin, size, text, known = [], [], [], [], [], [], []
        for block in table.column("block").to_pylist():
            raw = unpack.decompress(block)
            docs_, runs, more = np.frombuffer(raw, "<i8", 3).tolist()
            known.append(np.frombuffer(raw, "<i8", 4 * more, 24).reshape(4, -1))
            at = 24 + 32 * more
            ids, hs, null = np.frombuffer(raw, "<i8", 3 * docs_, at).reshape(3, -1)
            at += 24 * docs_
            nth, b, s = np.frombuffer(raw, "<u4", 3 * runs, at).reshape(3, -1)
            did.append(ids[nth])
            h.append(hs[nth])
            none.append(null[nth])
            begin.append(b)
            size.append(s)
            text.append(np.frombuffer(raw, np.uint8, -1, at + 12 * runs))
        did, h, none, begin, size = (np.concatenate(x) for x in (did, h, none, begin, size))
        off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        string, word = repeats(np.concatenate([*text, np.zeros(8, np.uint8)]), off, ranks(did, none > 0), window)
        heads, ends = ranges(string, word)
        rows = string[heads]
        own = np.stack([did[rows], h[rows], begin[rows].astype(np.int64) + word[heads], begin[rows].astype(np.int64) + word[ends] + window])
        return pa.table(dict(zip(("did", "h", "a", "b"), np.concatenate([own, *known], 1))))

    sent = docs.mapInArrow(send, "bucket long, block binary")
    found = sent.groupBy("bucket").applyInArrow(receive, "did long, h long, a long, b long")
    return found.groupBy("did", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and kept_text): without words that a window covers whose word
    sequence also starts in a document with a smaller doc_id, judged on the input.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a null or empty text has none. Rows with one doc_id don't remove from each
    other; a null doc_id counts as larger than all others. Other columns are left out; an empty table gives no rows.
    """
    base = keyed(docs)
    spans = saved(covered(base, window, gram), "spans")

    def without(text: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
        words = text.split()
        total = len(words)
        if spans:
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, [r["a"] for r in spans], 1)
            np.add.at(edge, [r["b"] for r in spans], -1)
            words = [w for w, stays in zip(words, (np.cumsum(edge[:-1]) == 0).tolist()) if stays]
        return total, total - len(words), b" ".join(words)

    def cut(texts: list[bytes], spans: list) -> list[pa.Array]:
        done = [without(*x) for x in zip(texts, spans)]
        out = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())]
        return [*out, pa.array([d[2].decode() for d in done], pa.string())] if with_text else out

    done = settled(base, spans, cut, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return done.select(doc_id(), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
