"""Quality scores from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Only the histogram of vote patterns over all
documents is gathered (at most 3 ** labellers rows); expectation-maximisation on it estimates how each labeller votes on
good and on bad documents, without any gold label, and gives each pattern its posterior. The posteriors of a bounded
sample, TRAIN_ROWS documents or TRAIN_BYTES of text chosen by a hash of doc_id and text, train a hashed linear scorer, which scores all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import IS_SPACE, ODD, doc_id, flat, keyed, mixed, sampled, slices, span_hashes, word_spans

DIMENSIONS = 1 << 16
#: Documents that train the scorer, and bytes of their texts: about these at most, drawn by a hash.
TRAIN_ROWS, TRAIN_BYTES = 8000, 32 << 20
ROUNDS = 6
KEEP = 0.5
#: What is known of the labellers beforehand: none calls more good documents bad than this share.
FALSE_ALARMS = 0.02

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
PLAIN = np.zeros(256, bool)
PLAIN[list(b".,;:'\"()-?")] = True

#: Name, and where a document counts as bad and as good by the measure of that name: (low, high), None for no bound.
LABELLERS = {
    "symbols": ((0.04, None), (None, 0.015)),
    "capitals": ((0.4, None), (None, 0.15)),
    "repeats": ((0.15, None), (None, 0.03)),
    "runs": ((0.1, None), (None, 0.01)),
    "tails": ((0.15, None), (None, 0.03)),
    "marks": ((0.15, None), (None, 0.05)),
    "distinct": ((None, 0.3), (0.4, None)),
    "length": ((None, 2.2), (2.8, 9.0)),
    "stops": ((0.5, None), (0.01, 0.3)),
    "lines": ((0.4, None), (None, 0.15)),
}
#: Words that a document needs for a vote by its name; others vote on any that has a word.
NEEDS = {"capitals": 5, "distinct": 60, "stops": 30, "lines": 20, "repeats": 10, "runs": 10}


def measures(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The measures of each document, its number of words, and of each word: its document, hash and shape."""
    buf, off = flat(batch.column("text"))
    starts, lens, before = word_spans(buf, off)
    n, rows = np.diff(before), len(before) - 1
    doc = np.repeat(np.arange(rows), n)
    hashes = span_hashes(buf, starts, lens)

    def bytes_in(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[buf[:-8]], dtype=np.int64)])
        return np.diff(total[off])

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=flags, minlength=rows) / np.maximum(n, 1)

    last, other = buf[starts + lens - 1], buf[starts + np.maximum(lens, 2) - 2]
    double = (lens > 1) & PUNCTUATION[last] & (last == other)
    alone = PUNCTUATION[buf[starts]] & (PUNCTUATION[last] & (lens <= 2))
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    pair = np.lexsort((hashes, doc))
    new = np.ones(len(pair), bool)
    new[1:] = (doc[pair][1:] != doc[pair][:-1]) | (hashes[pair][1:] != hashes[pair][:-1])
    distinct = np.bincount(doc[pair[new]], minlength=rows)
    letters = bytes_in(LETTER)
    visible = bytes_in(~IS_SPACE)
    # lines that occur before in their document, of all lines of ten bytes or more
    breaks = np.flatnonzero(buf[:-8] == 10)
    edge = np.unique(np.concatenate([off[:-1], breaks + 1, off[-1:]]))
    begin, size = edge[:-1], np.diff(edge)
    begin, size = begin[size >= 10], size[size >= 10]
    of = np.searchsorted(off, begin, "right") - 1
    line = span_hashes(buf, begin, size - (buf[begin + size - 1] == 10))
    order = np.lexsort((line, of))
    same = np.zeros(len(order), bool)
    same[1:] = (line[order][1:] == line[order][:-1]) & (of[order][1:] == of[order][:-1])
    found = {
        "symbols": bytes_in(PUNCTUATION & ~PLAIN) / np.maximum(visible, 1),
        "capitals": bytes_in(UPPER) / np.maximum(letters, 1),
        "repeats": share(again),
        "runs": share(again & np.r_[False, again[:-1]]) if len(again) else share(again),
        "tails": share(double),
        "marks": share(alone),
        "distinct": distinct / np.maximum(n, 1) ** 0.9,
        "length": visible / np.maximum(n, 1),
        "stops": share((last == 46) | (last == 33) | (last == 63)),
        "lines": np.bincount(of[order], weights=same, minlength=rows) / np.maximum(np.bincount(of, minlength=rows), 1),
    }
    shape = (UPPER[buf[starts]] + 2 * UPPER[last] + 4 * again + 8 * alone + 16 * double).astype(np.int64) + 32 * np.minimum(lens // 3, 7) + 256 * np.where(PUNCTUATION[last], last, 0).astype(np.int64)
    return found, n, doc, hashes, shape


def votes(found: dict[str, np.ndarray], n: np.ndarray) -> np.ndarray:
    """The votes of all labellers as one number in base 3: 0 nothing, 1 bad, 2 good."""

    def within(x: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
        return (x >= low if low is not None else True) & (x <= high if high is not None else True)

    out = np.zeros(len(n), np.int64)
    for name, (bad, good) in LABELLERS.items():
        vote = np.where(within(found[name], *bad), 1, np.where(within(found[name], *good), 2, 0))
        out = out * 3 + np.where(n >= NEEDS.get(name, 1), vote, 0)
    return out


def posteriors(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each pattern, the probability of a good document; of each labeller, P(it votes bad | it votes, and the document
    is bad or good); P(good). A labeller that abstains says nothing."""
    names = len(LABELLERS)
    digits = np.stack([patterns // 3 ** (names - 1 - j) % 3 for j in range(names)], 1)
    bad, good = (digits == 1).astype(float), (digits == 2).astype(float)
    table, prior, post = np.tile([0.5, 0.05], (names, 1)), 0.8, np.zeros(len(patterns))
    for _ in range(steps):
        # log odds of bad against good
        odds = bad @ np.log(table[:, 0] / table[:, 1]) + good @ np.log((1 - table[:, 0]) / (1 - table[:, 1])) + np.log((1 - prior) / prior)
        new = 1 / (1 + np.exp(np.clip(odds, -500, 500)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
        for c, p in ((0, counts * (1 - post)), (1, counts * post)):
            table[:, c] = (p @ bad + (0.5, 0.05)[c] * 10) / (p @ (bad + good) + 10)
        table[:, 1] = np.minimum(table[:, 1], FALSE_ALARMS)
        prior = float(np.clip((counts @ post + 8) / (counts.sum() + 10), 0.01, 0.99))
    return post, table, prior


def features(doc: np.ndarray, hashes: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashed features of each word: itself, and its shape."""
    word = (mixed(hashes ^ ODD) % np.uint64(DIMENSIONS)).astype(np.int64)
    look = (mixed(shape.astype(np.uint64) + ODD) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.concatenate([doc, doc]), np.concatenate([word, look])


def trained(rows: list[tuple[float, np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic weights by AdaGrad on (posterior, features, shares) rows."""
    w, b = np.zeros(DIMENSIONS), 0.0
    seen, seen_b = np.full(DIMENSIONS, 1e-6), 1e-6
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)).tolist():
            y, at, x = rows[i]
            g = 1 / (1 + np.exp(-np.clip(b + w[at] @ x, -50, 50))) - y
            step = g * x + 1e-7 * w[at]
            seen[at] += step * step
            seen_b += g * g
            w[at] -= 0.7 * step / np.sqrt(seen[at])
            b -= 0.3 * g / np.sqrt(seen_b)
    return w, b


def quality(docs: DataFrame, train_rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, n_words, posterior (of the labellers), score (of the linear scorer, 0 to 1), keep (score >= keep).

    A null or empty text, or one of white space alone, has no words: no labeller votes, its score is 0 and it isn't kept.
    Rows that repeat are scored alike. Other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = keyed(docs)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found, n, *_ = measures(batch)
            pattern, many = np.unique(votes(found, n)[n > 0], return_counts=True)
            size = np.zeros(len(pattern), np.int64)
            size[:1] = batch.column("text").nbytes
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(many), pa.array(size)], ["pattern", "n", "bytes"])

    seen = base.select("text").mapInArrow(voted, "pattern long, n long, bytes long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).toPandas()
    patterns, counts = seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(np.float64)
    post, _, prior = posteriors(patterns, counts)
    table = dict(zip(patterns.tolist(), post.tolist()))
    share = min(1.0, train_rows / max(1.0, counts.sum()), TRAIN_BYTES / max(1.0, float(seen["bytes"].sum())))
    held = spark.sparkContext.broadcast(table)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found, n, doc, hashes, shape = measures(batch)
            code = votes(found, n)
            of, at = features(doc, hashes, shape)
            pair, many = np.unique(of * DIMENSIONS + at, return_counts=True)
            of, at = pair // DIMENSIONS, pair % DIMENSIONS
            off = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
            y = pa.array([held.value.get(c, 0.5) for c in code.tolist()], pa.float64())
            lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (at.astype(np.int32), (many / n[of]).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("turn"), y, *lists], ["turn", "y", "at", "x"]).filter(pa.array(n > 0))

    some = base.where(sampled(share, "did", "h")).select("text", F.xxhash64(F.lit(3), "did", "h").alias("turn"))
    rows = some.mapInArrow(drawn, "turn long, y double, at array<int>, x array<float>").toPandas().sort_values("turn", kind="stable")
    w, b = trained([(y, np.asarray(at, np.int64), np.asarray(x, np.float64)) for y, at, x in zip(rows["y"], rows["at"], rows["x"])])
    model = spark.sparkContext.broadcast((w.astype(np.float32), b))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in slices(batches, "text", 4 << 20):
            found, n, doc, hashes, shape = measures(batch)
            of, at = features(doc, hashes, shape)
            sums = np.bincount(of, weights=w[at], minlength=batch.num_rows) / np.maximum(n, 1)
            score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(b + sums, -50, 50))), 0.0)
            y = [held.value.get(c, prior) if k else 0.0 for c, k in zip(votes(found, n).tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(y, pa.float64()), pa.array(score)], ["doc_id", "n_words", "posterior", "score"])

    out = base.select(doc_id(), "text").mapInArrow(scored, "doc_id long, n_words long, posterior double, score double")
    return out.select("doc_id", "n_words", "posterior", "score", (F.col("score") >= keep).alias("keep"))
