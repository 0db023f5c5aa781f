"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two strings sums over common subsequences of LENGTH characters, each weighted by DECAY to the power of the
characters it spans, so an insult with gaps or inserted characters still resembles the plain one. Landmarks are strings
that tell labelled toxic texts from others. A sentence's kernel with a landmark is the best of its words' (letters alone,
with a mark at the start; single letters in a row are one word too), mapped through the inverse root of the landmarks' own
kernel matrix. The machine is trained on sentences: those most like a landmark of texts labelled toxic, against those of
others. What its decisions say of a text's worst sentence, of all its sentences and distinct words, and how dense that is,
goes into a logistic curve fitted to the training texts, weighted to the labels' frequencies: scores from 0 to 1.

A bounded sample of the labelled rows is learned from: at most ROWS of each label, chosen by a hash, while they have at most BYTES in all. Whole
texts are learned from and scored, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import ODD, in_fold, mixed, sampled, saved, slices

LENGTH, DECAY = 4, 0.6
LANDMARKS, GRAMS = 64, (4, 5, 6, 7)
ROWS, BYTES = 1500, 4 << 20
LIMIT = 0.3
#: Longest word looked at as one; longer ones are seen through overlapping windows.
SPAN = 24
START = "^"
#: A kernel below this part of a landmark's own counts as none.
FLOOR = 0.15
#: Likeness up to this much, of which long texts have plenty, counts as none.
FAINT = 0.4
KEPT_WORDS = 300_000


NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(word: str) -> str:
    """A word's letters."""
    return word if word.isalpha() else NO_LETTERS.sub("", word)


def sentences(text: str) -> list[list[str]]:
    """Lower-cased words by sentence; runs of three or more single letters add a word."""
    out, now, run = [], [], []
    for word in text.lower().split():
        now.append(word)
        if len(word) < 3 and len(p := plain(word)) == 1:
            run.append(p)
        elif run:
            if len(run) > 2:
                now.append("".join(run))
            run = []
        if word[-1] in ".!?" and not run:
            out.append(now)
            now = []
    if len(run) > 2:
        now.append("".join(run))
    return [*out, now] if now else out


class Kernel:
    """Kernels of words with the landmarks, as parts of the landmarks' own."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.ids = np.zeros(0x110000, np.uint16)  # at most LANDMARKS * max(GRAMS) characters
        chars = sorted(set("".join(landmarks)))
        self.ids[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.marks = [self.ids[[ord(c) for c in x]].astype(np.int64) for x in landmarks]
        self.chars = len(chars) + 1
        # sets of characters as bits; a row shares at least so many of a landmark's if a subsequence of LENGTH is common
        self.bit = np.zeros((self.chars, self.chars // 64 + 1), np.uint64)
        for i in range(1, self.chars):
            self.bit[i, i // 64] = np.uint64(1 << i % 64)
        self.sets = [np.bitwise_or.reduce(self.bit[m], axis=0) for m in self.marks]
        self.least = [int(np.searchsorted(np.cumsum(np.sort(np.unique(m, return_counts=True)[1])[::-1]), LENGTH)) + 1 for m in self.marks]
        self.own = np.array([self.raw(self.rows([x])[0], m)[0] for x, m in zip(landmarks, self.marks)])
        self.seen: set[str] = set()
        self.like: dict[str, tuple] = {}

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of words as rows of character ids, 0 for any that no landmark has, and the word of each."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(w) for w in words], np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        few = self.ids[flat]
        windows = np.maximum(1, -(-(lens - SPAN // 2) // (SPAN // 2)))
        word = np.repeat(np.arange(len(words)), windows)
        start = (np.arange(len(word)) - np.repeat(np.cumsum(windows) - windows, windows)) * (SPAN // 2)
        at = start[:, None] + np.arange(SPAN)
        ok = at < lens[word][:, None]
        out = np.where(ok, few[np.minimum(at + off[word][:, None], max(len(few) - 1, 0))] if len(few) else 0, 0)
        return out.astype(np.uint16), word

    def common(self, rows: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each row and a landmark, by bits."""
        table = np.zeros(self.chars, np.uint16)
        for k, c in enumerate(mark.tolist()):
            table[c] |= 1 << k
        table[0] = 0
        left = np.full(len(rows), 0xFFFF, np.uint16)
        for j in range(rows.shape[1]):
            hit = left & table[rows[:, j]]
            left = (left + hit) | (left - hit)
        return len(mark) - np.bitwise_count(left & np.uint16((1 << len(mark)) - 1)).astype(np.int64)

    @staticmethod
    def raw(rows: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The kernel of each row of ids with a landmark."""
        n, m = len(rows), len(mark)
        before = [np.ones((m + 1, n)), *(np.zeros((m + 1, n)) for _ in range(LENGTH - 1))]
        total = np.zeros(n)
        for j in range(rows.shape[1]):
            match = [(rows[:, j] == c) & (rows[:, j] > 0) for c in mark.tolist()]
            for k in range(m):
                total += np.where(match[k], DECAY**2 * before[LENGTH - 1][k], 0)
            new = [before[0]]
            for i in range(1, LENGTH):
                run, now = np.zeros(n), before[i] * DECAY
                for k in range(m):
                    run = run * DECAY + np.where(match[k], DECAY**2 * before[i - 1][k], 0)
                    now[k + 1] += run
                new.append(now)
            before = new
        return total

    def look_at(self, words: set[str]) -> None:
        """Adds those of the words that are like a landmark to self.like: (landmark, kernel) pairs."""
        if len(self.seen) > KEPT_WORDS:
            self.seen, self.like = set(), {}
        todo = words - self.seen
        self.seen |= todo
        bare: dict[str, list[str]] = {}
        for w in todo:
            if len(p := plain(w)) >= LENGTH - 1:
                bare.setdefault(p, []).append(w)
        if not bare:
            return
        names = list(bare)
        rows, word = self.rows([START + b for b in names])
        seen = np.zeros((len(rows), self.bit.shape[1]), np.uint64)
        for j in range(rows.shape[1]):
            seen |= self.bit[rows[:, j]]
        for k, mark in enumerate(self.marks):
            near = np.flatnonzero(np.bitwise_count(seen & self.sets[k]).sum(1) >= self.least[k])
            near = near[self.common(rows[near], mark) >= LENGTH]
            value = np.minimum(self.raw(rows[near], mark) / self.own[k], 1.0)
            best: dict[int, float] = {}
            for w, v in zip(word[near[value >= FLOOR]].tolist(), value[value >= FLOOR].tolist()):
                best[w] = max(v, best.get(w, 0.0))
            for w, v in best.items():
                for name in bare[names[w]]:
                    self.like[name] = (*self.like.get(name, ()), (k, v))

    def features(self, texts: list[str]) -> list[tuple[list[dict[int, float]], list[dict[int, float]], int]]:
        """Of each text: the best kernels with landmarks in each sentence and in each distinct word that has any; its number of words."""
        split = [t.lower().split() for t in texts]
        sets = [set(words) for words in split]
        # runs of single letters are rare, and only they add words
        spelt = {i: sentences(texts[i]) for i, s in enumerate(sets) if sum(len(plain(w)) == 1 for w in s if len(w) < 3) > 1}
        self.look_at(set().union(*sets, *(words for rows in spelt.values() for words in rows)))
        out = []
        for i, (text, own) in enumerate(zip(texts, sets)):
            found = own & self.like.keys() if i not in spelt else {w for words in spelt[i] for w in words} & self.like.keys()
            rows = []
            for words in (spelt.get(i) or sentences(text)) if found else ():
                row: dict[int, float] = {}
                for w in words:
                    if w in found:
                        for k, v in self.like[w]:
                            if v > row.get(k, 0.0):
                                row[k] = v
                if row:
                    rows.append(row)
            distinct = {plain(w): self.like[w] for w in sorted(found)}
            out.append((rows, [dict(x) for x in distinct.values()], len(split[i])))
        return out


#: Times that a string counts in one text at most.
OFTEN = 4


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Hashes of the strings of GRAMS characters in a text's words, how often each is there (once a word, up to OFTEN),
    where one begins and its length, and the words in a row."""
    found = Counter(plain(w) for words in sentences(text) for w in words)
    flat = "".join(START + w for w in found)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(found)), [len(w) + 1 for w in found])
    often = np.minimum(np.array(list(found.values()), np.int64), OFTEN)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
    now = np.zeros(len(codes), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        now = now[: max(0, len(codes) - k + 1)] * ODD + codes[k - 1 :]
        if k in GRAMS:
            at = np.flatnonzero(word[: len(now)] == word[k - 1 :])
            hashes.append(mixed(now[at] ^ np.uint64(k)))
            places.append(np.stack([at, np.full(len(at), k)], 1))
    h, place = np.concatenate(hashes), np.concatenate(places)
    _, once = np.unique(mixed(h ^ mixed(word[place[:, 0]].astype(np.uint64))), return_index=True)
    h, place = h[once], place[once]
    own, first, nth = np.unique(h, return_index=True, return_inverse=True)
    return own, np.minimum(np.bincount(nth, weights=often[word[place[:, 0]]], minlength=len(own)), OFTEN), place[first], flat


def chosen(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> list[str]:
    """Strings that are often in many toxic texts and seldom in others, and together in as many toxic ones as can be."""
    if not toxic:
        return []
    least = max(3, len(toxic) // 100)
    # a small table first: only strings that may be in enough texts are held
    table, mask = np.zeros(1 << 22, np.int32), np.uint64((1 << 22) - 1)
    for t in toxic:
        table[np.unique(grams_of(t)[0] & mask)] += 1
    rows = []
    for i, t in enumerate(toxic):
        h, n, *_ = grams_of(t)
        ok = table[h & mask] >= least
        rows.append((h[ok], n[ok], np.full(int(ok.sum()), i)))
    h, n, text = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(h, kind="stable")
    h, n, text = h[order], n[order], text[order]
    own, first, texts = np.unique(h, return_index=True, return_counts=True)
    total, other = np.add.reduceat(n, first) if len(own) else np.zeros(0), np.zeros(len(own))
    for t in clean:
        g, m, *_ = grams_of(t)
        at = np.minimum(np.searchsorted(own, g), max(0, len(own) - 1)) if len(own) else np.zeros(0, np.int64)
        hit = own[at] == g[: len(at)]
        other[at[hit]] += m[: len(at)][hit]
    size = sum(len(t) for t in toxic) / max(1, sum(len(t) for t in clean))
    good = np.flatnonzero((texts >= least) & (total / (other + 0.5) / size >= 6))
    names: dict[int, str] = {}
    for t in toxic:
        if len(names) == len(good):
            break
        g, _, place, flat = grams_of(t)
        for x, (at, k) in zip(g.tolist(), place.tolist()) if np.isin(g, own[good]).any() else ():
            if x in names or not len(good):
                continue
            j = int(np.searchsorted(own[good], np.uint64(x)))
            if j < len(good) and int(own[good[j]]) == x:
                names[x] = flat[at : at + k]
    held = {names[int(own[j])]: (text[first[j] : first[j] + texts[j]], n[first[j] : first[j] + texts[j]], other[j]) for j in good.tolist()}
    by: dict[bytes, str] = {}
    # the longest of those that mark the same texts
    for g in sorted(held, key=lambda g: (-len(g), g)):
        by.setdefault(held[g][0].tobytes(), g)
    open_ = {g: (held[g][0], np.minimum(held[g][1], 2) / 2, held[g][2]) for g in by.values()}
    left, out = np.ones(len(toxic)), []
    scale = len(toxic) / max(1, len(clean)) / 2
    while open_ and len(out) < most:
        gains = {g: (left[d] * w).sum() - scale * o for g, (d, w, o) in open_.items()}
        best = max(sorted(gains), key=lambda g: (round(gains[g], 6), len(g)))
        if gains[best] < max(1.0, len(toxic) / 400):
            break
        out.append(best)
        d, w, _ = open_[best]
        left[d] *= 1 - 0.6 * w
        open_ = {g: x for g, x in open_.items() if g not in best and best not in g}
    return out


def machine(x: np.ndarray, y: np.ndarray, scale: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton's method. y: -1 or 1; scale: weight of the -1 rows.

    What is seen on both sides gets a decision between, so decisions also tell how sure a likeness is.
    """
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    weight = np.where(y > 0, 1.0, scale)
    ridge = np.diag([*[1.0] * x.shape[1], 1e-6])
    for _ in range(steps):
        bad = y * (x1 @ w) < 1
        a = x1[bad] * weight[bad, None]
        new = np.linalg.solve(ridge + a.T @ x1[bad], a.T @ y[bad])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def curve(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights of a logistic curve, the shift last, where `share` of all texts are toxic. y: -1 or 1."""
    x = np.c_[x, np.ones(len(x))]
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, share / max(1, n1), (1 - share) / max(1, n0)) * len(y)
    ridge = np.diag([*[0.05] * (x.shape[1] - 1), 1e-4])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (p - goal)) + ridge @ w)
        w = w - step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """Landmarks and weights; scores whole texts."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray, last: np.ndarray) -> None:
        self.kernel, self.weights, self.last = kernel, weights, last

    def likeness(self, row: dict[int, float]) -> float:
        """The machine's decision beyond that on a sentence without any likeness, as far as it exceeds FAINT."""
        return max(0.0, self.raw(row) - FAINT)

    def raw(self, row: dict[int, float]) -> float:
        return sum(self.weights[k] * v for k, v in row.items())

    def summary(self, found: tuple) -> list[float]:
        rows, words, n = found
        s, w = [self.likeness(r) for r in rows], [self.likeness(r) for r in words]
        m = max(s, default=0.0)
        return [m, max(0.0, m - 0.8), max(0.0, m - 1.2), np.log1p(sum(s)), np.log1p(sum(w)), sum(w) / (1 + n / 100), np.log1p(n) / 4]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.summary(f) for f in self.kernel.features(texts)]) if self.kernel and texts else np.zeros((len(texts), len(self.last) - 1))
        return 1 / (1 + np.exp(-np.clip(x @ self.last[:-1] + self.last[-1], -35, 35)))


def trained(toxic: list[str], clean: list[str], share: float) -> Scorer:
    """share: that of toxic rows among all labelled ones."""
    marks = chosen(toxic, clean)
    if not marks:
        return Scorer(None, np.zeros(0), np.array([np.log((share + 1e-4) / (1 - share + 1e-4))]))
    kernel = Kernel(marks)
    m = len(marks)
    gram = np.zeros((m, m))
    for i, mark in enumerate(marks):
        rows, _ = kernel.rows([mark])
        gram[i] = [kernel.raw(rows, kernel.marks[j])[0] for j in range(m)]
    # kernels are taken as parts of a landmark's own, which is its scale here
    own = np.sqrt(np.diag(gram))
    value, vector = np.linalg.eigh(gram / own[:, None] / own[None, :])
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    texts = kernel.features([*toxic, *clean])
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    out = Scorer(kernel, np.ones(m), np.zeros(1))
    scale = (1 - share) / max(share, 1e-9) * len(toxic) / max(1, len(clean))
    for _ in range(3):  # by the weights so far, the sentences that stand for their text
        x, sign = [], []
        for (rows, _, _), label in zip(texts, y.tolist()):
            for row in sorted(rows, key=out.raw, reverse=True)[: 3 if label > 0 else 8]:
                x.append(np.zeros(m))
                x[-1][list(row)] = list(row.values())
                sign.append(label)
        if len(set(sign)) < 2:
            break
        w, _ = machine(np.stack(x) @ root, np.array(sign), scale)
        out.weights = root @ w
    out.last = curve(np.array([out.summary(f) for f in texts]), y, share)
    kernel.seen, kernel.like = set(), {}
    return out


def learned(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, rows: int = ROWS, most: int = BYTES) -> Scorer:
    """From the labelled rows of docs whose fold isn't held out: of each label, `rows` at most and whole texts of `most` bytes, but one at least."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(held_out, folds)).select(F.col("doc_id").cast("long").alias("did"), F.col("toxic").cast("int").alias("toxic")).distinct()
    many = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = [min(1.0, (rows + 50) / max(1, many.get(k, 0))) for k in (0, 1)]
    some = own.where(F.when(F.col("toxic") == 1, sampled(share[1], "did")).otherwise(sampled(share[0], "did")))  # about 2 * rows in all
    text = docs.select(F.col("doc_id").cast("long").alias("did"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    found = saved(text.join(F.broadcast(some), "did").withColumn("turn", F.xxhash64(F.lit(5), "did", "text")).distinct(), "labelled")
    # of rows in the order of their hashes, the first whose bytes fit: about 2 * rows numbers, then the texts
    order = Window.partitionBy("toxic").orderBy("turn", "did")
    turns = found.select("toxic", "turn", "did", F.octet_length("text").alias("bytes")).withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = turns.where((F.col("place") <= rows) & ((F.col("upto") <= most) | (F.col("place") == 1))).select("toxic", "turn", "did").distinct()
    texts: dict[int, list[str]] = {0: [], 1: []}
    for r in found.join(F.broadcast(taken), ["toxic", "turn", "did"]).select("toxic", "did", "text").orderBy("did", "toxic", "text").collect():
        texts[r["toxic"]].append(r["text"])
    return trained(texts[1], texts[0], many.get(1, 0) / max(1, sum(many.values())))


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= limit).

    Labels are learned only from rows whose crc32(doc_id) mod 4 is not 2, and scores come from the text alone. A null
    text is empty and gets the score of a text without any likeness to a landmark. Without toxic labels all scores are
    near 0. Null labels and null doc_ids teach nothing; rows that repeat are scored alike. An empty table gives no rows.
    Other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(sent.value.scores(batch.column("text").to_pylist()))], ["doc_id", "held_out", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(2, 4).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(score, "doc_id long, held_out boolean, score double").select("doc_id", "held_out", "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of docs, all columns, whose score is below the limit."""
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))
    text = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            ok = sent.value.scores([t or "" for t in batch.column(text).to_pylist()]) < limit
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(clean, docs.schema)
