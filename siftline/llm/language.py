"""Language identification by interpolated Kneser-Ney character models.

Each language gets a model of `ORDER` characters from a bounded sample of its distinct whole texts: the ROWS with the
smallest hashes, or all if there are no more, while they have at most BYTES. Characters are all lower-cased letters of the
sample, a sign for other letters, and one for boundaries. Sorted arrays of 64-bit hashes of n-grams hold the counts. A text
gets the language of the lowest cross-entropy per character. A part of the sample isn't counted but calibrates: a temperature turns differences
of cross-entropy into a score, and a quantile of the true language's cross-entropy is the limit beyond which a prediction
is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import ODD, in_fold, mixed, saved, slices

ORDER = 5
#: Distinct texts of each language that are read for its model, and their bytes, at most; and of how many one calibrates.
ROWS, BYTES, CALIBRATE = 2000, 16 << 20, 10
#: Bits of a character.
BITS = 21
QUANTILE, MARGIN = 0.995, 1.15
UNKNOWN = "und"


def codes(texts: list[str | None], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, each run of others than letters as one 0, where each text begins, and its letters."""
    raw = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    flat = ids[np.frombuffer(b"".join(raw), np.uint32)]
    off = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
    keep = flat > 0
    letters = np.concatenate([[0], np.cumsum(keep)])
    letters = np.diff(letters[off])
    first = np.zeros(len(flat) + 1, bool)
    first[off] = True
    # a boundary stays after a letter of the same text
    after = np.zeros(len(flat), bool)
    after[1:] = keep[:-1] & ~first[1:-1]
    stays = keep | after
    where = np.concatenate([[0], np.cumsum(stays)])[off]
    return flat[stays], where, letters


def grams(chars: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Of each character, itself and those before it, nearest first; before a text's first stand boundaries."""
    out = np.zeros((order, len(chars)), np.uint32)
    place = np.arange(len(chars)) - np.repeat(off[:-1], np.diff(off))
    for j in range(order):
        out[j, j:] = np.where(place[j:] >= j, chars[: len(chars) - j], 0)
    return out


def hashed(rows: np.ndarray) -> list[np.ndarray]:
    """The hash of each n-gram (characters, last first) for n from 0 up; a context's hash is that of the n-gram without its last."""
    out = [np.zeros(rows.shape[1], np.uint64)]
    for k, chars in enumerate(rows):
        out.append(mixed(out[-1] * ODD + chars.astype(np.uint64) + np.uint64(k + 1)))
    return out


class Model:
    """One language: for each order, sorted hashes of n-grams with counts, and of contexts with totals and kinds."""

    def __init__(self, found: np.ndarray, counts: np.ndarray, alphabet: int) -> None:
        """found: distinct n-grams of the highest order, a column each, last character first."""
        self.orders, self.alphabet = [], alphabet
        counts = counts.astype(np.float64)
        for k in range(ORDER, 0, -1):
            gram, before = hashed(found)[k], hashed(found[1:])[k - 1]
            context, at = np.unique(before, return_inverse=True)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            less = ones / (ones + 2 * twos) if ones and twos else 0.5
            order = np.argsort(gram)
            self.orders.append((gram[order], counts[order], context, np.bincount(at, weights=counts), np.bincount(at).astype(np.float64), less))
            if k > 1:  # below the highest order, an n-gram counts once for each character seen before it
                _, first, n = np.unique(hashed(found[: k - 1])[k - 1], return_index=True, return_counts=True)
                found, counts = found[: k - 1, first], n.astype(np.float64)
        self.orders.reverse()

    def log(self, gram: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """log of P(last character | those before), from the hashes of n-grams of each order and of their contexts."""
        p = np.full(len(gram[0]), 1.0 / (self.alphabet + 1))
        for k, (found, counts, context, total, kinds, less) in enumerate(self.orders, 1):
            at = np.minimum(np.searchsorted(found, gram[k]), len(found) - 1)
            c = np.where(found[at] == gram[k], counts[at], 0)
            at = np.minimum(np.searchsorted(context, before[k - 1]), len(context) - 1)
            known = context[at] == before[k - 1]
            p = np.where(known, (np.maximum(c - less, 0) + less * kinds[at] * p) / total[at], p)
        return np.log(p)


def entropies(models: list[Model], chars: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Cross-entropy per character of each text in each language."""
    rows = grams(chars, off)
    number, wanted = pd.factorize(hashed(rows)[ORDER])
    first = np.zeros(len(wanted), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    gram, before = hashed(rows[:, first]), hashed(rows[1:, first])
    many, n = len(off) - 1, np.maximum(np.diff(off), 1)
    doc = np.repeat(np.arange(many), np.diff(off))
    return np.stack([-np.bincount(doc, weights=m.log(gram, before)[number], minlength=many) / n for m in models], 1)


def confidences(cross: np.ndarray, n: np.ndarray, heat: float) -> np.ndarray:
    """A distribution over languages of each text: its length counts by the square root, as characters hang together."""
    x = -cross * heat * np.sqrt(np.maximum(n, 1))[:, None]
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


class Identifier:
    """Models of all languages, the numbers of characters, the temperature and the limit."""

    def __init__(self, langs: list[str], ids: np.ndarray, models: list[Model]) -> None:
        self.langs, self.ids, self.models = langs, ids, models
        self.heat, self.limit = 1.0, np.inf

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars, off, letters = codes(texts, self.ids)
        return entropies(self.models, chars, off), np.diff(off), letters

    def calibrate(self, cross: np.ndarray, n: np.ndarray, lang: np.ndarray) -> None:
        if not len(lang):
            return
        own = np.arange(len(lang)), lang
        heats = 2.0 ** np.arange(-4, 6)
        loss = [-np.log(np.maximum(confidences(cross, n, h)[own], 1e-6)).mean() for h in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        self.limit = float(np.quantile(cross[own], QUANTILE) * MARGIN)


def sample(docs: DataFrame, rows: int = ROWS, most: int = BYTES) -> DataFrame:
    """lang, text, calibrates: of each lang the `rows` distinct texts with the smallest hashes, as far as `most` bytes go,
    but one at least. A lang of few texts only trains."""
    deal = F.xxhash64(F.lit(3), "text")
    distinct = saved(docs.select("lang", deal.alias("deal"), F.octet_length("text").alias("bytes")).distinct(), "texts")
    many = distinct.groupBy("lang").agg(F.count("*").alias("many"))
    # the window only sees about twice the rows that it leaves
    place = F.pmod(F.col("deal"), F.lit(1 << 40))
    some = distinct.join(F.broadcast(many), "lang").where(place < F.lit(float(1 << 40)) * (2 * rows + 100) / F.col("many"))
    own = Window.partitionBy("lang").orderBy(place, "deal")
    some = some.withColumn("turn", F.row_number().over(own)).withColumn("upto", F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = some.where((F.col("turn") <= rows) & ((F.col("upto") <= most) | (F.col("turn") == 1))).select("lang", "deal", (F.col("turn") % CALIBRATE == 0).alias("calibrates"))
    return docs.withColumn("deal", deal).join(F.broadcast(chosen), ["lang", "deal"]).groupBy("lang", "deal", "calibrates").agg(F.min("text").alias("text")).select("lang", "text", "calibrates")


def learned(docs: DataFrame, rows: int = ROWS) -> Identifier | None:
    """From text and lang of docs; None where no row has a lang."""
    docs = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = saved(sample(docs, rows), "sample")
    langs = sorted(r["lang"] for r in some.select("lang").distinct().collect())
    if not langs:
        return None
    calibrates = F.col("calibrates")

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            raw = "".join(batch.column("text").to_pylist()).lower().encode("utf-32-le", "surrogatepass")
            seen += np.bincount(np.frombuffer(raw, np.uint32), minlength=0x110000)
        at = np.array([c for c in np.flatnonzero(seen).tolist() if chr(c).isalpha()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["char", "n"])

    seen = some.select("text").mapInArrow(letters, "char long, n long").groupBy("char").agg(F.sum("n").alias("n")).collect()  # at most all letters there are
    # 0: no letter; 1: a letter that the sample lacks
    ids = np.zeros(0x110000, np.uint32)
    ids[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    ids[[r["char"] for r in seen]] = [r["char"] for r in seen]
    alphabet = len(seen) + 2
    held = docs.sparkSession.sparkContext.broadcast(ids)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts, lang = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist())
            for one in np.unique(lang).tolist():
                chars, off, _ = codes([t for t, k in zip(texts, lang.tolist()) if k == one], held.value)
                rows = grams(chars, off)
                _, first, n = np.unique(hashed(rows)[ORDER], return_index=True, return_counts=True)
                near, far = (sum(c.astype(np.int64) << BITS * j for j, c in enumerate(part)) for part in (rows[:3, first], rows[3:, first]))
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(n), pa.string()), pa.array(near), pa.array(far), pa.array(n)], ["lang", "near", "far", "n"])

    table = some.where(~calibrates).mapInArrow(counted, "lang string, near long, far long, n long").groupBy("lang", "near", "far").agg(F.sum("n").alias("n")).toPandas()
    have = [lang for lang in langs if (table["lang"] == lang).any()]
    if not have:
        return None
    models = []
    for lang in have:
        part = table[table["lang"] == lang]
        rows = [part["near" if j < 3 else "far"].to_numpy(np.int64) >> BITS * (j % 3) & (1 << BITS) - 1 for j in range(ORDER)]
        models.append(Model(np.stack(rows).astype(np.uint32), part["n"].to_numpy(np.int64), alphabet))
    out = Identifier(have, ids, models)
    sent = docs.sparkSession.sparkContext.broadcast(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            cross, n, letters = sent.value.read(batch.column("text").to_pylist())
            lang = [sent.value.langs.index(k) if k in sent.value.langs else -1 for k in batch.column("lang").to_pylist()]
            ok = (letters > 0) & (np.array(lang) >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(cross[ok]), pa.list_(pa.float64())), pa.array(n[ok]), pa.array(np.array(lang, np.int64)[ok])], ["cross", "n", "lang"])

    held_back = some.where(calibrates).mapInArrow(read, "cross array<double>, n long, lang long").toPandas()
    if len(held_back):
        out.calibrate(np.stack(held_back["cross"].to_list()), held_back["n"].to_numpy(np.int64), held_back["lang"].to_numpy(np.int64))
    return out


def languages(docs: DataFrame, held_out: int = 1, folds: int = 3, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Rows whose crc32(doc_id) mod folds is held_out and rows with a null lang teach nothing; a null doc_id teaches. A null
    text or one without a letter is `und` with score 0 and null cross_entropy, rejected; so is all where nothing can be
    learned. Ties go to the language first in order. rejected marks texts that no language's model expects; lang_pred is
    then still the likeliest. Rows that repeat are scored alike. An empty table gives no rows. Other columns are left out.
    """
    held = in_fold(held_out, folds)
    found = learned(docs.where(~held), rows)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if found is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "text", 4 << 20):
            cross, n, letters = model.read(batch.column("text").to_pylist())
            best = cross.argmin(1)
            score = confidences(cross, n, model.heat)[np.arange(len(best)), best]
            ok = letters > 0
            lang = [model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), ok.tolist())]
            least = cross[np.arange(len(best)), best]
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(np.where(ok, score, 0.0)), pa.array(least, mask=~ok), pa.array(~ok | (least > model.limit))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return base.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
