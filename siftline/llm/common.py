"""What the operators share: tables in the shared folder, and words and hashes of whole Arrow batches at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.tables import saved, shared_dir

__all__ = ["saved", "shared_dir"]

#: ASCII white space, [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first n bytes of a little-endian word of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: 63-bit numbers, of which a sample takes those below a share.
DEAL = 1 << 63


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table; documents that would be read by fewer tasks than there are cores are dealt to all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def text_bytes(df: DataFrame) -> int:
    """The bytes of all texts, counted."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def limit_of(share: float) -> int:
    """The 63-bit number below which a share of all hashes are; no share above 0 rounds to none."""
    return min(DEAL - 1, max(int(share > 0), int(share * DEAL)))


def sampled(share: float, *by: str | F.Column) -> F.Column:
    """Whether a row is among a share of all, dealt by a hash of the columns."""
    return F.xxhash64(F.lit(11), *by).bitwiseAND(DEAL - 1) < limit_of(share)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """did: doc_id, or 0 for a null one, which none marks. h: a hash that tells rows with one did apart. Null texts are empty."""
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(0)).alias("did"), own.isNull().alias("none"), F.xxhash64(text, own.isNull()).alias("h"), text.alias("text"))


def doc_id() -> F.Column:
    return F.when(~F.col("none"), F.col("did")).alias("doc_id")


def trim() -> None:
    """Gives freed memory back: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about `most` bytes in a column; a longer row makes a run alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        trim()


def flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, with 8 more zero bytes, and where each begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.zeros(int(off[-1] - off[0]) + 8, np.uint8)
    if len(buf) > 8:
        buf[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    return (LOWER[buf] if lower else buf), off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and the number of words before each text."""
    n = len(buf) - 8
    space = IS_SPACE[buf[:n]]
    first = np.zeros(n + 1, bool)
    first[off] = True
    word = ~space
    starts, ends = word.copy(), word.copy()
    starts[1:] &= space[:-1] | first[1:n]
    ends[:-1] &= space[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends - starts, np.searchsorted(starts, off)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; no two spans of at most eight bytes and the same length share one."""
    at = eights(buf)
    out = mixed((at[starts] & FIRST[np.minimum(lens, 8)]) + lens.astype(np.uint64) * ODD)
    left, pos = np.flatnonzero(lens > 8), 8
    while len(left):
        more = at[starts[left] + pos] & FIRST[np.minimum(lens[left] - pos, 8)]
        out[left] = mixed(out[left] * ODD + more)
        pos += 8
        left = left[lens[left] > pos]
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= ODD
        out += words[j : len(words) - n + 1 + j]
    return mixed(out)


def texts_of(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans, one after the other, and their offsets."""
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    return buf[np.arange(off[-1]) + np.repeat(starts - off[:-1], lens)], off


def byte_strings(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[bytes]:
    whole = buf.tobytes()
    return [whole[a : a + n] for a, n in zip(starts.tolist(), lens.tolist())]


def in_fold(fold: int, of: int, own: F.Column | None = None) -> F.Column:
    """Whether crc32(doc_id as text) mod `of` is `fold`; false for a null doc_id."""
    return F.coalesce(F.crc32((F.col("doc_id") if own is None else own).cast("string").cast("binary")) % of == fold, F.lit(False))


#: Bits of a Bloom filter at most: 4 MB, whatever the number of keys. One that is too full just lets more rows pass.
BLOOM_BITS = 1 << 25


class Bloom:
    """Which 64-bit hashes may be among the keys; two probes. Rows that fail aren't among them."""

    def __init__(self, words: bytes, bits: int) -> None:
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, keys: DataFrame) -> Bloom:
        """Of the one column of keys, a hash."""
        k = F.col(keys.columns[0])
        bits = min(BLOOM_BITS, max(1 << 12, 1 << int(np.ceil(np.log2(10 * max(1, keys.count()))))))
        at = F.explode(F.array(k.bitwiseAND(bits - 1), F.shiftrightunsigned(k, 32).bitwiseAND(bits - 1)))
        words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toPandas()  # at most BLOOM_BITS / 64 rows
        out = np.zeros(bits // 64, np.int64)
        out[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
        return cls(out.tobytes(), bits)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        words, keys = np.frombuffer(self.words, np.uint64), keys.view(np.uint64)
        ok = np.ones(len(keys), bool)
        for k in (keys, keys >> np.uint64(32)):
            at = k & np.uint64(self.bits - 1)
            ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def settled(base: DataFrame, changes: DataFrame, done: Callable[[list[bytes], list], list[pa.Array]], schema: str) -> DataFrame:
    """did, none and what done() makes of each row of base (did, none, h, text) and its changes, of the columns in schema.

    changes: did, h and a column with what changes in that row; rows without any get None and are done where they are
    read. Only the texts of others move, compressed.
    """
    name = changes.columns[2]
    key = F.xxhash64("did", "h")
    held = base.sparkSession.sparkContext.broadcast(Bloom.of(changes.select(key)))
    names = ["did", "none", *(c.split()[0] for c in schema.split(", "))]

    def rows(batch: pa.RecordBatch, texts: list[bytes], found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("did"), batch.column("none"), *done(texts, found)], names)

    def still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            batch = batch.filter(pa.array(~held.value.passes(batch.column("k").to_numpy())))
            yield rows(batch, [t.encode() for t in batch.column("text").to_pylist()], [None] * batch.num_rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", 4 << 20):
            batch = batch.filter(pa.array(held.value.passes(batch.column("k").to_numpy())))
            texts = pa.array([pack.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("none"), batch.column("h"), texts], ["did", "none", "h", "packed"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 2 << 20):
            yield rows(batch, [unpack.decompress(p) for p in batch.column("packed").to_pylist()], batch.column(name).to_pylist())

    marked, whole = base.withColumn("k", key), "did long, none boolean, " + schema
    some = marked.mapInArrow(packed, "did long, none boolean, h long, packed binary").join(changes, ["did", "h"], "left")
    return marked.mapInArrow(still, whole).unionByName(some.select("did", "none", "packed", name).mapInArrow(moved, whole))
