"""Line dedup: exact reference counts of line keys, in shards, each with a cuckoo filter in front.

A key is a line stripped of [\\x20\\x09-\\x0D] and lower-cased in A-Z, if it has at least `least` code points; it is held as
16 bytes of its SHA-256. The exact table has a row a key: how many documents hold it, and the largest doc_id among them.
Keys held by at least `common` documents are the common ones. Each shard's cuckoo filter holds the fingerprints of its
common keys and stays with its shard: lines' keys are sent there, and only hits go on to the exact table.

Insertions and deletions change the counts of the keys they touch, and insert or delete fingerprints as keys become or
cease to be common; a deletion undoes the insertion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACES, doc_id, keyed, saved, settled, slices

LEAST, COMMON = 40, 5
#: Keys a shard: its filter takes about this many bytes times 2.4 / 0.9.
SHARD_KEYS = 200_000
SLOTS, KICKS, KEY_BYTES = 4, 500, 16
#: Tasks among which a shard's keys are dealt.
SALTS = 8


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, 4 to a bucket; add and remove take and give (key's first 8 bytes)."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85)))), SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter with all keys; twice the size where they don't fit."""
        size = max(1, len(keys))
        while True:
            out = cls.sized(size)
            if all(out.add(k) for k in keys.tolist()):
                return out
            size *= 2

    def _print(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.asarray(key, np.uint64)
        mark = (key >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        mask = np.uint64(len(self.table) - 1)
        one = key & mask
        return mark, one, one ^ (self._jump(mark) & mask)

    @staticmethod
    def _jump(mark: np.ndarray) -> np.ndarray:
        return (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    def add(self, key: int) -> bool:
        mark, one, two = (int(x) for x in self._print(key))
        for at in (one, two):
            if len(free := np.flatnonzero(self.table[at] == 0)):
                self.table[at, free[0]] = mark
                return True
        before = []
        at = one
        for k in range(KICKS):
            slot = (mark + k) % SLOTS
            before.append((at, slot, int(self.table[at, slot])))
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= int(self._jump(mark)) & (len(self.table) - 1)
            if len(free := np.flatnonzero(self.table[at] == 0)):
                self.table[at, free[0]] = mark
                return True
        for at, slot, mark in reversed(before):  # full: as it was
            self.table[at, slot] = mark
        return False

    def remove(self, key: int) -> bool:
        mark, one, two = (int(x) for x in self._print(key))
        for at in (one, two):
            if len(found := np.flatnonzero(self.table[at] == mark)):
                self.table[at, found[0]] = 0
                return True
        return False

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._print(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(1)


def first8(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")


def shard8(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(k[8:12] for k in keys), "<u4") % shards


def shard_of(shards: int) -> F.Column:
    """The same as shard8, of a key column."""
    b = [F.conv(F.hex(F.substring("key", 9 + i, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(4)]
    return (b[0] + b[1] + b[2] + b[3]) % shards


def line_keys(text: bytes, least: int) -> list[tuple[bytes, bytes | None]]:
    """Each line, and its key if it is long enough."""
    out = []
    for line in text.split(b"\n"):
        key = None
        if len(line) >= least and len(s := line.strip(SPACES)) >= least and len(s.decode()) >= least:
            key = hashlib.sha256(s.lower()).digest()[:KEY_BYTES]
        out.append((line, key))
    return out


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The exact table: key, docs (distinct doc_ids that hold it, null ones as one), last (the largest, or null)."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = {(k, did) for did, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for _, k in line_keys(text.encode(), least) if k}
            keys, ids = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    # a key that very many documents hold is spread until its pairs are distinct
    pairs = keyed(docs).select(doc_id(), "text").mapInArrow(held, "key binary, doc_id long").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


def filters(common: DataFrame, shards: int) -> DataFrame:
    """A cuckoo filter for each shard that has common keys: shard, keys, filter."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = Cuckoo.of(first8(rows["key"].tolist()))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1].tolist(), "keys": [len(rows)], "filter": [made.table.tobytes()]})

    return common.select(shard_of(shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard long, keys long, filter binary")


def screened(base: DataFrame, built: DataFrame, shards: int, least: int) -> DataFrame:
    """key, holders (did, none, h) of lines that their shard's filter may hold: keys go to their shard, beside its filter.

    A key travels once a block of input, with all its holders there. Each filter stands SALTS times, so a shard with a
    line of very many documents is no single task; in a task, a filter's row comes before its keys.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            held: dict[bytes, list[int]] = {}
            for i, text in enumerate(batch.column("text").to_pylist()):
                for key in {k for _, k in line_keys(text.encode(), least) if k}:
                    held.setdefault(key, []).append(i)
            if held:
                keys = list(held)
                off = np.concatenate([[0], np.cumsum([len(x) for x in held.values()])]).astype(np.int32)
                rows = pa.array([i for x in held.values() for i in x], pa.int64())
                who = pa.StructArray.from_arrays([batch.column(c).take(rows) for c in ("did", "none", "h")], ["did", "none", "h"])
                yield pa.RecordBatch.from_arrays([pa.array(shard8(keys, shards).astype(np.int64)), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(off), who)], ["shard", "key", "holders"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            shard, made = batch.column("shard").to_numpy(), batch.column("filter")
            heads = np.flatnonzero(made.is_valid().to_numpy(zero_copy_only=False)).tolist()
            ok = np.zeros(len(shard), bool)
            for a, b in zip([0, *heads], [*heads, len(shard)]):
                if a in heads:
                    now, held = shard[a], Cuckoo(np.frombuffer(made[a].as_py(), np.uint16).reshape(-1, SLOTS))
                    a += 1
                mine = a + np.flatnonzero(shard[a:b] == now)  # a shard without a filter has no common key
                if len(mine):
                    ok[mine] = held.has(first8(batch.column("key").take(pa.array(mine)).to_pylist())) if len(held.table) else True
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("holders")], ["key", "holders"]).filter(pa.array(ok))

    holders = "array<struct<did:long,none:boolean,h:long>>"
    salt = F.pmod(F.xxhash64(F.col("holders")[0]), F.lit(SALTS))
    keys = base.mapInArrow(sent, f"shard long, key binary, holders {holders}").select("shard", salt.alias("salt"), F.lit(None).cast("binary").alias("filter"), "key", "holders")
    heads = built.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast(holders).alias("holders"))
    together = heads.unionByName(keys).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return together.mapInArrow(screen, f"key binary, holders {holders}")


def changed(table: DataFrame, docs: DataFrame, sign: int, rest: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """The exact table after the documents were inserted (sign 1) or deleted (-1; rest: the documents that stay).

    After a deletion, only keys whose largest doc_id left are looked up again among the rest.
    """
    delta = counts(docs, least).select("key", (F.col("docs") * sign).alias("d"), F.col("last").alias("l"))
    both = table.join(delta, "key", "full_outer").select(
        "key", (F.coalesce("docs", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("docs"), "last", "l", F.col("d").isNotNull().alias("touched")
    ).where("docs > 0")
    if sign > 0:
        return both.select("key", "docs", F.greatest("last", "l").alias("last"))
    both = both.withColumn("lost", F.coalesce(F.col("touched") & (F.col("last") == F.col("l")), F.lit(False)))
    again = counts(rest, least).join(both.where("lost").select("key"), "key", "left_semi").select("key", F.col("last").alias("found"))
    return both.join(again, "key", "left").select("key", "docs", F.when(F.col("lost"), F.col("found")).otherwise(F.col("last")).alias("last"))


def refiltered(old: DataFrame, before: DataFrame, after: DataFrame, shards: int, common: int = COMMON) -> DataFrame:
    """The filters after keys became common (inserted) or ceased to be (deleted); only what changed moves."""
    was, now = (t.where(F.col("docs") >= common).select("key") for t in (before, after))
    change = now.join(was, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, "key", "left_anti").withColumn("add", F.lit(False)))
    change = change.withColumn("shard", shard_of(shards))

    def apply(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = (held if len(held) else rows)["shard"].iloc[:1].tolist()
        keys = int(held["keys"].iloc[0]) if len(held) else 0
        table = np.frombuffer(held["filter"].iloc[0], np.uint16).reshape(-1, SLOTS).copy() if len(held) else Cuckoo.sized(len(rows)).table
        f = Cuckoo(table)
        for add, key in sorted(zip(rows["add"], rows["key"]), key=lambda x: (x[0], x[1])):
            if not add:
                f.remove(int(first8([key])[0]))
            elif not f.add(int(first8([key])[0])):
                # a full filter can't tell its keys, so it answers yes to all until it is built again
                f.table = np.zeros((0, SLOTS), np.uint16)
                break
        return pd.DataFrame({"shard": shard, "keys": [keys + int((rows["add"] * 2 - 1).sum()) if len(rows) else keys], "filter": [f.table.tobytes()]})

    return old.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, "shard long, keys long, filter binary")


def line_dedup(docs: DataFrame, least: int = LEAST, common: int = COMMON, table: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 (and kept_text).

    Lines end at \\n; a null or empty text is one empty line. A line goes when its key is common and the document isn't
    the largest doc_id that holds it. Rows with one doc_id are one document, and each keeps its lines if that id is the
    largest; rows with a null doc_id are one more, which is never the largest. Other columns are left out; an empty table
    gives no rows. table: the exact table of a larger or earlier state, docs' own where none is given.
    """
    hot = saved((counts(docs, least) if table is None else table).where(F.col("docs") >= common), "common-lines")
    shards = max(1, -(-hot.count() // SHARD_KEYS))
    base = keyed(docs)
    found = screened(base, saved(filters(hot, shards), "line-filters"), shards, least)
    rows = found.join(hot.select("key", "last"), "key").select("key", "last", F.explode("holders").alias("x")).where(F.col("last").isNotNull() & (F.col("x.none") | (F.col("x.did") != F.col("last"))))
    gone = saved(rows.groupBy("x.did", "x.h").agg(F.collect_set("key").alias("keys")), "gone-lines")

    def cut(texts: list[bytes], keys: list[list[bytes] | None]) -> list[pa.Array]:
        n, dropped, kept = [], [], []
        for text, own in zip(texts, keys):
            n.append(text.count(b"\n") + 1)
            if own:
                own = set(own)
                left = [line for line, k in line_keys(text, least) if k not in own]
                dropped.append(n[-1] - len(left))
                text = b"\n".join(left)
            else:
                dropped.append(0)
            kept.append(text)
        out = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
        return [*out, pa.array([t.decode() for t in kept], pa.string())] if with_text else out

    done = settled(base, gone, cut, "n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)
    return done.select(doc_id(), "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if with_text else []))
