"""Packing into optimal length buckets.

Texts become pieces of at most `longest` tokens. Dynamic programming over the histogram of all piece lengths finds the
`buckets` upper bounds with the least padding in total. In each bucket, pieces padded to its bound fill batches of at
most `budget` tokens. Only the histogram (at most `longest` rows) and the table of shards' sizes come together; the
pieces of a bucket are numbered in shards, so a bucket that holds most rows is spread like any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import doc_id, keyed, saved

LONGEST, BUCKETS, BUDGET = 2048, 8, 16384


def words(text: Column) -> Column:
    """Tokens of a text: its words [^\\x20\\x09-\\x0D]+, and one end."""
    return F.array_append(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != ""), F.lit("</s>"))


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` ranges of lengths with the least padding: the sum of counts * (bound - length)."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    rows, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * lengths))
    best, back = np.full(n + 1, np.iinfo(np.int64).max // 4), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        # padding of one bucket over lengths i to j-1, after the best of all before i
        new, came = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        best = new
        back.append(came)
    out, j = [], n
    for came in reversed(back):
        if j and came[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(came[j])
    return out[::-1]


def pack(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, with_text: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot, padding.

    A null text is empty; an empty one is a piece with the end token alone. Rows with one doc_id are packed each, equal
    ones too. budget counts padded tokens and must be at least `longest`. An empty table gives no rows. with_text adds
    the piece's tokens, joined by a space. Other columns of docs are left out.
    """
    if budget < longest:
        raise ValueError("budget must be at least longest")
    base = keyed(docs)
    tokens = words(F.col("text"))
    n = F.size(tokens) if not with_text else F.size("tokens")
    base = base.withColumn("tokens", tokens) if with_text else base
    base = base.select("did", "none", "h", n.alias("n"), *(["tokens"] if with_text else []))
    # texts are split once; what follows reads their lengths alone
    base = base if with_text else saved(base, "lengths")
    pieces = base.select(
        "did", "none", "h", *(["tokens"] if with_text else []), "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / longest).cast("int"))).alias("piece")
    ).withColumn("n_tokens", F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int"))
    lengths = pieces.groupBy("n_tokens").count().collect()  # at most `longest` rows
    if not lengths:
        ends, shards = [longest], 1
    else:
        ends = bounds(np.array([r[0] for r in lengths]), np.array([r[1] for r in lengths]), buckets)
        shards = max(8, sum(r[1] for r in lengths) // 50_000)
    at = F.array_position(F.transform(F.array(*map(F.lit, ends)), lambda e: e >= F.col("n_tokens")), True).cast("int") - 1
    dealt = pieces.withColumn("bucket", at).withColumn("spread", F.xxhash64("did", "h", "piece")).withColumn("shard", F.pmod("spread", F.lit(shards)))
    sizes = dealt.groupBy("bucket", "shard").count()  # at most buckets * shards rows
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("bucket", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    if shards <= 100_000:
        before = F.broadcast(before)
    own = Window.partitionBy("bucket", "shard").orderBy("spread", "did", "h", "piece")
    bound = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1)
    numbered = dealt.withColumn("at", F.row_number().over(own) - 1).join(before, ["bucket", "shard"]).withColumn("at", F.col("at") + F.col("before"))
    numbered = numbered.withColumn("bucket_len", bound).withColumn("rows", F.floor(F.lit(budget) / F.col("bucket_len")))
    first = F.col("piece").cast("long") * longest
    return numbered.select(
        doc_id(),
        "piece",
        first.alias("first_token"),
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("at") / F.col("rows")).alias("batch"),
        (F.col("at") % F.col("rows")).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        *([F.array_join(F.slice("tokens", F.col("piece") * longest + 1, F.col("n_tokens")), " ").alias("tokens")] if with_text else []),
    )
