"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, crc, size); a keyed Feistel network over a grid of at
least N cells, walked on until the number is below N, permutes the numbers; position p lies in shard
``p % shards`` at slot ``p // shards``. So any row's place is computable from its number alone, shards
differ by one row at most (law ``rows``), and slots are gapless.

Defined cases: null text: size 1 and the crc of nothing; null doc_id first; repeated rows have numbers of
their own; empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stash, text_of

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, keyed."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def feistel(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 applied to ``numbers``. The grid has a side of ceil(sqrt(n)), so that under
    2 * sqrt(n) + 1 cells lie beyond n and walks are short at any n."""
    if n <= 1:
        return np.zeros_like(numbers)
    side = np.uint64(max(2, int(np.ceil(np.sqrt(n)))))
    while int(side) ** 2 < n:
        side += np.uint64(1)
    keys = [seed * 1_000_003 + r * 7919 + 1 for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // side, x % side
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = (right + side - _mixed(left, key) % side) % side, left
            else:
                left, right = right, (left + _mixed(right, key) % side) % side
        return left * side + right

    out = once(numbers.astype(np.uint64))
    while (beyond := np.flatnonzero(out >= np.uint64(n))).size:
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, _number, _total: one range sort of narrow rows; the row counts of its partitions
    (as many as shuffle partitions, whatever the rows), added up, give the first number of each."""
    slim = docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    slim = stash(slim, "sizes")
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stash(ranged.select("doc_id", "size", "text_crc32", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_nth")), "ranged")
    discard(slim)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    firsts = stash(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(W.partitionBy()).alias("_total")), "firsts")
    # at most one row for each partition: its size is known and bounded
    return ranged.join(F.broadcast(firsts), "_part").select("doc_id", "size", "text_crc32", (F.col("_first") + F.col("_nth")).alias("_number"), "_total")


def shard(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                at = feistel(frame["_number"].to_numpy(), int(frame["_total"].iloc[0]), seed)
                frame["shard"], frame["slot"] = (at % shards).astype(np.int32), at // shards
                yield frame.drop(columns=["_number", "_total"])

    placed = numbered(docs)
    kind = {f.name: f.dataType.simpleString() for f in placed.schema}
    # doc_id travels as text: pandas has no whole numbers with nulls
    out = placed.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, "doc_id string, size long, text_crc32 long, shard int, slot long")
    return out.select(F.col("doc_id").cast(kind["doc_id"]).alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
